"""What the n-gram join shuffles: no prefix of a document without copies, and a bitmap once for tiles that share documents."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import ngram_join


def words(rng, n, vocabulary=10**6):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shuffled(spark, run) -> list[tuple[int, int]]:
    """(records, bytes) that each stage of run writes to a shuffle."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return {found.apply(k).stageId(): found.apply(k) for k in range(found.size())}

    before = stages()
    run()
    return [(s.shuffleWriteRecords(), s.shuffleWriteBytes()) for k, s in stages().items() if k not in before]


def test_prefixes_of_documents_without_copies_stay(spark):
    """Joins are shuffled here as they are over large inputs; a prefix of 500 shingles has 4,000 bytes, a text twice as many."""
    rng = random.Random(5)
    texts = [" ".join(words(rng, 2000)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[7], texts[7]])), "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got: list = []
        wrote = shuffled(spark, lambda: got.extend(ngram_join.jaccard_components(df).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: r.component_id for r in got} == {i: i if i < 60 else 7 for i in range(62)}
    assert sum(n for n, size in wrote if n and 3500 < size / n < 6000) <= 6, wrote


def linked(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(sets))}


@pytest.mark.parametrize(("block", "pairs", "once", "slots"), [(4, 100, 10, 8), (1024, 1, 50, 1)])
def test_components_are_the_same_for_all_cells(spark, monkeypatch, block, pairs, once, slots):
    for name, value in (("BLOCK", block), ("CELL_PAIRS", pairs), ("PAIRS_AT_ONCE", once), ("COPY_SLOTS", slots)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(11)
    base, texts = words(rng, 100), []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [*texts[:9], *texts[:9]]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(96)} for t in texts]
    more: list = []
    got = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), more.append).collect()
    want = linked(sets)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 1


def test_a_bitmap_is_sent_once_for_tiles_of_one_smallest_document(spark):
    rng = np.random.default_rng(2)
    sets = {d: np.unique(rng.integers(0, 1 << 63, 40, np.uint64)) for d in range(6)}
    sets[4] = sets[1]
    tiles = {100 + t: [0, 1, 2, 3, 4, 5][: 3 + t % 4] for t in range(12)}
    member = spark.createDataFrame([(t, d, len(sets[d]), 0, 0, d) for t, ds in tiles.items() for d in ds], "token long, doc long, n long, pos int, lead long, label long")
    sized = spark.createDataFrame([(t, len(ds), 0) for t, ds in tiles.items()], "token long, size long, part long")
    sigs = spark.createDataFrame([(d, bytearray(ngram_join.bitmap_of(s))) for d, s in sets.items()], "doc_id long, bitmap binary")
    cells = ngram_join.cells_of(member, sized, sigs)
    rows = cells.collect()
    assert sorted(r.doc for r in rows) == list(range(6))
    assert {(t, r.doc) for r in rows for t in r.tokens} == {(t, d) for t, ds in tiles.items() for d in ds}
    batch = pa.table({c: pa.array([r[c] for r in rows], kind) for c, kind in zip(cells.columns, (*[pa.int64()] * 8, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True)}).to_batches()
    assert [tuple(r.values()) for b in ngram_join.compare_cells(iter(batch)) for r in b.to_pylist()] == [(1, 4)]
