"""Registered queries and the pipeline against plain Python over small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pulsegrid.llm import exact_dedup, langid, mixing, ngram_join, queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SAYS = "</s>[INST] ok [/INST]"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op8_digests(spark, tmp_path):
    rng = random.Random(3)
    bits = ["a", "é", "<|end|>", "<|turn|>", "\\", "\\l", "\n", "<", "assistant", " "]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(30)))])
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), text()) for c in range(12) for t in range(rng.randrange(1, 9))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op8_chat(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", SAYS), (-1, 1, "assistant", SAYS)]
    for c in {r[0] for r in rows}:
        turns = [(r, t or "") for k, _, r, t in sorted(rows, key=lambda x: x[:2]) if k == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got.pop(c)
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars >= sum(len(a) + len(b) for a, b in turns)
    assert not got


def words(rng, n, vocabulary=("the", "thing", "ending", "order", "river", "stone", "a", "of")):
    return " ".join(rng.choice(vocabulary) + rng.choice("abcdefgh") for _ in range(n))


def brute_components(texts: dict) -> dict:
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t.split() else set() for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def test_pipeline_ends_in_what_its_stages_ask(spark, tmp_path):
    """Kept documents, words taken of each source, token ids and places of the packed pieces, recomputed without Spark."""
    rng = random.Random(7)
    rows = [(i, words(rng, rng.choice([20, 60, 700])), "en", f"s{i % 3}", 1) for i in range(60)]
    near = rows[7][1].split()
    near[3] = "changed"
    rows += [(60, rows[3][1], "en", "s1", 1), (61, rows[3][1].replace(" ", "  ", 1), "en", "s0", 1), (62, "12 34 !", "en", "s1", 1), (63, None, None, None, None), (64, " ".join(near), "en", "s2", 1), rows[5]]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(path)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {i: t for i, t, *_ in rows if i not in (60, 61, 62, 63)}
    component = brute_components(texts)
    kept = {i for i in texts if component[i] == i}
    assert 64 not in kept and 7 in kept
    source = {i: s for i, _, _, s, _ in rows}
    size = {i: len(texts[i].split()) for i in kept}
    total = Counter()
    for i in kept:
        total[source[i]] += size[i]
    pieces = Counter((r.doc_id, r.piece) for r in out)
    copies = {i: pieces[i, 0] for i in kept}
    assert {r.doc_id for r in out} <= kept and max(copies.values()) <= 2
    weight, open_, budget, target = {"s0": 3.0, "s1": 1.0, "s2": 2.0}, set(total), 1.5 * sum(total.values()), {}
    while True:
        level = budget / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * total[s]
            budget -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    for s in total:
        assert abs(sum(copies[i] * size[i] for i in kept if source[i] == s) - target[s]) <= max(size[i] for i in kept if source[i] == s)
    tok, held = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i in kept:
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        cuts = range(0, len(ids), 2048)
        assert all(pieces[i, k] == copies[i] for k in range(len(cuts))) and sum(n for (d, _), n in pieces.items() if d == i) == len(cuts) * copies[i]
        held |= {(i, k): (s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(cuts)}
    sequences = {}
    for r in out:
        assert (r.start, r.length, r.ids_crc32) == held[r.doc_id, r.piece]
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_that_clash(spark):
    """Every name an operator might use for itself, as a further column: it comes back as it was."""
    names = ["key", "copies", "copy", "_id", "_key", "_sha", "odd_id", "key_id", "sha", "size", "kept", "keep_id", "group_size", "text_sha256", "lang_pred", "score", "letters", "_text", "component_id", "rep", "n", "target", "taken", "bucket", "h"]
    rng = random.Random(1)
    rows = [(i, words(rng, 30), "en", "s", *[f"{n}{i}" for n in names]) for i in range(12)]
    rows.append((*(None, None, None, None), *["x"] * len(names)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for f in (langid.keep_identified, exact_dedup.drop_copies, ngram_join.drop_near_copies, lambda d: mixing.take(d, mixing.mix(d.select("doc_id", "text", "source")))):
        got = f(df)
        assert got.columns == df.columns
        back = [tuple(r) for r in got.collect()]
        assert set(back) <= {tuple(r) for r in df.collect()} and len({r[0] for r in back} - {None}) == 12


def test_learning_reads_whole_texts(spark):
    """Only the last part of each text tells its language."""
    rng = random.Random(2)
    tail = {"aa": "thing ending that", "bb": "schule und eile", "cc": "que eau bateau"}
    same = "0123 4567 89 " * 40
    rows = [(i, same + " ".join([tail[k]] * 40), k) for i, k in enumerate(rng.choice(list(tail)) for _ in range(240))]
    got = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: k for i, _, k in rows}
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in got if r.held_out]) > 0.95


def test_tables_equal_the_plain_convolution():
    """Predictions by tables of byte pairs against sliding filters."""
    rng = np.random.default_rng(0)
    f = langid.FILTERS
    model = langid.Model(["x", "y", "z"], [rng.normal(0, 1, (w, 256, f)).astype(np.float32) for w in langid.WIDTHS], rng.normal(0, 1, 3 * f), rng.normal(0, 1, (3 * f, 3)), rng.normal(0, 1, 3))
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    tops = [np.max([sum(e[j][x[:, p + j]] for j in range(len(e))) for p in range(langid.WINDOW - len(e) + 1)], axis=0) for e in model.filters]
    z = np.maximum(np.concatenate(tops, axis=1) + model.bias, 0) @ model.weights + model.offset
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(model.predict(x), p / p.sum(axis=1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_mixing_of_few_rows(spark, n):
    df = spark.createDataFrame([(i, "a b", None) for i in range(n)], "doc_id long, text string, source string")
    assert mixing.take(df, mixing.mix(df)).count() in range(2 * n + 1)
