"""Ranked search against plain Python, and that masks save work without losing a document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, keep=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    held, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        rows = []
        for i, c in counted:
            m = 100 - 50 + (50 * c.total() * held) // length
            score = sum(math.floor(1000 * math.log((2 * held + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                rows.append((score, i))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(rows[:keep])]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_terms():
    rng = random.Random(0)
    for _ in range(500):
        text = "".join(rng.choice("aZ09 -_/:@[`{~\t\n\0\x7f\x80éÉİıſ日퟿\U0001f600") for _ in range(rng.randrange(30)))
        assert [t.decode() for t in ranked_search.terms_of(text) if t] == terms(text)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Éa", "ÉA", "éa", "ABC", "abc"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda m: rng.choice([" ", ", ", "--"]).join(rng.choices(vocabulary, weights, k=rng.randrange(m)))
    docs = [(i, text(40)) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(n // 2)] + [docs[4], docs[4], (None, docs[3][1]), (None, docs[5][1]), (-5, None), (-6, ""), (-7, "... --"), (-8, "w1 " * 20_000)]
    items = [(i, text(25)) for i in range(12)] + [(20, None), (21, "zzz"), (22, " ".join(vocabulary)), (0, "w50 w51"), (None, "w3 w4"), (23, " ".join(f"x{k} w{k % 60}" for k in range(150)))]
    return docs, items


@pytest.mark.parametrize("parts", [1, 9])
def test_search(spark, parts):
    docs, items = corpus(parts, 300)
    got = ranked_search.search(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items), key=key)


def test_slices_and_small_blocks(spark, monkeypatch):
    docs, items = corpus(5, 120)
    monkeypatch.setattr(ranked_search, "SENT_TERMS", 20)
    got = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), keep=7).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items, 7), key=key)
    assert ranked_search.slices_of({1: 5, 2: 30, 3: 4, 4: 7, 5: 9}, 20) == [[1], [2], [3, 4, 5]]


def test_masks_over_64_terms_and_blocks_that_are_skipped():
    rng = np.random.default_rng(2)
    held, length, best, all_ = 4000, 4000 * 60, ranked_search.Best(50), []
    terms_, weights, scored = list(range(100)), [int(w) for w in rng.integers(0, 9000, 100)], 0
    for b in range(4):
        doc = np.repeat(np.arange(1000), 20)
        term = np.concatenate([rng.choice(150, 20, replace=False) for _ in range(1000)])
        tf, n, ids = rng.integers(1, 9, len(doc)), rng.integers(20, 100, 1000), rng.permutation(1000) + 1000 * b
        block = ranked_search.Block(ids, np.zeros(1000, bool), n, doc, term, tf, held, length)
        scored += block.search(terms_, weights, best)
        for k in range(1000):
            m = 50 + (50 * int(n[k]) * held) // length
            all_.append((-sum(weights[t] * ((10**9 * int(c)) // (1000 * int(c) + 20 * m)) for t, c in zip(term[doc == k], tf[doc == k], strict=True) if t < 100), int(ids[k])))
    assert [(-s, i) for s, i in sorted(all_)[:50]] == list(zip(best.score.tolist(), best.id.tolist(), strict=True))
    assert 50 <= scored < 4000


@pytest.mark.parametrize(("docs", "items"), [([], []), ([(1, "a b")], []), ([], [(1, "a")]), ([(1, None)], [(1, "a")]), ([(1, "b")], [(1, "a")])])
def test_empty(spark, docs, items):
    got = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (2, "c", "x", "y")], DOCS + ", n string, terms string")
    items = spark.createDataFrame([(1, "a", "x", "y")], ITEMS + ", term string, slot string")
    assert [tuple(r) for r in ranked_search.search(docs, items).collect()] == brute([(1, "a b"), (2, "c")], [(1, "a")])
