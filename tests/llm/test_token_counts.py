"""Token counts against the untouched libraries, and what the cache saves."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pulsegrid.llm import token_counts

DOCS = "doc_id long, text string"
FILES = ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")
BITS = ["a", "The", "river's", "É", "é", "İ", "ß", "日本", " ", "  ", "\n", "\t\r\n", "\x0b", "\x0c", " ", " ", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "< |endoftext|>", "12", "-", "\0", "́", "😀", "</s>", "<s>", "▁"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith("model"):
        tok = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(tok.encode(t))
    tok = Tokenizer.from_file(path)
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_counts(spark, tmp_path, name):
    some = texts(1, 1500) + ["a  b", "a b", " a b\n", "A B"] + ["word " * 40_000, None, ""]
    rows = [*enumerate(some), (None, "river"), (3, some[3]), *[(9000 + k, "The same text, again.") for k in range(800)]]
    got = token_counts.count_tokens(spark.createDataFrame(rows, DOCS).repartition(6), public_tokenizers.path(name), str(tmp_path / "cache"))
    count = library(name)
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 2048) for i, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_the_cache_is_used(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    version = token_counts.version_of(path)
    run = lambda rows: {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows, DOCS), path, cache).collect()}
    stored = lambda: token_counts.stored(spark, cache, version).count()
    assert run([(1, "one two"), (2, "one  two\n"), (3, "three"), (4, "THREE")]) == {1: 2, 2: 2, 3: 1, 4: 1} and stored() == 3
    assert run([(5, "one two"), (6, "four five six")]) == {5: 2, 6: 3} and stored() == 4
    known = token_counts.stored(spark, cache, version)
    assert run([(7, "three")]) == {7: 1} and stored() == 4
    # the counts come from the cache: of a text stored with another count, that one is returned
    known.limit(0).unionByName(spark.sql("SELECT unhex(sha2('planted', 256)) AS digest, 77L AS n_tokens")).selectExpr("*", f"'{version}' AS version").write.mode("append").parquet(cache)
    assert run([(8, " planted ")]) == {8: 77}
    # another version shares nothing, and a digest stored twice is one
    assert token_counts.stored(spark, cache, "other").count() == 0
    token_counts.stored(spark, cache, version).selectExpr("*", f"'{version}' AS version").write.mode("append").parquet(cache)
    assert run([(1, "one two"), (2, None)]) == {1: 2, 2: 0}


def test_versions_and_kinds():
    paths = [public_tokenizers.path(n) for n in FILES]
    assert len({token_counts.version_of(p) for p in paths}) == 3
    assert [token_counts.kind_of(p) for p in paths] == ["words", "bytes", "model"]


def test_equal_normal_forms_have_equal_counts():
    """What ``normalised`` folds, for the vocabulary it folds for."""
    count = library("word_bpe_49k.json")
    for t in texts(2, 5000):
        folded = " ".join(t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        while "  " in folded:
            folded = folded.replace("  ", " ")
        assert count(t) == count(folded.strip(" "))


def test_empty_and_clashing_columns(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), path, str(tmp_path / "a")).count() == 0
    df = spark.createDataFrame([(1, "a b", b"x", "y")], DOCS + ", digest binary, n_tokens string")
    assert [tuple(r) for r in token_counts.count_tokens(df, path, str(tmp_path / "b")).collect()] == [(1, 3, 2, False)]
