"""Every registered query of the operators: its columns, one row per row where the contract says so, empty tables."""

import random

import numpy as np
import pytest

from pulsegrid.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
TALKS = "conv_id long, turn long, role string, text string"
ITEMS = "item_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
COLUMNS = {
    "op1_mixing": "doc_id size source_size target taken", "op2_token_binary": "doc_id start n_tokens ids_crc32", "op3_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op5_language_id": "doc_id held_out lang_pred score", "op6_html": "page_id url text n_chars", "op7_ngram_join": "doc_id n_shingles component_id",
    "op8_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op10_embedding_dups": "vec_id n_links component_id kept",
    "op11_whitening": "vec_id component n deviation whitened explained identity_error", "op12_ranked_search": "item_id rank doc_id score", "op13_token_counts": "doc_id n_bytes n_tokens over_limit",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    text = lambda: " ".join(rng.choice(["the", "river", "stone", "and", "water"]) + rng.choice("abc") for _ in range(rng.randrange(1, 60)))
    docs = [(i, text(), rng.choice(["en", "de"]), rng.choice(["a", "b", None]), 1) for i in range(40)] + [(40, None, None, None, None), (41, "", "en", "a", 0), (42, "word " * 30_000, "en", "a", 1)]
    docs += [docs[3], (44, docs[3][1], "de", "b", 1)]
    pages = [(i, f"u{i}", f"<article><p>{text()}</p></article>") for i in range(5)] + [(9, None, None), (10, "u", "")]
    talks = [(c, t, ["user", "assistant"][t % 2], text()) for c in range(4) for t in range(3)] + [(7, 0, None, None)]
    vectors = [(i, np.random.default_rng(i % 5).standard_normal(8).astype(float).tolist(), i % 2) for i in range(30)] + [(90, None, 1), (91, [0.0] * 8, None)]
    items = [(i, text()) for i in range(6)] + [(7, None), (8, ""), (None, "river stonea")]
    out = {}
    for name, parts in (("small", (docs, pages, talks, vectors, items)), ("empty", ([], [], [], [], []))):
        path = out[name] = str(tmp_path_factory.mktemp(name))
        for table, rows, schema in zip(("documents", "pages", "conversations", "embeddings", "benchmark"), parts, (DOCUMENTS, PAGES, TALKS, VECTORS, ITEMS), strict=True):
            spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    return out


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, tables, name):
    got = queries.queries()[name](spark, tables["small"])
    assert got.columns == COLUMNS[name].split()
    rows = {"op6_html": 7, "op8_chat": 6, "op10_embedding_dups": 32, "op11_whitening": 31 * 4}.get(name, 45)
    n = got.count()
    if name == "op12_ranked_search":  # as many as there are documents with a score
        assert 6 * 20 < n <= 7 * 45
        return
    assert n == rows if name != "op9_packing" else n > rows  # the long text is cut into pieces


@pytest.mark.parametrize("name", COLUMNS)
def test_empty_tables(spark, tables, name):
    assert queries.queries()[name](spark, tables["empty"]).count() == (name == "op8_chat")
