"""Strings of added tokens in texts: the same ids as the library's plain call."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import packing, token_binary
from pulsegrid.llm.tokens import word_cache

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "ab <|endoftext|> cd", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|EndOfText|> <|endoftext |>", "x <|endoftext|>  y\n<|endoftext|>",
    "a \0b c", "\0", "\0a \0", "plain words, here.",
]


@pytest.mark.parametrize(("path", "spaced"), [(BYTES, True), (WORDS, False)])
def test_words_equal_the_plain_call(path, spaced):
    tok = Tokenizer.from_file(path)
    got = [np.frombuffer(x, "<u2").tolist() for x in word_cache(path, spaced).encode(TEXTS)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_files_and_packs_hold_added_tokens(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = lambda path: [zlib.crc32(np.array([*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in TEXTS]
    token_binary.write_tokens(df, BYTES, str(tmp_path))
    assert [r.ids_crc32 for r in token_binary.index_tokens(spark, str(tmp_path)).orderBy("start").collect()] == want(BYTES)
    assert [r.ids_crc32 for r in packing.pack(df, WORDS, 256).orderBy("doc_id").collect()] == want(WORDS)
