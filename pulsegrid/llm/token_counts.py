"""Token counts through a cache of digests: only texts that no earlier run has counted are encoded."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import arrow_batches, materialize, text_or_empty
from .tokens import word_cache

#: Raised when ``normalised`` changes, since stored digests are of normalised texts.
NORMALISATION = 1
#: Digests that a task remembers to send a text it meets again only once.
SEEN = 1_000_000
#: The splitters of the two vocabularies that can be read word by word (fixed values).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def kind_of(path: str) -> str:
    """How texts of a tokenizer file are counted: ``words`` (lower case, white space dropped), ``bytes`` (byte-level), ``json`` or ``model``."""
    if path.endswith(".model"):
        return "model"
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    normal, split, added = config["normalizer"], config["pre_tokenizer"] or {}, config["added_tokens"]
    small = len(config["model"]["vocab"]) + len(added) <= 1 << 16 and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    if small and normal is None and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True):
        return "bytes"
    steps = [n["type"] for n in (normal or {}).get("normalizers", [])]
    if small and steps == ["NFC", "Replace", "Lowercase"] and [p.get("pattern") for p in split.get("pretokenizers", [])][:1] == [{"Regex": _WORDS}]:
        return "words"
    return "json"


def version_of(path: str) -> str:
    """A digest of all that a count depends on beside the text: the file, the library's version, the normalisation."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256")
    digest.update(f"|{library} {importlib.metadata.version(library)}|{NORMALISATION}".encode())
    return digest.hexdigest()


def normalised(text: Column, kind: str) -> Column:
    """Texts of one normal form have one count: where the tokenizer drops white space, its plain runs become one space and go at the ends."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r]+", " ")) if kind == "words" else text


_loaded: dict[tuple[str, str], object] = {}


def counter(path: str, kind: str):
    """A function from texts to counts, loaded once a worker."""
    if kind in ("words", "bytes"):
        cache = word_cache(path, spaced=kind == "bytes")
        return lambda texts: [len(ids) // 2 for ids in cache.encode(texts)]
    if (path, kind) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if kind == "model":
            import sentencepiece

            _loaded[path, kind] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path, kind] = tok
    tok = _loaded[path, kind]
    if kind == "model":
        return lambda texts: [len(ids) for ids in tok.encode(texts, num_threads=1)]
    return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


_CACHE = "digest binary, n_tokens long, version string"


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache has for a tokenizer version; a folder that does not exist is an empty cache."""
    try:
        rows = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _CACHE)
    return rows.where(F.col("version") == version).select("digest", "n_tokens")


def misses(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, packed) of the texts (digest, text) that ``known`` lacks, equal digests side by side.

    Texts travel packed; a task sends a text that it meets again once, so a text that a third
    of all rows share is a row a task.
    """

    def pack(batches):
        shut, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for b in batches:
            keep = []
            for k, digest in enumerate(b.column(0).to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    keep.append(k)
            if len(seen) > SEEN:
                seen.clear()
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shut(t.encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()], pa.binary())], ["digest", "packed"])

    packed = texts.mapInArrow(pack, "digest binary, packed binary")
    return packed.join(known.select("digest"), "digest", "left_anti").repartition("digest").sortWithinPartitions("digest")


def encode(found: DataFrame, path: str, kind: str) -> DataFrame:
    """(digest, n_tokens) of sorted misses, each digest once."""

    def run(batches):
        open_, count, last = zstandard.ZstdDecompressor().decompress, counter(path, kind), None
        for b in batches:
            digests, texts = [], []
            for digest, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if digest != last:
                    digests.append(digest)
                    texts.append(open_(packed.as_py()).decode("utf-8", "surrogatepass"))
                    last = digest
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(count(texts), pa.int64())], ["digest", "n_tokens"])

    return found.mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 2048) -> DataFrame:
    """Tokens of each document (doc_id, text) as the library of the file counts them, without added special tokens.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).  ``cache`` is a
    folder of (digest, n_tokens, version): SHA-256 of the normalised text, its count, and the
    digest of the tokenizer's file and version.  Digests of the documents are joined to it;
    of those that it lacks each is encoded once, and the new counts are appended.  The same
    digest stored twice, as by two jobs at once, does no harm, since its counts are equal.
    A job that fails before its write has ended leaves the cache as it was.

    Null text is empty text, which has no tokens and is a digest like others; null ids and
    repeated rows are returned like other rows; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    kind, version = kind_of(path), version_of(path)
    digest = F.unhex(F.sha2(normalised(text_or_empty(), kind), 256)).alias("digest")
    found = misses(docs.select(digest, normalised(text_or_empty(), kind).alias("text")), stored(spark, cache, version))
    encode(found, path, kind).withColumn("version", F.lit(version)).write.mode("append").option("compression", "zstd").parquet(cache)
    rows = materialize(docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), digest), "digests")
    # each needed digest once, as a written table: the join's larger side may then be split where one text is very common
    needed = rows.select("digest").distinct()
    counts = materialize(stored(spark, cache, version).join(needed, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
