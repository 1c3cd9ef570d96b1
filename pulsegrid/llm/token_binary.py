"""Token ids in binary files: canonical length-limited Huffman codes, decoded by table from checkpoints."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, scratch_path, text_or_empty  # noqa: F401
from .tokens import word_cache

#: The longest code; a table of 2 ** MAX_BITS entries decodes every code in one step.
MAX_BITS = 16
#: Ids between two checkpoints of a block.
STRIDE = 256
#: Target bytes of ids in a file.
FILE_BYTES = 256 << 20
_IDS = "doc_id long, row_key long, n_tokens long, ids binary, tally binary"
_BLOCKS = "file int, doc_id long, row_key long, n_tokens long, checkpoints binary, bits binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Best code lengths of at most ``max_bits`` for the ids that occur (package-merge); 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError("more ids than codes of that length")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        mine = int(is_leaf[:take].sum())
        lengths[order[:mine]] += 1
        take = 2 * (take - mine)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by (length, id), and the decoding table: id and length for each MAX_BITS-bit window."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = np.int64(1) << (MAX_BITS - lengths[order].astype(np.int64))
    first = np.concatenate([[0], np.cumsum(width)[:-1]]).astype(np.int64)[: len(order)]
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = first >> (MAX_BITS - lengths[order].astype(np.int64))
    symbol, length = np.zeros(1 << MAX_BITS, np.uint16), np.ones(1 << MAX_BITS, np.uint8)
    total = int(width.sum()) if len(order) else 0
    symbol[:total] = np.repeat(order, width)
    length[:total] = np.repeat(lengths[order], width)
    return codes, symbol, length


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(checkpoints, bits): the bit offset of every STRIDE-th id as uint64, and the codes one after another."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word = codes[ids].astype(np.int64) << (24 - size - (start & 7))  # a code touches three bytes at most
    at, out = start >> 3, np.zeros((int(end[-1]) + 7 >> 3) + 3 if len(ids) else 3)
    for k in range(3):
        out += np.bincount(at + k, (word >> (16 - 8 * k)) & 255, len(out))
    return start[::STRIDE].astype("<u8").tobytes(), out[:-3].astype(np.uint8).tobytes() if len(ids) else b""


def decode_blocks(blocks: list[tuple[int, bytes, bytes]], symbol: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Ids of blocks (n, checkpoints, bits).  All stretches between checkpoints are decoded side by side."""
    data = np.frombuffer(b"".join(b for _, _, b in blocks) + bytes(4), np.uint8)
    base = np.cumsum([0] + [len(b) for _, _, b in blocks[:-1]]).astype(np.int64) * 8
    marks = [np.frombuffer(c, "<u8").astype(np.int64) for _, c, _ in blocks]
    pos = np.concatenate([m + b for m, b in zip(marks, base, strict=True)])
    left = np.concatenate([np.minimum(STRIDE, n - STRIDE * np.arange(len(m))) for (n, _, _), m in zip(blocks, marks, strict=True)])
    out = np.zeros((len(pos), STRIDE), np.uint16)
    order = np.argsort(-left, kind="stable")
    pos, sizes = pos[order], left[order]
    live = len(pos)
    for k in range(STRIDE):
        while live and sizes[live - 1] <= k:
            live = int(np.searchsorted(-sizes, -k, "left"))
        if not live:
            break
        p = pos[:live]
        i = p >> 3
        window = (data[i].astype(np.int64) << 16 | data[i + 1].astype(np.int64) << 8 | data[i + 2]) >> (8 - (p & 7)) & 0xFFFF
        out[order[:live], k] = symbol[window]
        p += length[window]
    flat, ends = out.reshape(-1), np.cumsum([len(m) for m in marks])
    return [flat[(e - len(m)) * STRIDE :][:n] for (n, _, _), m, e in zip(blocks, marks, ends, strict=True)]


def token_ids(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, row_key, n_tokens, ids, tally): the ids of each whole text and the end id, as little-endian uint16.

    The last row of each task has no ids but the counts of all its ids, as 65,536 little-endian int64.
    """
    end = np.array([end_id], "<u2").tobytes()
    names = [c.split()[0] for c in _IDS.split(", ")]

    def run(batches):
        cache = word_cache(path, spaced=True)
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            ids = [x + end for x in cache.encode(b.column(2).to_pylist())]
            if ids:
                total += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=1 << 16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row_key"), text_or_empty().alias("text")).mapInArrow(run, _IDS)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 0) -> None:
    """Writes the ids of docs (doc_id, text, ...) as files under ``out``, in ascending doc_id order (null first).

    ``out/codes`` holds the code length of each id; ``out/blocks/file=N`` the blocks, one a
    document, that can be decoded on their own: the bits, and bit offsets of every
    STRIDE-th id.  Null text is empty text, which is the end id alone; an empty table gives
    no blocks; rows that repeat an id follow each other in one file; other columns are not read.

    The driver gets one count per id of the vocabulary and one bound per file of FILE_BYTES
    (at 100 TB of ids 400,000 bounds, 3 MB); a text of any length is one block.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    ids = materialize(token_ids(docs, path, end_id), "ids")

    def tally(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    tallies = ids.where("tally is not null").select("tally").mapInArrow(tally, "id long, n long")
    for row in tallies.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    codes, _, _ = canonical(lengths)
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, length int").coalesce(1).write.mode("overwrite").parquet(f"{out}/codes")
    ids = ids.where("tally is null").drop("tally")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * int(counts.sum()) // FILE_BYTES))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)] or [0.5], 10 * files)).first()[0] or []
    bounds = np.array(sorted(set(cuts)), np.int64)

    def encode(batches):
        for b in batches:
            rows = [encode_block(np.frombuffer(x.as_buffer(), "<u2"), codes, lengths) for x in b.column("ids")]
            doc = b.column("doc_id")
            file = np.where(np.asarray(doc.is_null()), 0, np.searchsorted(bounds, np.asarray(doc.fill_null(0)), "left"))
            cols = [pa.array(file, pa.int32()), doc, b.column("row_key"), b.column("n_tokens"), pa.array([c for c, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _BLOCKS.split(", ")])

    blocks = ids.mapInArrow(encode, _BLOCKS).repartitionById(files, "file").sortWithinPartitions("file", "doc_id", "row_key")
    blocks.write.mode("overwrite").partitionBy("file").option("compression", "none").parquet(f"{out}/blocks")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Decodes the files of write_tokens: (file, doc_id, row_key, n_tokens, ids_crc32, ids), ids as little-endian uint32."""
    arrow_batches(spark)
    lengths = np.zeros(1 << 16, np.uint8)
    for row in spark.read.schema("id int, length int").parquet(f"{out}/codes").collect():  # at most 65,536 rows
        lengths[row["id"]] = row["length"]
    _, symbol, length = canonical(lengths)

    def decode(batches):
        for b in batches:
            n, marks, bits = (b.column(c).to_pylist() for c in ("n_tokens", "checkpoints", "bits"))
            ids = [x.astype("<u4").tobytes() for x in decode_blocks(list(zip(n, marks, bits, strict=True)), symbol, length)] if n else []
            cols = [*(b.column(c) for c in ("file", "doc_id", "row_key", "n_tokens")), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["file", "doc_id", "row_key", "n_tokens", "ids_crc32", "ids"])

    blocks = spark.read.schema("doc_id long, row_key long, n_tokens long, checkpoints binary, bits binary, file int").parquet(f"{out}/blocks")
    return blocks.mapInArrow(decode, "file int, doc_id long, row_key long, n_tokens long, ids_crc32 long, ids binary")


def index_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files: start counts the ids of all documents before.

    Running sums are made within a file; the files' totals (one row a file) give each its
    place.  Null ids come first; rows that repeat an id follow each other.
    """
    blocks = spark.read.schema("n_tokens long, file int").parquet(f"{out}/blocks")
    totals = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    place = totals.select("file", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    before = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1))
    rows = read_tokens(spark, out).drop("ids").withColumn("before", F.coalesce(before, F.lit(0)))
    return rows.join(place, "file").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
