"""Exact dedup: Grace hash deduplication over complete contents."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, fresh, materialize, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of distinct contents that a task keeps in its table; what is beyond goes to spill files.
TABLE_BYTES = 64 << 20
FAN_OUT = 16
_HEAD = struct.Struct("<qqq?I")

Row = tuple[int, bytes, int | None, int]  # hash, content, smallest id, rows


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the complete content does."""

    def __init__(self) -> None:
        self.mask = 1023
        self.slots = [-1] * 1024
        self.rows: list[list] = []
        self.bytes = 0

    def _slot(self, h: int, content: bytes) -> int:
        i = h & self.mask
        while (k := self.slots[i]) >= 0:
            row = self.rows[k]
            if row[0] == h and row[1] == content:
                break
            i = (i + 1) & self.mask
        return i

    def add(self, row: Row, grow: bool) -> bool:
        """Merges the row with an equal content, or takes it in if ``grow``; else False."""
        h, content, least, n = row
        i = self._slot(h, content)
        if (k := self.slots[i]) >= 0:
            have = self.rows[k]
            have[3] += n
            if least is not None and (have[2] is None or least < have[2]):
                have[2] = least
            return True
        if not grow:
            return False
        self.slots[i] = len(self.rows)
        self.rows.append([h, content, least, n])
        self.bytes += len(content) + 200
        if 2 * len(self.rows) > self.mask:
            self.mask = 4 * (self.mask + 1) - 1
            self.slots = [-1] * (self.mask + 1)
            for k, (h, *_) in enumerate(self.rows):
                i = h & self.mask
                while self.slots[i] >= 0:
                    i = (i + 1) & self.mask
                self.slots[i] = k
        return True


def _spill(path: str) -> Iterator[Row]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            h, least, n, null, size = _HEAD.unpack(head)
            yield h, f.read(size), None if null else least, n


def grace(rows: Iterable[Row], budget: int, folder: str, depth: int = 0) -> Iterator[list]:
    """One row per distinct content.  Contents beyond the budget go to spill files by the next
    bits of their hash, and each file is then handled the same way.  Every level settles at
    least one content, so this ends even when all hashes are equal."""
    table, files = ContentTable(), {}
    for row in rows:
        if not table.add(row, grow=not files and (table.bytes + len(row[1]) <= budget or not table.rows)):
            part = (row[0] >> (4 * (depth % 16))) & (FAN_OUT - 1)
            if part not in files:
                files[part] = tempfile.NamedTemporaryFile(dir=folder, delete=False)
            h, content, least, n = row
            files[part].write(_HEAD.pack(h, least or 0, n, least is None, len(content)) + content)
    yield from table.rows
    del table
    for f in files.values():
        f.close()
    for f in files.values():
        try:
            yield from grace(_spill(f.name), budget, folder, depth + 1)
        finally:
            os.unlink(f.name)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[Row]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _out(rows: Iterator[list], schema: pa.Schema, pick) -> Iterator[pa.RecordBatch]:
    keep, size = [], 0
    for row in rows:
        keep.append(pick(row))
        size += len(row[1])
        if len(keep) >= 1000 or size >= 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*keep, strict=True), schema, strict=True)], schema=schema)
            keep, size = [], 0
    if keep:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*keep, strict=True), schema, strict=True)], schema=schema)


_CONTENT = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("least", pa.int64()), ("n", pa.int64())])
_GROUP = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def groups_of(contents: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """(text_sha256, keep_id, group_size) for each distinct content of (h, content, least, n)."""

    def combine(batches):
        def merged():
            table = ContentTable()
            for row in _rows(batches):
                table.add(row, grow=True)
                if table.bytes > budget:
                    yield from table.rows
                    table = ContentTable()
            yield from table.rows

        yield from _out(merged(), _CONTENT, tuple)

    def settle(batches):
        with tempfile.TemporaryDirectory() as folder:
            yield from _out(grace(_rows(batches), budget, folder), _GROUP, lambda r: (hashlib.sha256(r[1]).hexdigest(), r[2], r[3]))

    first = contents.mapInArrow(combine, "h long, content binary, least long, n long")
    return first.repartition("h").mapInArrow(settle, "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """Groups of documents that are equal but for white space.

    docs: doc_id, text.  Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256.  Records are dealt by a hash of the normalised text.  Before that each task
    merges its own copies, so a text that a third of all rows share is one row a task; after
    it, each task merges what it got within ``budget`` bytes and spills the rest to files.

    Null text is empty text.  Null ids never win over others; a group of null ids only has a
    null keep_id.  Of rows repeating the id and the text of the row that stays, one is kept.
    An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    norm = docs.select("doc_id", F.regexp_replace(text_or_empty(), SPACE, " ").alias("t"))
    contents = norm.select(F.xxhash64("t").alias("h"), F.col("t").cast("binary").alias("content"), F.col("doc_id").cast("long").alias("least"), F.lit(1).cast("long").alias("n"))
    groups = groups_of(contents, budget)
    rows = norm.select("doc_id", F.sha2("t", 256).alias("text_sha256"))
    first = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("doc_id")) == 1
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first")
    return rows.withColumn("first", first).join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without copies: one row of each group of equal texts.

    Most copies go by their ids, a narrow table that Catalyst can broadcast while it is small.
    Only ids that are null or repeat are looked up by id and text.  Null text is empty text, and
    one empty text stays; other columns, whatever their names, are returned as they are; an
    empty table gives an empty result.
    """
    sha = F.sha2(F.regexp_replace(text_or_empty(), SPACE, " "), 256)
    decided = exact_dedup(docs.select("doc_id", "text"), budget).select("doc_id", "text_sha256", "kept")
    decided = materialize(decided, "decided")
    ids = decided.groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    gone = materialize(ids.where("doc_id is not null and not stays").select("doc_id"), "gone", 1)
    odd_id, key_id, key, mine = fresh(docs.columns, "odd_id", "key_id", "key", "sha")
    odd = materialize(ids.where("doc_id is null or (stays and n > 1)").select(F.col("doc_id").alias(odd_id)), "odd", 1)
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if odd.isEmpty():
        return left
    kept = decided.where("kept").select(F.col("doc_id").alias(key_id), F.col("text_sha256").alias(key))
    kept = kept.join(odd, F.col(key_id).eqNullSafe(F.col(odd_id))).drop(odd_id)
    again = left.withColumn(mine, sha).join(kept, F.col("doc_id").eqNullSafe(F.col(key_id)) & (F.col(mine) == F.col(key))).dropDuplicates([key_id, key])
    rest = left.join(odd, F.col("doc_id").eqNullSafe(F.col(odd_id)), "left_anti")
    return rest.unionByName(again.select(*docs.columns))
