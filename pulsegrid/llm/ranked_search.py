"""Ranked lexical search: documents grouped by the mask of an item's terms they hold."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, text_or_empty

#: Terms of items that are sent to the tasks at once.  More items are searched in slices of about so many.
SENT_TERMS = 500_000
BUCKETS = 4096
#: Documents and occurrences that a block holds in memory.
BLOCK_DOCS = 8192
BLOCK_HITS = 2_000_000
#: The value that stands for a null id in arrays; such rows carry a mark beside it.
_NULL = np.iinfo(np.int64).max

#: Bytes of UTF-8 to what they are read as: a to z for A to Z, a space for what is in no term.
_READ = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_READ).split(b" ") if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, slot, term) with each term of an item once; slot is a hash bucket of the item."""

    def run(batches):
        for b in batches:
            rows = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in sorted(set(terms_of(text)) - {b""})]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary())], ["item_id", "term"])

    found = items.select(F.col("item_id").cast("long"), text_or_empty()).mapInArrow(run, "item_id long, term binary")
    return found.distinct().withColumn("slot", F.pmod(F.xxhash64("item_id"), F.lit(BUCKETS)).cast("int"))


def slices_of(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Slots dealt to slices of at most ``most`` terms; a slot above it is a slice of its own."""
    out, left = [], 0
    for slot, n in sorted(sizes.items()):
        if n > left:
            out.append([])
            left = most
        out[-1].append(slot)
        left -= n
    return out


def occurrences(docs: DataFrame, asked: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term: all its terms counted, the asked ones by number."""

    def run(batches):
        for b in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = Counter(terms_of(text))
                seen.pop(b"", None)
                if seen:
                    hits = [(asked[t], seen[t]) for t in seen.keys() & asked.keys()]
                    ids.append(doc_id)
                    sizes.append(seen.total())
                    terms.append([t for t, _ in hits])
                    tfs.append([k for _, k in hits])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def weight(held: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * held + 2) / (2 * df + 1)))


class Best:
    """The best documents of an item so far: highest score first, then by id, null ids last."""

    def __init__(self, keep: int) -> None:
        self.keep = keep
        self.score, self.null, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def floor(self) -> int:
        """The score a further document must have at least."""
        return int(self.score[-1]) if len(self.score) == self.keep else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        some = score >= self.floor()
        score, null, ids = (np.concatenate(x) for x in ((self.score, score[some]), (self.null, null[some]), (self.id, ids[some])))
        order = np.lexsort((ids, null, -score))[: self.keep]
        self.score, self.null, self.id = score[order], null[order], ids[order]


class Block:
    """Documents of a task with their asked terms, sorted by term: for each, its documents and what an occurrence scores there."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, held: int, length: int) -> None:
        self.ids, self.null = ids, null
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[order], term[order], tf[order]
        m = 50 + (50 * n * held) // length
        self.gain = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc])
        have, first, many = np.unique(term, return_index=True, return_counts=True)
        self.span = {t: (a, a + k) for t, a, k in zip(have.tolist(), first.tolist(), many.tolist(), strict=True)}
        self.top = {t: int(self.gain[a:z].max()) for t, (a, z) in self.span.items()}

    def search(self, terms: list[int], weights: list[int], best: Best) -> int:
        """Adds to ``best`` what this block has for an item; returns how many documents were scored.

        Each document gets a mask with a bit for each term it holds.  Equal masks are one group,
        whose score is bounded by the sum of its terms' best scores in the block.  Groups are
        scored by falling bound until the next bound is below the score that is needed.
        """
        have = [(t, w) for t, w in zip(terms, weights, strict=True) if w and t in self.span]
        if sum(w * self.top[t] for t, w in have) < best.floor():
            return 0
        masks = np.zeros((len(self.ids), (len(have) + 63) // 64), np.uint64)
        for k, (t, _) in enumerate(have):
            a, z = self.span[t]
            masks[self.doc[a:z], k // 64] |= np.uint64(1 << (k % 64))
        order = np.lexsort(masks.T)
        rows = masks[order]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
        groups, end = rows[first], np.append(first[1:], len(rows))
        bound = np.zeros(len(groups), np.int64)
        for k, (t, w) in enumerate(have):
            bound += w * self.top[t] * ((groups[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64)
        ranked, at, scored = np.argsort(-bound, kind="stable"), 0, 0
        while at < len(ranked) and bound[ranked[at]] >= best.floor():
            take = max(1, best.keep)
            now, size = [], 0
            while at < len(ranked) and size < take and bound[ranked[at]] >= best.floor():  # enough groups to fill the list
                g = ranked[at]
                now.append(order[first[g] : end[g]])
                size += end[g] - first[g]
                at += 1
            docs = np.sort(np.concatenate(now))
            score = np.zeros(len(docs), np.int64)
            for t, w in have:
                a, z = self.span[t]
                k = np.searchsorted(self.doc[a:z], docs)
                hit = (k < z - a) & (self.doc[a:z][np.minimum(k, z - a - 1)] == docs)
                score[hit] += w * self.gain[a:z][k[hit]]
            best.add(score, self.null[docs], self.ids[docs])
            scored += len(docs)
        return scored


def blocks(batches, held: int, length: int):
    """Batches of occurrences gathered into blocks of bounded size."""
    parts, docs, hits = [], 0, 0

    def block():
        ids = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([p[3] for p in parts])
        return Block(ids, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), np.repeat(np.arange(len(ids)), sizes), np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts]), held, length)

    for b in batches:
        if not b.num_rows:
            continue
        ids, terms = b.column("doc_id"), b.column("terms")
        parts.append((np.asarray(ids.fill_null(_NULL)), np.asarray(ids.is_null()), np.asarray(b.column("n")), np.asarray(terms.value_lengths()), np.asarray(terms.flatten()), np.asarray(b.column("tf").flatten())))
        docs, hits = docs + b.num_rows, hits + len(parts[-1][4])
        if docs >= BLOCK_DOCS or hits >= BLOCK_HITS:
            yield block()
            parts, docs, hits = [], 0, 0
    if parts:
        yield block()


def search(docs: DataFrame, items: DataFrame, keep: int = 50) -> DataFrame:
    """The ``keep`` best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score.

    Terms, weights and scores are whole numbers as stated in the README.  Rows of one
    item_id, null included, are one item; every row of docs is a document, so repeated rows
    rank one after the other, and null ids rank after others of their score.  Null or empty
    text has no terms; items without a document above 0 have no rows; either table may be empty.

    Each task reads its documents once into (document, asked term, count) and writes that
    table; counts of all documents give the weights.  In a second pass every task keeps the
    best of its blocks for each item, and a window picks among those.  Pairs of documents and
    items stay inside a block.  Items go to the tasks in slices of ``SENT_TERMS`` terms, so
    neither the driver nor a task holds more of them at once.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    wanted = materialize(item_terms(items), "item_terms")
    sizes = {r["slot"]: r["n"] for r in wanted.groupBy("slot").agg(F.count("*").alias("n")).collect()}  # at most BUCKETS rows
    out = None
    for slots in slices_of(sizes, SENT_TERMS):
        rows = wanted.where(F.col("slot").isin(slots)).collect()  # about SENT_TERMS rows
        asked = {t: k for k, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        found = materialize(occurrences(docs, asked), "occurrences")
        total = found.agg(F.count("*").alias("held"), F.sum("n").alias("length")).first()
        held, length = total["held"], total["length"] or 1
        df = {r["t"]: r["df"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # a row an asked term
        of: dict[int | None, list[int]] = {}
        for r in rows:
            of.setdefault(r["item_id"], []).append(asked[bytes(r["term"])])
        plan = [(i, ts := sorted(t for t in of[i] if t in df), [weight(held, df[t]) for t in ts]) for i in sorted(of, key=lambda i: (i is None, i))]
        part = _ranked(found, plan, held, length, keep)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def _ranked(found: DataFrame, plan: list[tuple[int | None, list[int], list[int]]], held: int, length: int, keep: int) -> DataFrame:
    def run(batches):
        best = [Best(keep) for _ in plan]
        for block in blocks(batches, held, length):
            for (_, terms, weights), b in zip(plan, best, strict=True):
                block.search(terms, weights, b)
        for (item, *_), b in zip(plan, best, strict=True):
            if len(b.id):
                ids = pa.array(b.id, pa.int64(), mask=b.null)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), ids, pa.array(b.score)], ["item_id", "doc_id", "score"])

    best = found.mapInArrow(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("item_id", "rank", "doc_id", "score")
