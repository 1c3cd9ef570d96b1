"""N-gram Jaccard join: size-banded tiles, hashed bitmap bounds, exact intersections.

1. Each document becomes its set of shingles; equal sets are merged (one representative each).
2. Sets are put in one order: shingles that are frequent in the corpus last, the others by
   hash.  Two sets that link share a shingle among the first n - ceil(0.75 n) + 1 of each
   (prefix filtering), so the documents that share such a shingle form a tile.
3. In each tile the document of the smallest id is compared with the others: a number of pairs
   linear in the tile.  Components of these links merge large groups of near copies.
4. What is left are tiles with documents of different components.  Pairs of sizes in one band (a
   third apart at most) whose places and bitmaps allow enough overlap say which components may touch.
   Tiles of one smallest document share most of their documents, so they are compared together and
   a document's bitmap is sent once for all of them.
5. Each such component is a tile once more, cut into blocks, with the sorted shingles of its
   documents.  Documents of the others are compared with it, by bitmaps first and then exactly,
   until one link joins both components; only such links leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, connected_components, materialize
from .shingles import mix64, shingle_sets

#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A shingle is frequent if it makes up this share of all shingles (and FREQUENT_LEAST documents); so at most 1 / share are.
FREQUENT_SHARE = 4e-6
FREQUENT_LEAST = 64
#: Shingles counted at once in a task; those seen in fewer than LOCAL_LEAST documents of these are not reported.
LOCAL_SHINGLES = 2_000_000
LOCAL_LEAST = 3
#: Bits an element in wide bitmaps.
WIDE = 8
#: Documents in a block of a tile, and shingles in a block of a component.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Pairs of tiles with one smallest document that are compared together, and pairs whose bitmaps are compared at once.
CELL_PAIRS, PAIRS_AT_ONCE = 1 << 21, 1 << 20
#: Bits of the map of copies: 2 MB, whatever the input.
COPY_SLOTS = 1 << 24
#: Rows and bytes of whole tiles handled together.
TILE_ROWS, TILE_BYTES = 20_000, 32 << 20


def need(n):
    """The least overlap of a set of n with any set it links with."""
    return (PERCENT * n + 99) // 100


def need_both(na, nb):
    """The least overlap of two sets of these sizes that link."""
    return (PERCENT * (na + nb) + 99 + PERCENT) // (100 + PERCENT)


def bitmap_of(s: np.ndarray, room: int = 2) -> bytes:
    """A bitmap with the hashed bits of a set; its width, a power of two of ``room`` bits an element, is the set's size band."""
    bits = max(64, 1 << int(room * len(s) - 1).bit_length()) if len(s) else 64
    out = np.zeros(bits, np.uint8)
    out[(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _matrix(maps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)


def _fold(m: np.ndarray, width: int) -> np.ndarray:
    while m.shape[1] > width:
        # bit positions are hash & (bits - 1), so halves fold onto each other
        m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
    return m


def may_link(na: np.ndarray, a: list[bytes], nb: np.ndarray, b: list[bytes]) -> np.ndarray:
    """For pairs of sets, False where sizes or bitmaps rule out a link.

    Each bit of one bitmap that the other lacks stands for an element the other lacks, so
    the overlap is at most the size less these bits.
    """
    ok = (need(np.maximum(na, nb)) <= np.minimum(na, nb)).astype(bool)
    widths = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for wa, wb in np.unique(widths[ok], axis=0) if ok.any() else ():
        all_ = np.flatnonzero(ok & (widths[:, 0] == wa) & (widths[:, 1] == wb))
        step = max(1, (4 << 20) // int(max(wa, wb)))
        for at in np.split(all_, range(step, len(all_), step)):
            width = min(wa, wb) // 8
            x, y = _fold(_matrix([a[i] for i in at]), width), _fold(_matrix([b[i] for i in at]), width)
            only_x = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
            only_y = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
            most = np.minimum(na[at] - only_x, nb[at] - only_y)
            ok[at] = 100 * most >= PERCENT * (na[at] + nb[at] - most)
    return ok


def _batch(cols: Iterable, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], list(names))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the frequent shingles, at most 1 / FREQUENT_SHARE of them.

    Tasks report shingles that several of their documents hold.  The order of shingles
    only steers how much work there is, so what they leave out never changes a result.
    """
    schema = "token long, n long"

    def local(batches):
        held, size, total = [], 0, 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return _batch((token[n >= LOCAL_LEAST].view(np.int64), n[n >= LOCAL_LEAST]), schema)

        for b in batches:
            held += shingle_sets(b.column(0))
            size = sum(map(len, held))
            total += sum(map(len, held[-b.num_rows :]))
            if size >= LOCAL_SHINGLES:
                yield flush()
                held = []
        if held:
            yield flush()
        yield _batch(([None], [total]), schema)

    counts = materialize(docs.select("text").mapInArrow(local, schema).groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    total = counts.where("token is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(FREQUENT_LEAST, FREQUENT_SHARE * total)
    # counts of distinct shingles that sum to at most ``total``: no more than 1 / FREQUENT_SHARE reach ``least``
    rows = counts.where(f"token is not null and n >= {least!r}").select("token").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, k1, k2, prefix, bitmap): size, 128-bit key, first shingles in the common order, bitmap."""
    schema = "doc_id long, n long, k1 long, k2 long, prefix array<long>, bitmap binary"

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1))
            k1, k2, prefix, maps = [], [], [], []
            for s in sets:
                k1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                if len(frequent) and len(s):
                    hot = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    ordered = np.concatenate([s[~hot], s[hot]])
                else:
                    ordered = s
                prefix.append(ordered[: len(s) - need(len(s)) + 1 if len(s) else 0].view(np.int64))
                maps.append(bitmap_of(s))
            yield _batch((b.column(0), [len(s) for s in sets], k1, k2, prefix, maps), schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def without_copies(named: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of named (doc_id, k1, k2, ...) that are not in copies.

    Prefixes are wide, so only rows whose hashed id falls on that of a copy take part in the
    join.  More copies than the map of bits has room for only send more rows to the join.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SLOTS))
    part, bit = F.shiftright(slot, 15), slot.bitwiseAND(32767)
    bits = np.zeros(-(-COPY_SLOTS // 32768) * 4096, np.uint8)
    for at, found in copies.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect():
        bits[at * 4096 : (at + 1) * 4096] = np.frombuffer(found, np.uint8)

    @F.pandas_udf("boolean")
    def marked(slots: pd.Series) -> pd.Series:
        s = slots.to_numpy()
        return pd.Series((bits[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool))

    named = named.withColumn("marked", marked(slot))
    return named.where("not marked").unionByName(named.where("marked").join(copies, ["doc_id", "k1", "k2"], "left_anti")).drop("marked")


def _both(pairs: DataFrame, side: DataFrame, *cols: str) -> DataFrame:
    """Adds the columns of side (doc_id, ...) for a and for b."""
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("doc_id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in cols)), end)
    return pairs


def _exact(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole texts."""
    pairs = materialize(pairs, "pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids", 1)
    # Catalyst broadcasts the ids if their table is small, and else shuffles the texts once
    texts = materialize(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "texts")

    def run(batches):
        for b in batches:
            sa, sb = shingle_sets(b.column("text_a")), shingle_sets(b.column("text_b"))
            ok = []
            for x, y in zip(sa, sb, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both) > 0)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialize(_both(pairs, texts, "text").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")


def star_pairs(index: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs of each tile's smallest document with the others, where sizes, places and bitmaps allow a link."""
    least = F.ceil(PERCENT * (F.col("n") + F.col("lead.n")) / (100 + PERCENT))
    near = (F.col("doc") != F.col("lead.doc")) & (F.col("n") - F.col("pos") >= least) & (F.col("lead.n") - F.col("lead.pos") >= least)
    pairs = index.where(near).select(F.col("lead.doc").alias("a"), F.col("doc").alias("b")).distinct()

    def run(batches):
        for b in batches:
            na, nb = (np.asarray(b.column(c)) for c in ("n_a", "n_b"))
            ok = may_link(na, b.column("bitmap_a").to_pylist(), nb, b.column("bitmap_b").to_pylist())
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return _both(pairs, sigs, "n", "bitmap").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(run, "a long, b long")


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Cuts a stream sorted by keys into tables of whole groups, of about TILE_ROWS rows or TILE_BYTES bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= TILE_ROWS or sum(x.nbytes for x in held) >= TILE_BYTES:
            t = pa.Table.from_batches(held)
            k = np.stack([np.asarray(t.column(c)) for c in keys], axis=1)
            new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
            if len(new):
                cut = int(new[-1]) + 1
                yield t.slice(0, cut)
                held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def touching(index: DataFrame, components: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs of components (a, b) with documents in one tile whose sizes, places and bitmaps allow a link.

    If a pair links, its first common shingle leaves both sets enough elements behind it, so
    a tile only needs pairs for which this holds.  Of tiles with the same documents the one
    whose shingle stands first in them is enough.
    """
    tile = Window.partitionBy("token")
    label = F.coalesce("component", F.col("doc"))
    member = index.select("token", "doc", "n", "pos", F.col("lead.doc").alias("lead")).join(components.withColumnRenamed("id", "doc"), "doc", "left")
    member = member.select("token", "doc", "n", "pos", "lead", label.alias("label"))
    by_size = tile.orderBy("n", "doc")
    member = member.withColumns({"lo": F.min("label").over(tile), "hi": F.max("label").over(tile), "below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)})
    member = member.where(f"lo <> hi and (100 * below >= {PERCENT} * n or 100 * n >= {PERCENT} * above)").drop("lo", "hi", "below", "above")
    member = materialize(member, "members")
    h = F.xxhash64("doc")
    tiles = member.groupBy("token").agg(F.bit_xor(h).alias("k1"), F.sum(F.shiftright(h, 24)).alias("k2"), F.count("*").alias("size"), F.sum("pos").alias("at"), F.min("lead").alias("lead"))
    tiles = tiles.groupBy("k1", "k2", "size").agg(F.min(F.struct("at", "token", "lead")).alias("t")).where("size > 1").select("t.token", "t.lead", "size")
    parts = F.ceil(F.sum(F.col("size") * F.least("size", F.lit(BLOCK))).over(Window.partitionBy("lead")) / CELL_PAIRS)
    tiles = tiles.select("token", "size", F.pmod(F.xxhash64("token"), parts).cast("long").alias("part"))
    cells = cells_of(member, tiles, sigs)
    return cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(compare_cells, "a long, b long").distinct()


#: What names a cell: smallest document, part of its tiles, and two blocks of their documents.
CELL = ("lead", "part", "i", "j")


def cells_of(member: DataFrame, tiles: DataFrame, sigs: DataFrame) -> DataFrame:
    """One row for each cell and document, with its bitmap and its places in the tiles (token, size, part) of the cell."""
    blocks = F.ceil(F.col("size") / BLOCK)
    mine = F.pmod(F.xxhash64("doc"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = member.join(tiles, "token").select("token", "doc", "n", "pos", "label", "lead", "part", mine.cast("long").alias("block"), other.alias("other"))
    dealt = dealt.select("lead", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "n", "label", F.struct("token", "pos").alias("place"))
    rows = dealt.repartition("doc").groupBy(*CELL, "block", "doc", "n", "label").agg(F.collect_list("place").alias("places"))
    rows = rows.join(sigs.select(F.col("doc_id").alias("doc"), "bitmap"), "doc")
    return rows.select(*CELL, "block", "doc", "n", "label", F.col("places.token").alias("tokens"), F.col("places.pos").alias("pos"), "bitmap")


def compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of components (a, b) with documents in one tile of a cell that may link; batches are sorted by cell."""
    for t in whole_tiles(batches, CELL):
        t = t.combine_chunks()
        lead, part, i, j, block, doc, n, label = (np.asarray(t.column(c)) for c in (*CELL, "block", "doc", "n", "label"))
        maps = t.column("bitmap").to_pylist()
        cell = np.cumsum(np.concatenate([[0], (lead[1:] != lead[:-1]) | (part[1:] != part[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        token, pos = (np.asarray(pc.list_flatten(t.column(c))) for c in ("tokens", "pos"))
        row = np.repeat(np.arange(len(doc)), np.asarray(pc.list_value_length(t.column("tokens"))))
        order = np.lexsort((token, cell[row]))
        token, pos, row = token[order], pos[order], row[order]
        group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (cell[row[1:]] != cell[row[:-1]])]))
        found: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def compare() -> None:
            # documents meet in many tiles of a cell, and are compared once
            x, y = np.divmod(np.unique(np.concatenate(held)), len(doc))
            ok = may_link(n[x], [maps[k] for k in x], n[y], [maps[k] for k in y])
            x, y = label[x[ok]], label[y[ok]]
            found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
            held.clear()

        at = np.arange(len(row))
        for d in range(1, len(row)):
            at = at[: np.searchsorted(at, len(row) - d)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            x, y = row[at], row[at + d]
            least = need_both(n[x], n[y])
            ok = (doc[x] != doc[y]) & (label[x] != label[y]) & ((i[x] == j[x]) | (block[x] != block[y])) & (n[x] - pos[at] >= least) & (n[y] - pos[at + d] >= least)
            held.append(np.minimum(x, y)[ok] * len(doc) + np.maximum(x, y)[ok])
            if sum(map(len, held)) >= PAIRS_AT_ONCE:
                compare()
        if held:
            compare()
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield _batch((pairs[:, 0], pairs[:, 1]), "a long, b long")


def shingled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, n, bitmap, shingles) with wide bitmaps and sorted shingles for the documents of ids (doc)."""
    schema = "doc long, n long, bitmap binary, shingles array<long>"

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1))
            yield _batch((b.column(0), [len(s) for s in sets], [bitmap_of(s, WIDE) for s in sets], [s.view(np.int64) for s in sets]), schema)

    return docs.join(ids, docs["doc_id"] == ids["doc"], "left_semi").select("doc_id", "text").mapInArrow(run, schema)


class Block:
    """Documents of one component: bitmaps and sorted shingles by document."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.n: list[int] = []
        self.bits: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.joined: set[int] = set()  # components that a link has joined to this one
        self.sizes: np.ndarray | None = None

    def link(self, doc: int, n: int, bits: bytes, s: np.ndarray) -> int | None:
        """A document of the block that the given one links with, if any."""
        have = self.sizes = np.array(self.n) if self.sizes is None else self.sizes
        near = np.flatnonzero(need(np.maximum(have, n)) <= np.minimum(have, n))
        for at in np.split(near, range(64, len(near), 64)):
            ok = at[may_link(have[at], [self.bits[x] for x in at], np.full(len(at), n), [bits] * len(at))]
            for x in ok:
                both = len(np.intersect1d(self.sets[x], s, assume_unique=True))
                if self.doc[x] != doc and 100 * both >= PERCENT * (n + self.n[x] - both):
                    return self.doc[x]
        return None


def joining_links(touch: DataFrame, components: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between documents of touching components, one for each block and component that joins it.

    The larger component of each pair is a tile: its documents stand in blocks, and the
    documents of the smaller ones ask every block, until one of them links.
    """
    touch = materialize(touch, "touching")
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    for end in ("a", "b"):
        touch = touch.join(sizes.select(F.col("component").alias(end), F.col("size").alias(f"size_{end}")), end, "left").fillna(1, [f"size_{end}"])
    swap = F.col("size_b") > F.col("size_a")
    touch = materialize(touch.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("tile"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("asker")), "tiles")

    def members(rows: DataFrame, of: str) -> DataFrame:
        inside = rows.join(components.withColumnRenamed("component", of), of, "left")
        return inside.withColumn("doc", F.coalesce("id", of)).drop("id")

    held = materialize(members(touch.select("tile").distinct(), "tile").select("tile", "doc"), "held")
    asks = materialize(members(touch, "asker").select("tile", "asker", "doc"), "asks")
    ids = materialize(held.select("doc").unionByName(asks.select("doc")).distinct(), "ids", 1)
    sets = materialize(shingled(docs, ids), "shingled")
    held = held.join(sets, "doc")
    blocks = held.groupBy("tile").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK)).alias("blocks"))
    blocks = materialize(blocks, "blocks")
    held = held.join(blocks, "tile").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("long")).withColumn("asker", F.lit(None).cast("long"))
    asks = asks.join(blocks, "tile").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(sets, "doc")
    cols = ("tile", "block", "asker", "doc", "n", "bitmap", "shingles")

    def run(batches):
        now, block = None, Block()
        for b in batches:
            found: list[tuple[int, int]] = []
            tile, at, asker, doc, n, bits = (b.column(c).to_pylist() for c in cols[:-1])
            sets = b.column("shingles")
            for k in range(b.num_rows):
                if (tile[k], at[k]) != now:
                    now, block = (tile[k], at[k]), Block()
                s = np.asarray(sets[k].values).view(np.uint64)
                if asker[k] is None:
                    block.doc.append(doc[k])
                    block.n.append(n[k])
                    block.bits.append(bits[k])
                    block.sets.append(s)
                elif asker[k] not in block.joined and block.doc:
                    other = block.link(doc[k], n[k], bits[k], s)
                    if other is not None:
                        block.joined.add(asker[k])
                        found.append((min(other, doc[k]), max(other, doc[k])))
            if found:
                yield _batch(zip(*found, strict=True), "a long, b long")

    dealt = held.select(*cols).unionByName(asks.select(*cols)).repartition("tile", "block").sortWithinPartitions("tile", "block", F.col("asker").asc_nulls_first(), "doc")
    return materialize(dealt.mapInArrow(run, "a long, b long"), "links")


def jaccard_components(docs: DataFrame, checked: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Near-duplicate components of documents (doc_id, text, ...) by 5-word shingles.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable
    by links, itself included).  Shingles are compared by 64-bit hashes.  Null and blank texts have
    no shingles and stand alone.  Rows without doc_id stand alone and have a null component; rows
    of one doc_id count as one document with several texts.  Other columns are not read; texts of
    any length are compared whole; an empty table gives an empty result.
    ``checked`` gets the table of verified links, for tests.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sigs = materialize(signatures(docs, frequent_shingles(docs)), "signatures")
    named = sigs.where("n > 0 and doc_id is not null")
    sets = named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    copies = named.select("doc_id", "k1", "k2", "n").join(materialize(sets, "sets"), ["k1", "k2", "n"]).where("doc_id <> rep")
    copies = materialize(copies.select("doc_id", "rep", "k1", "k2").distinct(), "copies")
    reps = without_copies(named.select("doc_id", "n", "k1", "k2", "prefix"), copies.select("doc_id", "k1", "k2"))
    # an id with several texts may link with others by each of them
    several = named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    several = copies.join(materialize(several, "several"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    rep_of = copies.groupBy("doc_id").agg(F.min("rep").alias("rep"))

    tile = Window.partitionBy("token")
    tokens = reps.select(F.posexplode("prefix").alias("pos", "token"), F.col("doc_id").alias("doc"), "n")
    index = tokens.withColumns({"size": F.count("*").over(tile), "lead": F.min(F.struct("doc", "n", "pos")).over(tile)}).where("size > 1")
    index = materialize(index.select("token", "doc", "n", "pos", "lead"), "index")
    links = _exact(star_pairs(index, sigs), docs)
    near = materialize(connected_components(links.unionByName(several)), "components")
    more = joining_links(touching(index, near, sigs), near, docs)
    if checked:
        checked(links.unionByName(more))
    if not more.isEmpty():
        near = connected_components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles")).join(rep_of, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(near.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that represent their component: those of the smallest id, and rows without id.

    Null and blank texts stand alone and stay, and so do rows that repeat the id of a row that
    stays; all columns of docs are returned as they are; an empty table stays empty.
    """
    gone = jaccard_components(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(materialize(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)
