"""Connected parts of pixel tables (image, x, y), and the area of an image that holds its waveform.

Nothing gathers an image: runs and touching pixels are windows over rows and columns, parts are
found inside tiles of bounded size and by star contraction over the edges between tiles, and areas are aggregates over runs and parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions.columns import r6
from ..sources.scratch import Steps, written

#: Runs are named by their first pixel: row, then column, in one long.
_ROW = 1 << 32
#: Runs that begin in one square of 2 ** TILE_BITS rows and columns are joined in one task; tiles are taken together up to about TILE_EDGES edges.
TILE_BITS = 8
TILE_EDGES = 200_000


def pixel_runs(pixels: DataFrame) -> DataFrame:
    """Each marked pixel once, with the run of its row that it is in: image, x, y, node."""
    marked = pixels.select("image", F.col("x").cast("long"), F.col("y").cast("long")).distinct()
    order = Window.partitionBy("image", "y").orderBy("x")
    step = marked.withColumn("start", F.when(F.coalesce(F.col("x") - F.lag("x").over(order) != 1, F.lit(True)), F.col("x")))
    return step.select("image", "x", "y", (F.col("y") * F.lit(_ROW) + F.last("start", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("node"))


def touching_runs(marked: DataFrame) -> DataFrame:
    """Runs of neighbouring rows that share a column: image, a, b.  Neighbours are found down each column, so no two runs are compared."""
    order = Window.partitionBy("image", "x").orderBy("y")
    under = marked.select("image", F.col("node").alias("a"), "y", F.lead("y").over(order).alias("next"), F.lead("node").over(order).alias("b"))
    return under.where("next = y + 1").select("image", "a", "b").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(image, node, part) for each node on an edge (image, a, b): part is the least node that it reaches.

    Alternating stars: a node's larger neighbours are tied to the least node beside it, then
    its smaller ones are, until every node is tied to the least of its part.  The number of rounds grows
    with the logarithm of the longest path; each is two aggregates and two joins by (image, node).
    """
    steps = Steps("stars")
    tied = steps.write(edges.where("a <> b").select("image", F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(rounds):
        now = tied.agg(F.count("*"), F.sum(F.xxhash64("image", "hi", "lo").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        ends = tied.union(tied.select("image", F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = ends.groupBy("image", "hi").agg(F.least(F.min("lo"), F.col("hi")).alias("root"))
        wide = ends.join(least, ["image", "hi"]).where("lo > hi AND lo <> root").select("image", F.col("lo").alias("hi"), F.col("root").alias("lo")).distinct()
        least = wide.groupBy("image", "hi").agg(F.min("lo").alias("root"))
        pairs = F.explode(F.array(F.struct("hi", F.col("root").alias("lo")), F.struct(F.greatest("lo", "root").alias("hi"), F.least("lo", "root").alias("lo"))))
        tied = steps.write(wide.join(least, ["image", "hi"]).select("image", pairs.alias("e")).select("image", "e.hi", "e.lo").where("hi <> lo").distinct())
    else:
        raise RuntimeError("the parts did not settle")
    roots = tied.select("image", F.col("lo").alias("node"), F.col("lo").alias("part")).distinct()
    return tied.groupBy("image", F.col("hi").alias("node")).agg(F.min("lo").alias("part")).unionByName(roots)


def connected_in_tiles(edges: DataFrame) -> DataFrame:
    """``connected`` for runs (image, a, b) named by their first pixel: first inside tiles, then between the least runs of tiles.

    Tiles stream through a task one after the other, and none has more runs than pixels.  Edges between
    tiles are the only ones that take rounds; where images are smaller than a tile there are none.
    """
    edges = written(edges, "touching")
    place = lambda c: (F.shiftright(c, 32 + TILE_BITS), F.shiftright(F.col(c).bitwiseAND(F.lit(_ROW - 1)), TILE_BITS))
    (ya, xa), (yb, xb) = place("a"), place("b")
    inside = (ya == yb) & (xa == xb)
    pair = lambda a, b, y, x: F.struct(y.alias("ty"), x.alias("tx"), F.col(a).alias("a"), F.col(b).alias("b"))
    rows = edges.select("image", F.explode(F.when(inside, F.array(pair("a", "b", ya, xa))).otherwise(F.array(pair("a", "a", ya, xa), pair("b", "b", yb, xb)))).alias("e")).select("image", "e.*")
    image = edges.schema["image"]
    schema = StructType([image]).add("node", LongType()).add("root", LongType())

    def joined(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        a, b, tile = t["a"].to_numpy(), t["b"].to_numpy(), np.cumsum(new)
        node, of = np.concatenate([a, b]), np.concatenate([tile, tile])
        order = np.lexsort((node, of))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(node[order]) != 0) | (np.diff(of[order]) != 0)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(first) - 1
        i, j, least = at[: len(a)], at[len(a) :], np.arange(int(first.sum()))
        while (least[i] != least[j]).any():
            low, high = np.minimum(least[i], least[j]), np.maximum(least[i], least[j])
            np.minimum.at(least, high, low)
            while (least[least] != least).any():
                least = least[least]
        nodes = node[order[first]]
        return pa.RecordBatch.from_arrays([t["image"].combine_chunks().take(pa.array(order[first] % len(a))), pa.array(nodes), pa.array(nodes[least])], ["image", "node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def starts(t: pa.Table) -> np.ndarray:
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([pc.not_equal(t[c].slice(1), t[c].slice(0, t.num_rows - 1)).to_numpy() for c in ("image", "ty", "tx")], axis=0)
            return new

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= TILE_EDGES:
                t = pa.Table.from_batches(held).combine_chunks()
                new = starts(t)
                cut = int(np.flatnonzero(new)[-1])
                if cut:
                    yield joined(t.slice(0, cut), new[:cut])
                    held = t.slice(cut).to_batches()
        t = pa.Table.from_batches([h for h in held if h.num_rows]).combine_chunks() if any(h.num_rows for h in held) else None
        if t is not None:
            yield joined(t, starts(t))

    tiles = rows.repartition("image", "ty", "tx").sortWithinPartitions("image", "ty", "tx").select("image", "ty", "tx", "a", "b")
    local = written(tiles.mapInArrow(run, schema), "tiles")
    across = edges.where(~inside)
    if across.isEmpty():
        return local.withColumnRenamed("root", "part")
    for end in ("a", "b"):
        across = across.join(local.withColumnRenamed("node", end), ["image", end]).drop(end).withColumnRenamed("root", end)
    parts = connected(across).withColumnRenamed("node", "root")
    return local.join(parts, ["image", "root"], "left").select("image", "node", F.coalesce("part", "root").alias("part"))


def labelled_runs(pixels: DataFrame) -> DataFrame:
    """Runs with the part that they are in: image, y, x_min, x_max, pixels, part.  Pixels are neighbours left, right, up and down.

    Rows with a null are left out; repeated pixels count once; an empty table has no runs.
    """
    marked = written(pixel_runs(pixels.dropna(subset=["image", "x", "y"])), "runs")
    runs = marked.groupBy("image", "y", "node").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.count("*").alias("pixels"))
    return runs.join(connected_in_tiles(touching_runs(marked)), ["image", "node"], "left").select("image", "y", "x_min", "x_max", "pixels", F.coalesce("part", "node").alias("part"))


def _figures(runs: DataFrame, *by: str) -> DataFrame:
    """Box (ends exclusive), pixels, mean row and deviation of rows of groups of runs; sums are of whole numbers."""
    n, s1, s2 = F.sum("pixels"), F.sum(F.col("pixels") * F.col("y")), F.sum(F.col("pixels") * F.col("y") * F.col("y"))
    box = runs.groupBy(*by).agg(
        F.min("x_min").alias("x_min"), (F.max("x_max") + 1).alias("x_max"), F.min("y").alias("y_min"), (F.max("y") + 1).alias("y_max"),
        n.alias("pixels"), (s1 / n).alias("y_center"), (F.sqrt((n * s2 - s1 * s1).cast("double")) / n).alias("vertical_std"),
    )
    return box.withColumns({"x_span": F.col("x_max") - F.col("x_min"), "y_span": F.col("y_max") - F.col("y_min")})


def components(pixels: DataFrame) -> DataFrame:
    """Connected parts of each image: image, part (its first pixel as column and row), box, pixels, mean row, deviation of rows."""
    parts = _figures(labelled_runs(pixels), "image", "part")
    first = F.pmod("part", F.lit(_ROW))
    return parts.select("image", first.alias("first_x"), F.floor(F.col("part") / _ROW).alias("first_y"), "x_min", "x_max", "y_min", "y_max", "pixels", r6("y_center").alias("y_center"), r6("vertical_std").alias("vertical_std"))


def _whole(x: Column) -> Column:
    return F.floor(x + 1e-9)


def _trace_parts(runs: DataFrame, sizes: DataFrame, least_share: float, least_span: int) -> DataFrame:
    """Parts that can be a trace: enough pixels, wide, and not a straight line; with a score for wide, rich and lively ones."""
    parts = _figures(runs, "image", "part").join(sizes, "image")
    fair = (F.col("pixels") >= 12) & (F.col("x_span") >= F.greatest(F.lit(least_span), _whole(F.col("width") * least_share))) & (F.col("vertical_std") >= F.greatest(F.lit(1.5), F.col("height") * 0.006))
    score = F.col("x_span") * F.sqrt("pixels") * F.greatest(F.lit(1.0), "vertical_std") / F.greatest(F.lit(1.0), F.sqrt("y_span"))
    return parts.where(fair).withColumn("score", score)


def row_bands(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bands of rows with many pixels, widened up and down: image, box, pixels, y_center, score, and the size of the image."""
    rows = runs.groupBy("image", "y").agg(F.sum("pixels").alias("n")).join(sizes, "image").where(F.col("n") >= F.greatest(F.lit(2), _whole(F.col("width") * 0.006)))
    reach = F.greatest(F.lit(2), _whole(F.col("height") * 0.015))
    wide = rows.select("image", "height", F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - reach), F.least(F.col("height") - 1, F.col("y") + reach))).alias("y")).distinct()
    order = Window.partitionBy("image").orderBy("y")
    named = wide.withColumn("band", F.col("y") - F.row_number().over(order))
    edges = named.groupBy("image", "band").agg(F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"))
    inside = runs.join(named.select("image", "y", "band"), ["image", "y"])
    found = inside.groupBy("image", "band").agg(F.min("x_min").alias("x_min"), (F.max("x_max") + 1).alias("x_max"), F.sum("pixels").alias("pixels")).join(edges, ["image", "band"]).join(sizes, "image")
    span, tall = F.col("x_max") - F.col("x_min"), F.col("bottom") - F.col("top")
    fair = (tall >= F.greatest(F.lit(3), _whole(F.col("height") * 0.015))) & (F.col("pixels") >= 10) & (span >= F.greatest(F.lit(20), _whole(F.col("width") * 0.08)))
    score = span * F.sqrt("pixels") / F.greatest(F.lit(1.0), F.sqrt(tall))
    return found.where(fair).select("image", "x_min", "x_max", F.col("top").alias("y_min"), F.col("bottom").alias("y_max"), "pixels", ((F.col("top") + F.col("bottom")) / 2).alias("y_center"), score.alias("score"), "width", "height")


def _chosen(candidates: DataFrame, policy: str, share: float) -> DataFrame:
    """One candidate an image: the topmost, the best scored, or the lowest among those with ``share`` of the best score."""
    rank = {"top": [F.asc("y_center")], "largest": [F.desc("score")], "bottom": [F.desc("fair"), F.desc("y_center"), F.desc("score")]}[policy]
    whole = Window.partitionBy("image")
    rows = candidates.withColumn("fair", F.col("score") >= share * F.max("score").over(whole))
    order = whole.orderBy(*rank, "y_min", "x_min", "x_max", "pixels")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "fair")


def image_sizes(pixels: DataFrame) -> DataFrame:
    """Width and height up to the last marked pixel, where the size of the image is not known."""
    return pixels.groupBy("image").agg((F.max("x").cast("long") + 1).alias("width"), (F.max("y").cast("long") + 1).alias("height"))


def waveform_area(pixels: DataFrame, sizes: DataFrame | None = None, policy: str = "bottom", pad: int = 4) -> DataFrame:
    """The area of each image with its waveform: box (ends exclusive, widened by ``pad``), how it was found, and shares of pixels.

    mode ``components``: the parts in the panel of the part that ``policy`` (bottom, top,
    largest) chooses.  Images without a part that can be a trace get the chosen band of rows
    (``row_band``), else the box of all pixels (``all``).  sizes: image, width, height;
    images without pixels have no row.  Equal candidates: the upper, then the left one.
    """
    sizes = (image_sizes(pixels) if sizes is None else sizes).select("image", F.col("width").cast("long"), F.col("height").cast("long"))
    runs = written(labelled_runs(pixels), "labelled")
    parts = _trace_parts(runs, sizes, 0.12, 30)
    margin = F.greatest(F.lit(8), _whole(F.col("height") * 0.08))
    panel = _chosen(parts, policy, 0.25).select("image", F.greatest(F.lit(0), F.col("y_min") - margin).alias("top"), F.least("height", F.col("y_max") + margin).alias("bottom"))
    shared = F.greatest(F.lit(0), F.least("bottom", "y_max") - F.greatest("top", "y_min"))
    same = F.col("y_center").between(F.col("top"), F.col("bottom")) | (shared >= F.greatest(F.lit(3), _whole(0.15 * F.col("y_span"))))
    merged = parts.join(panel, "image").groupBy("image").agg(F.count("*").alias("candidates"), F.count_if(same).alias("merged"), *[f(F.when(same, F.col(c))).alias(c) for c, f in (("x_min", F.min), ("x_max", F.max), ("y_min", F.min), ("y_max", F.max))], F.sum(F.when(same, F.col("pixels"))).alias("own"))
    box = ["image", "mode", "candidates", "merged", "x_min", "x_max", "y_min", "y_max", "own"]
    first = merged.withColumn("mode", F.lit("components")).select(*box)
    bands = row_bands(runs.join(first.select("image"), "image", "left_anti"), sizes)
    band = _chosen(bands, policy, 0.35).join(bands.groupBy("image").agg(F.count("*").alias("candidates")), "image")
    second = band.withColumns({"mode": F.lit("row_band"), "merged": F.lit(1).cast("long"), "own": F.lit(None).cast("long")}).select(*box)
    whole = _figures(runs, "image").withColumns({"mode": F.lit("all"), "candidates": F.lit(0).cast("long"), "merged": F.lit(0).cast("long"), "own": F.lit(None).cast("long")}).select(*box)
    found = first.unionByName(second)
    found = found.unionByName(whole.join(found.select("image"), "image", "left_anti")).join(sizes, "image")
    padded = found.withColumns({"x_min": F.greatest(F.lit(0), F.col("x_min") - pad), "x_max": F.least("width", F.col("x_max") + pad), "y_min": F.greatest(F.lit(0), F.col("y_min") - pad), "y_max": F.least("height", F.col("y_max") + pad)})
    # the pixels of a band or of all are those inside the box; of components, their own
    cut = F.least(F.col("r.x_max"), F.col("b.x_max") - 1) - F.greatest(F.col("r.x_min"), F.col("b.x_min")) + 1
    there = (F.col("r.y") >= F.col("b.y_min")) & (F.col("r.y") < F.col("b.y_max")) & (cut > 0)
    counts = runs.alias("r").join(padded.alias("b"), "image").groupBy("image").agg(F.sum("pixels").alias("marked"), F.coalesce(F.sum(F.when(there, cut)), F.lit(0)).alias("inside"))
    area = F.col("width") * F.col("height")
    return padded.join(counts, "image").select(
        "image", "mode", "candidates", "merged", "x_min", "x_max", "y_min", "y_max",
        r6(F.col("marked") / area).alias("marked_share"), r6(F.coalesce("own", "inside") / area).alias("selected_share"), r6((F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min")) / area).alias("area_share"),
    )


def waveform_areas(pixels: DataFrame, sizes: DataFrame | None = None, pad: int = 4, least_share: float = 0.08) -> DataFrame:
    """Every panel of each image from top to bottom: image, panel, parts, box, pixels.

    Parts that can be a trace are read by their mean row; each joins the first panel whose
    mean of mean rows is within the margin, else opens one.  An image without such parts has
    its wide bands of rows as panels.  The fold over an image's parts is an aggregate over
    their array; parts that can be a trace are wide, so an image has few of them.
    """
    sizes = (image_sizes(pixels) if sizes is None else sizes).select("image", F.col("width").cast("long"), F.col("height").cast("long"))
    runs = written(labelled_runs(pixels), "labelled")
    parts = _trace_parts(runs, sizes, least_share, 20)
    margin = F.greatest(F.lit(8), _whole(F.col("height") * 0.08))
    listed = parts.groupBy("image", "width", "height", margin.alias("margin")).agg(F.sort_array(F.collect_list(F.struct("y_center", "y_min", "x_min", "x_max", "y_max", "pixels"))).alias("parts"))

    def place(panels: Column, part: Column) -> Column:
        near = F.transform(panels, lambda p: F.abs(part["y_center"] - p["total"] / p["parts"]) <= F.col("margin"))
        at = F.array_position(near, True)
        grown = F.transform(panels, lambda p, k: F.when(k + 1 == at, _panel(p["total"] + part["y_center"], p["parts"] + 1, *(f(p[c], part[c]) for c, f in _BOX), p["pixels"] + part["pixels"])).otherwise(p))
        return F.when(at > 0, grown).otherwise(F.concat(panels, F.array(_panel(part["y_center"], F.lit(1), *(part[c] for c, _ in _BOX), part["pixels"]))))

    none = F.array().cast("array<struct<total:double,parts:int,x_min:bigint,x_max:bigint,y_min:bigint,y_max:bigint,pixels:bigint>>")
    panels = listed.select("image", "width", "height", F.explode(F.aggregate("parts", none, place)).alias("p")).select("image", "width", "height", "p.*").drop("total")
    bands = row_bands(runs.join(panels.select("image").distinct(), "image", "left_anti"), sizes).where(F.col("x_max") - F.col("x_min") >= F.greatest(F.lit(20), _whole(F.col("width") * least_share)))
    boxes = panels.unionByName(bands.select("image", "width", "height", F.lit(1).alias("parts"), "x_min", "x_max", "y_min", "y_max", "pixels"))
    padded = boxes.select("image", "parts", F.greatest(F.lit(0), F.col("x_min") - pad).alias("x_min"), F.least("width", F.col("x_max") + pad).alias("x_max"), F.greatest(F.lit(0), F.col("y_min") - pad).alias("y_min"), F.least("height", F.col("y_max") + pad).alias("y_max"), "pixels")
    return padded.withColumn("panel", F.row_number().over(Window.partitionBy("image").orderBy("y_min", "x_min", "y_max", "x_max"))).select("image", "panel", "parts", "x_min", "x_max", "y_min", "y_max", "pixels")


_BOX = (("x_min", F.least), ("x_max", F.greatest), ("y_min", F.least), ("y_max", F.greatest))


def _panel(total: Column, parts: Column, x_min: Column, x_max: Column, y_min: Column, y_max: Column, pixels: Column) -> Column:
    return F.struct(total.alias("total"), parts.cast("int").alias("parts"), x_min.alias("x_min"), x_max.alias("x_max"), y_min.alias("y_min"), y_max.alias("y_max"), pixels.alias("pixels"))
