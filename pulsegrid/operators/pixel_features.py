"""Features of each pixel of colour images (image, x, y, r, g, b): colours, place, and differences to neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6

#: Pixels are dealt in square tiles of so many columns and rows; a task never needs more of an image at once.
TILE = 256


def pixel_features(pixels: DataFrame, sizes: DataFrame, tile: int = TILE) -> DataFrame:
    """Grey, colours of 0 to 1, saturation, excess of blue and red, place in the frame, and steps of grey from the pixel above and to the left.

    sizes: image, width, height.  A step is 0 where there is no such pixel.  Pixels go once to
    their tile; those of a tile's last column or row also go to the next one, as a halo, so both
    neighbours of every pixel are in its tile and one shuffle does for both directions.  Pixels with a null place are left
    out, missing colours count as 0; of a pixel given twice each is compared with the same neighbours.
    """
    colour = [(F.coalesce(F.col(c), F.lit(0)).cast("double") / 255.0).alias(c) for c in "rgb"]
    p = pixels.dropna(subset=["image", "x", "y"]).select("image", F.col("x").cast("long"), F.col("y").cast("long"), *colour)
    p = p.withColumn("grey", 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))

    def at(dx: int, dy: int, own: bool):
        return F.struct(F.floor((F.col("x") + dx) / tile).alias("tx"), F.floor((F.col("y") + dy) / tile).alias("ty"), F.lit(own).alias("own"))

    edge = lambda c: F.pmod(c, F.lit(tile)) == tile - 1
    places = F.array_compact(F.array(at(0, 0, True), F.when(edge("x"), at(1, 0, False)), F.when(edge("y"), at(0, 1, False))))
    dealt = p.withColumn("t", F.explode(places)).select("*", "t.tx", "t.ty", "t.own").drop("t").repartition("image", "tx", "ty")

    def step(along: str, across: str):
        """Grey against that of the neighbour one back, if it is there; range frames let repeated pixels share theirs."""
        back = F.max("grey").over(Window.partitionBy("image", "tx", "ty", across).orderBy(along).rangeBetween(-1, -1))
        return F.coalesce(F.abs(F.col("grey") - back), F.lit(0.0))

    stepped = dealt.withColumns({"grad_y": step("y", "x"), "grad_x": step("x", "y")}).where("own").join(sizes.select("image", "width", "height"), "image")
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    figures = {
        "grey": F.col("grey"), "dark": 1.0 - F.col("grey"), "red": F.col("r"), "green": F.col("g"), "blue": F.col("b"), "saturation": top - low,
        "blue_excess": F.col("b") - F.greatest("r", "g"), "red_excess": F.col("r") - F.greatest("g", "b"),
        "row": F.col("y") / F.greatest(F.lit(1), F.col("height") - 1), "col": F.col("x") / F.greatest(F.lit(1), F.col("width") - 1), "grad_y": F.col("grad_y"), "grad_x": F.col("grad_x"),
    }
    return stepped.select("image", "x", "y", *[r6(v).alias(k) for k, v in figures.items()])
