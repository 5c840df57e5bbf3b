"""Edge pixels of grey images: gradients of a 3 x 3 stencil, thinning along the gradient, and two thresholds with connected weak edges.

The stencil works on one array an image, inside the JVM. Pixels over the lower threshold form components of neighbours; a
component is an edge if one of its pixels is over the upper one. An image is one row, and no component leaves its image, so each
is grown from its strong pixels inside that row: in Python, as no expression walks until nothing is left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.deploy import ship

#: The thresholds, and the tangent of 22.5 degrees that parts the directions of a gradient.
LOW, HIGH, TANGENT = 50, 150, 0.41421356237309503


def image_arrays(pixels: DataFrame) -> DataFrame:
    """image_id, h, w, vs (values row by row) of pixels (image_id, y, x, v); every place of an image has one pixel."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    rows = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), ordered.alias("ps"))
    return rows.select("image_id", "h", "w", F.transform("ps", lambda p: p["v"].cast("int")).alias("vs"))


def _at(values: str, y: Column, x: Column) -> Column:
    return F.get(values, (y * F.col("w") + x).cast("int"))


def gradients(images: DataFrame) -> DataFrame:
    """Adds gs: array of (gx, gy), the differences of a 3 x 3 stencil weighted 1, 2, 1; the border's values go on outside."""

    def one(i: Column) -> Column:
        y, x = F.floor(i / F.col("w")).cast("int"), (i % F.col("w")).cast("int")
        inside = lambda c, top: F.greatest(F.lit(0), F.least(c, F.col(top) - 1))
        v = lambda dy, dx: _at("vs", inside(y + dy, "h"), inside(x + dx, "w"))
        gx = (v(-1, 1) + 2 * v(0, 1) + v(1, 1)) - (v(-1, -1) + 2 * v(0, -1) + v(1, -1))
        gy = (v(1, -1) + 2 * v(1, 0) + v(1, 1)) - (v(-1, -1) + 2 * v(-1, 0) + v(-1, 1))
        return F.struct(gx.alias("gx"), gy.alias("gy"))

    return images.withColumn("gs", F.transform(F.sequence(F.lit(0), F.size("vs") - 1), one))


def candidates(pixels: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """image_id, w, cs: array of (p (place, row by row), strong) of the pixels that are left by the lower threshold and the thinning.

    A pixel's size is |gx| + |gy|, nothing outside the image. It stays if it is larger than its neighbour before it along the
    gradient and not smaller than the one behind; along the diagonals larger than both.
    """
    rows = gradients(image_arrays(pixels)).withColumn("ms", F.transform("gs", lambda g: F.abs(g["gx"]) + F.abs(g["gy"])))

    def keeps(g: Column, i: Column) -> Column:
        y, x = F.floor(i / F.col("w")).cast("int"), (i % F.col("w")).cast("int")
        size = lambda dy, dx: F.when((y + dy >= 0) & (y + dy < F.col("h")) & (x + dx >= 0) & (x + dx < F.col("w")), _at("ms", y + dy, x + dx)).otherwise(0)
        m, ax, ay = F.get("ms", i), F.abs(g["gx"]), F.abs(g["gy"])
        level, upright = ay < ax * TANGENT, ay * TANGENT > ax
        falling = (g["gx"] < 0) != (g["gy"] < 0)
        slant = F.when(falling, (m > size(-1, 1)) & (m > size(1, -1))).otherwise((m > size(-1, -1)) & (m > size(1, 1)))
        return (m > low) & F.when(level, (m > size(0, -1)) & (m >= size(0, 1))).when(upright, (m > size(-1, 0)) & (m >= size(1, 0))).otherwise(slant)

    kept_places = F.filter(F.transform("gs", lambda g, i: F.when(keeps(g, i), F.struct(i.alias("p"), (F.get("ms", i) > high).alias("strong")))), lambda c: c.isNotNull())
    return rows.select("image_id", "w", kept_places.alias("cs"))


def _grown(w: pd.Series, places: pd.Series, strong: pd.Series) -> pd.Series:
    """The places of each image that its strong ones reach through neighbours."""
    out = []
    for width, ps, ss in zip(w, places, strong, strict=True):
        left = {int(p) for p, s in zip(ps, ss, strict=True) if not s}
        found = [int(p) for p, s in zip(ps, ss, strict=True) if s]
        if left:
            width = int(width)
            for p in found:  # it grows while it is walked
                x = p % width
                for d in range(-1 if x else 0, 2 if x + 1 < width else 1):
                    for q in (p + d - width, p + d, p + d + width):
                        if q in left:
                            left.remove(q)
                            found.append(q)
        out.append(found)
    return pd.Series(out, dtype=object)


def edge_pixels(pixels: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """image_id, y, x of the edge pixels of images (image_id, y, x, v). Neighbours are the eight around a pixel."""
    ship(pixels.sparkSession)
    rows = candidates(pixels, low, high).where("image_id is not null")
    part = lambda c: F.transform("cs", lambda x: x[c])
    found = F.pandas_udf(_grown, "array<int>")("w", part("p"), part("strong"))
    rows = rows.select("image_id", "w", F.explode_outer(found).alias("p")).where("p is not null")
    return rows.select("image_id", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"))


def with_edges(pixels: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """pixels with the column edge, 1 on edges: what the logo comparison takes."""
    found = edge_pixels(pixels, low, high).withColumn("edge", F.lit(1))
    return pixels.drop("edge").join(found, ["image_id", "y", "x"], "left").na.fill({"edge": 0})
