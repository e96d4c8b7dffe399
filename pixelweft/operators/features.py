"""From pixels to 8-bit features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.functions.color import Channel, Steps, space
from pixelweft.runtime import join_checked


def level(x: Column) -> Column:
    """Cut to a level of 0..255."""
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(255)).cast("int")


def scale_to_range(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("img",)) -> DataFrame:
    """Scale columns so that each image's smallest value is 0 and its largest 255; a constant channel becomes 0.

    The ranges are aggregated before their shuffle and joined back, so that large images aren't gathered in
    one task, and pixels aren't shuffled while the table of ranges is small enough to be broadcast.
    """
    ranges = df.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    df = join_checked(df, ranges, list(by))
    for c in columns:
        lo, width = F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")
        df = df.withColumn(c, F.when(width > 0, level((F.col(c) - lo) / width * 255.0)).otherwise(F.lit(0)))
    return df.drop(*[f"{c}_{n}" for c in columns for n in ("lo", "hi")])


def features(pixels: DataFrame, name: str, by: Sequence[str] = ("img",)) -> DataFrame:
    """Replace r, g, b by the features f0, f1, f2 of a colour space."""
    let = Steps()
    channels: list[Channel] = space(name)(let, *(F.col(c).cast("double") if name.lower() not in ("hsv_conic", "rgb") else F.col(c).cast("long") for c in "rgb"))
    ranged = [f"f{i}" for i, c in enumerate(channels) if not c.exact and c.fixed is None]
    out = let.apply(pixels).select(*[c for c in pixels.columns if c not in ("r", "g", "b")], *[(c.value.cast("int") if c.exact else level(c.fixed(c.value)) if c.fixed else c.value).alias(f"f{i}") for i, c in enumerate(channels)])
    return scale_to_range(out, ranged, by) if ranged else out


def ensemble_features(pixels: DataFrame, names: Sequence[str]) -> DataFrame:
    """The features of several spaces, one row for each pixel and space: columns slot and space."""
    parts = [features(pixels, n).withColumns({"slot": F.lit(i), "space": F.lit(n.lower())}) for i, n in enumerate(names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unpack_images(images: DataFrame, layout: str | None = None) -> DataFrame:
    """Pixels of packed images (img, h, w, shape, data): ``data`` is an array of levels in one of the layouts
    hwc (shape h, w, 3), flat (h*w, 3), chw (3, h, w) or a plain run of h*w*3 numbers, tried in this order."""
    n = F.col("h") * F.col("w")
    shape = F.col("shape")
    kind = (
        F.when(shape == F.array("h", "w", F.lit(3)), "hwc").when(shape == F.array(n, F.lit(3)), "flat").when(shape == F.array(F.lit(3), "h", "w"), "chw").when(shape == F.array(n * 3), "run")
    )
    images = images.withColumn("layout", kind if layout is None else F.lit(layout))
    images = images.withColumn("layout", F.when(F.col("layout").isNull() | (F.size("data") != n * 3), F.raise_error(F.lit("not an image of three channels"))).otherwise(F.col("layout")))
    at = lambda i, c: F.get("data", F.when(F.col("layout") == "chw", F.lit(c) * n + i).otherwise(i * 3 + c).cast("int"))
    every = images.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    i = F.col("i")
    return every.select("img", F.floor(i / F.col("w")).cast("int").alias("y"), (i % F.col("w")).cast("int").alias("x"), *[at(i, c).cast("int").alias(k) for c, k in enumerate("rgb")])
