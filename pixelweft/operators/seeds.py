"""Classes, seeds and trimaps from annotations (0 unknown, 1 background, 2 and up classes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.operators.spatial import edge_cost, gaussian_blur, geodesic_within, normalize_p95
from pixelweft.runtime import join_checked

BACKGROUND, FOREGROUND, MAYBE_BACKGROUND, MAYBE_FOREGROUND = 0, 1, 2, 3


def classes(ann: DataFrame, col: str = "ann") -> DataFrame:
    """The classes of each image."""
    return ann.filter(F.col(col) > 1).select("img", F.col(col).alias("class_id")).distinct()


def one_vs_rest(pixels: DataFrame, col: str = "ann") -> DataFrame:
    """Each pixel once for each class of its image, with seed_fg (this class) and seed_bg (background or another class)."""
    a = F.col(col)
    rows = join_checked(pixels, classes(pixels, col), ["img"])
    return rows.withColumns({"seed_fg": a == F.col("class_id"), "seed_bg": (a == 1) | ((a > 1) & (a != F.col("class_id")))})


def as_bool(value: Column) -> Column:
    """A mask value as 8 bits, set if not 0: so multiples of 256 are not set."""
    return F.pmod(value, F.lit(256)) > 0


def expand(pixels: DataFrame, radius: float = 12.0, alpha: float = 3.0, edge: str | None = "edge", cost: str | None = None) -> DataFrame:
    """Grow seed_fg and seed_bg to all pixels within a geodesic radius, per image and class.

    A pixel becomes foreground if foreground reaches it and background doesn't, unless it was a background seed; the old foreground
    seeds get no preference, so one within reach of the background turns into background.
    """
    keys = ["img", "class_id"]
    if cost is None:
        one = pixels.select("img", "y", "x", edge).distinct() if "class_id" in pixels.columns else pixels.select("img", "y", "x", edge)
        one = gaussian_blur(normalize_p95(one, edge), edge).select("img", "y", "x", edge_cost(F.col(edge), alpha).alias("pw_cost"))
        pixels, cost = pixels.join(one, ["img", "y", "x"]), "pw_cost"
    far = geodesic_within(pixels, {"pw_fg": F.col("seed_fg"), "pw_bg": F.col("seed_bg")}, radius, cost, keys)
    reach_fg, reach_bg = F.col("pw_fg").isNotNull(), F.col("pw_bg").isNotNull()
    out = far.withColumns({"seed_fg": reach_fg & ~reach_bg & ~F.col("seed_bg"), "seed_bg": reach_bg | F.col("seed_bg")})
    return out.drop("pw_fg", "pw_bg", "pw_cost")


def trimap(fg: str = "seed_fg", bg: str = "seed_bg") -> Column:
    """Foreground wins over background; the rest is probably background."""
    return F.when(F.col(fg), FOREGROUND).when(F.col(bg), BACKGROUND).otherwise(MAYBE_BACKGROUND)


def check_annotations(ann: DataFrame, col: str = "ann", highest: int = 255, warn_above: int = 21) -> DataFrame:
    """Per image: least, most, and whether the range asks for a warning; ids above ``highest`` or below 0 raise."""
    out = ann.groupBy("img").agg(F.min(col).alias("least"), F.max(col).alias("most"))
    bad = (F.col("least") < 0) | (F.col("most") > highest)
    return out.withColumn("warn", F.when(bad, F.raise_error(F.lit("annotation ids out of range")).cast("boolean")).otherwise((F.col("most") > warn_above) | (F.col("least") < 0)))
