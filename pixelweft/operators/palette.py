"""Colours of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def palette(spark: SparkSession) -> DataFrame:
    """(index, r, g, b) for 256 indices: the bits of an index are dealt to the three channels in turn, its lowest ones to the
    channels' highest."""
    i = F.col("index")

    def channel(c: int):
        total = F.lit(0)
        for j in range(8):
            total = total + F.shiftleft(F.shiftright(i, 3 * j + c).bitwiseAND(F.lit(1)), 7 - j)
        return total.cast("int")

    return spark.range(256).select(F.col("id").cast("int").alias("index")).select("index", *[channel(c).alias(k) for c, k in enumerate("rgb")])


def overlay(labels: DataFrame, colors: DataFrame, opacity: float) -> DataFrame:
    """The colour and alpha drawn over each labelled pixel; label 0 draws nothing. ``colors`` is (class_id, r, g, b)."""
    shown = labels.filter("label > 0").withColumn("class_id", F.col("label") + 1)
    return shown.join(colors, "class_id").select("img", "y", "x", "r", "g", "b", F.lit(int(255 * opacity)).alias("alpha"))


def class_colors(wanted: DataFrame, registry: DataFrame, defaults: DataFrame) -> DataFrame:
    """The colour of each class_id: the registry's, else the default list's, else one made from the id."""
    c = F.col("class_id")
    a, b = registry.select("class_id", *[F.col(k).alias(f"a{k}") for k in "rgb"]), defaults.select("class_id", *[F.col(k).alias(f"b{k}") for k in "rgb"])
    made = {"r": F.pmod(c * 97 + 61, F.lit(206)) + 50, "g": F.pmod(c * 57 + 131, F.lit(206)) + 50, "b": F.pmod(c * 171 + 17, F.lit(206)) + 50}
    return wanted.join(a, "class_id", "left").join(b, "class_id", "left").select("class_id", *[F.coalesce(f"a{k}", f"b{k}", made[k]).cast("int").alias(k) for k in "rgb"])
