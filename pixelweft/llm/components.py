"""Connected components of a graph of keys, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.runtime import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, path: str) -> DataFrame:
    """(key, root) for every key in an edge (a, b) of two keys; the root is the component's smallest key.

    Each round joins every key to its smallest neighbour, first for larger neighbours, then for smaller ones; the
    number of rounds grows with the logarithm of the largest component. Each round is a written table, the one before it
    is removed, and the driver sees a count and a checksum only. Smallest neighbours are written before they are
    joined: so both sides of a join are shuffled for it alone, and Spark can split a hot key's edges.
    """
    spark = edges.sparkSession
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}/round-0")
    mark, k = _mark(now), 0
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        k += 1
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{path}/least-{k}")
        large = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{path}/large-{k}")
        small_least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{path}/small-{k}")
        small = large.join(small_least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.withColumnRenamed("m", "v")).distinct()
        after = materialize(small, f"{path}/round-{k}")
        for old in (f"round-{k - 1}", f"least-{k}", f"large-{k}", f"small-{k}"):
            discard(spark, f"{path}/{old}")
        now, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    return now.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
