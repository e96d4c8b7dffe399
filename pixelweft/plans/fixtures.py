"""The pixel relations that the test tables give: 16 x 16 images from runs of 256 events, the last one filled up with events of user 0 and value 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """pixel(img, y, x, r, g, b); with ``extra`` also ann, edge, cost and three vote columns."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    e = F.col("event_id")
    fill = events.agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i")).filter("i < (256 - n % 256) % 256")
    events = events.unionByName(fill.select((F.col("n") + F.col("i")).alias("event_id"), F.lit(0).cast("long").alias("user_id"), F.lit(0.0).alias("value")))
    out = events.select(
        F.floor(e / 256).cast("long").alias("img"),
        F.floor((e % 256) / 16).cast("int").alias("y"),
        (e % 16).cast("int").alias("x"),
        (F.floor(F.col("value") * 100 + 0.5).cast("long") % 256).cast("int").alias("r"),
        (F.col("user_id") * 53 % 256).cast("int").alias("g"),
        ((e * 97 + F.col("user_id")) % 256).cast("int").alias("b"),
        "event_id",
        "user_id",
        "value",
    )
    if extra:
        m = F.col("event_id") % 53
        out = out.withColumn("ann", F.when(m == 7, 1).when(m == 20, 2).when(m == 33, 3).otherwise(0)).withColumn("edge", F.col("r") / 255.0)
        out = out.withColumn("cost", 1.0 + 3.0 * F.pow("edge", F.lit(0.8)))
        out = out.withColumns({"vote_a": (F.col("event_id") % 3).cast("int"), "vote_b": (F.col("user_id") % 3).cast("int"), "vote_c": (F.floor("value") % 3).cast("int")})
    return out.drop("event_id", "user_id", "value")


#: The same relation for DuckDB, as a common table expression named px (with the extra columns).
PX = """px AS (SELECT CAST(floor(event_id / 256.0) AS BIGINT) AS img, CAST(floor((event_id % 256) / 16.0) AS INT) AS y, CAST(event_id % 16 AS INT) AS x,
  CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) % 256 AS INT) AS r, CAST((user_id * 53) % 256 AS INT) AS g, CAST((event_id * 97 + user_id) % 256 AS INT) AS b,
  CASE event_id % 53 WHEN 7 THEN 1 WHEN 20 THEN 2 WHEN 33 THEN 3 ELSE 0 END AS ann,
  (CAST(floor(value * 100 + 0.5) AS BIGINT) % 256) / 255e0 AS edge,
  1e0 + 3e0 * pow((CAST(floor(value * 100 + 0.5) AS BIGINT) % 256) / 255e0, 0.8e0) AS cost,
  CAST(event_id % 3 AS INT) AS vote_a, CAST(user_id % 3 AS INT) AS vote_b, CAST(CAST(floor(value) AS BIGINT) % 3 AS INT) AS vote_c
  FROM (SELECT event_id, user_id, value FROM events UNION ALL SELECT n + unnest(range((256 - n % 256) % 256)), 0, 0e0 FROM (SELECT count(*) AS n FROM events)) e)"""
