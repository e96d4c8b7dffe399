"""Fusing masks of classes and of colour spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ("img", "y", "x")


def fuse_classes(masks: DataFrame, pixels: DataFrame, exact: bool = True) -> DataFrame:
    """The final label of each pixel from per-class masks (img, y, x, class_id, fg, dist): of the classes that claim it, the one whose
    scribble is nearest, the lowest on ties; label = class - 1, and 0 where none does.

    With ``exact`` off, scores are single-precision ``fg * 1e9 - dist`` as a batch tool computes them: distances then count
    in steps of 64 only.
    """
    score = -F.col("dist") if exact else (F.col("fg").cast("float") * F.lit(1e9).cast("float") - F.col("dist").cast("float")).cast("float")
    best = F.max_by("class_id", F.struct(F.col("fg"), score, -F.col("class_id")))
    won = masks.groupBy(*PIXEL).agg(best.alias("class_id"), F.max("fg").alias("fg"))
    label = F.when(F.col("fg") > 0, F.col("class_id") - 1).otherwise(0)
    return pixels.select(*PIXEL).join(won, list(PIXEL), "left").select(*PIXEL, F.coalesce(label, F.lit(0)).cast("int").alias("label"))


def fuse_session(masks: DataFrame, pixels: DataFrame, tie_mode: str = "nearest-scribble") -> DataFrame:
    """As ``fuse_classes`` for interactive sessions: nearest scribble, or the highest class with ``last-wins``."""
    claims = masks.filter("fg > 0")
    if tie_mode == "nearest-scribble":
        won = claims.groupBy(*PIXEL).agg(F.min_by("class_id", F.struct("dist", "class_id")).alias("class_id"))
    elif tie_mode == "last-wins":
        won = claims.groupBy(*PIXEL).agg(F.max("class_id").alias("class_id"))
    else:
        raise ValueError(f"unknown tie mode: {tie_mode!r}")
    return pixels.select(*PIXEL).join(won, list(PIXEL), "left").select(*PIXEL, F.coalesce(F.col("class_id") - 1, F.lit(0)).cast("int").alias("label"))


def fuse_slots(masks: DataFrame, pixels: DataFrame, tie_pref: int = 0) -> DataFrame:
    """``fuse_classes`` for each of three slots and their vote, in two aggregations over the masks of all slots (img, y, x, class_id, slot, fg, dist)."""
    best = F.max_by("class_id", F.struct(F.col("fg"), -F.col("dist"), -F.col("class_id")))
    label = F.when(F.max("fg") > 0, best - 1).otherwise(0)
    fused = masks.groupBy(*PIXEL, "slot").agg(label.alias("label"))
    wide = fused.groupBy(*PIXEL).agg(*[F.max(F.when(F.col("slot") == k, F.col("label"))).alias(f"v{k}") for k in range(3)])
    zero = [F.coalesce(f"v{k}", F.lit(0)) for k in range(3)]
    return pixels.select(*PIXEL).join(wide, list(PIXEL), "left").select(*PIXEL, vote(*zero, tie_pref).cast("int").alias("label"))


def vote(a: Column, b: Column, c: Column, tie_pref: int = 0) -> Column:
    """The label that two of three agree on, else the preferred one's."""
    pick = (a, b, c)[tie_pref if tie_pref in (0, 1) else 2]
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(pick)


def majority_vote(masks: DataFrame, tie_pref: int = 0) -> DataFrame:
    """Vote over the three slots of a long relation (img, y, x, slot, label), in one aggregation. A pixel without
    exactly one label in each slot raises."""
    one = [F.max(F.when(F.col("slot") == k, F.col("label"))).alias(f"v{k}") for k in range(3)]
    rows = masks.groupBy(*PIXEL).agg(*one, F.count(F.lit(1)).alias("n"))
    ok = (F.col("n") == 3) & F.col("v0").isNotNull() & F.col("v1").isNotNull() & F.col("v2").isNotNull()
    label = F.when(ok, vote(F.col("v0"), F.col("v1"), F.col("v2"), tie_pref)).otherwise(F.raise_error(F.lit("masks differ in shape")).cast("int"))
    return rows.select(*PIXEL, label.cast("int").alias("label"))


def merge_annotations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert (img, y, x, ann): a new value that isn't 0 replaces the old one, 0 changes nothing."""
    n = new.select(*PIXEL, F.col("ann").alias("pw_new"))
    return old.join(n, list(PIXEL), "full_outer").select(*PIXEL, F.coalesce(F.when(F.col("pw_new") > 0, F.col("pw_new")), "ann", F.lit(0)).alias("ann"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts of (truth, label)."""
    return pairs.groupBy("truth", "label").agg(F.count("*").alias("n"))


def mean_iou(pairs: DataFrame) -> DataFrame:
    """Intersection over union of each label in (truth, label) pairs, from one pass of counts."""
    n = confusion(pairs)
    hit = n.filter("truth = label").select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    union = n.select(F.explode(F.when(F.col("truth") == F.col("label"), F.array("truth")).otherwise(F.array("truth", "label"))).alias("label"), "n").groupBy("label").agg(F.sum("n").alias("total"))
    return union.join(hit, "label", "left").select("label", (F.coalesce("tp", F.lit(0)) / F.col("total")).alias("iou"))
