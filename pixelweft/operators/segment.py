"""Whole segmentations: seeds, cuts, smoothing, fusion, and the vote of three colour spaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.operators.features import ensemble_features, features
from pixelweft.operators.fuse import fuse_classes, fuse_slots
from pixelweft.operators.grabcut import grabcut
from pixelweft.operators.seeds import classes, expand, one_vs_rest, trimap
from pixelweft.operators.spatial import distance_transform, guided_filter
from pixelweft.runtime import join_checked

DEFAULT_TRIO = ("ruderman_lab", "jzazbz", "oklch")
PIXEL = ["img", "y", "x"]


def scribble_distances(pixels: DataFrame, ann: str = "ann") -> DataFrame:
    """(img, y, x, class_id, dist): each pixel's distance to the nearest scribble of each class of its image."""
    rows = join_checked(pixels, classes(pixels, ann), ["img"]).withColumn("pw_here", F.col(ann) == F.col("class_id"))
    return distance_transform(rows, "pw_here", ["img", "class_id"])


def class_masks(pixels: DataFrame, feats: DataFrame, *, spaces: Sequence[str] = (), radius: float | None = 12.0, alpha: float = 3.0, smooth: bool = True, iterations: int = 5, ann: str = "ann") -> DataFrame:
    """(img, y, x, class_id[, slot], fg). Seeds don't depend on the colour space, so they are grown once and used by all.
    ``radius`` None leaves out the growth."""
    seeds = one_vs_rest(pixels, ann)
    if radius is not None:
        seeds = expand(seeds, radius, alpha)
    guide = ["r", "g", "b"] if smooth else []
    tri = seeds.select(*PIXEL, "class_id", *guide, trimap().alias("trimap"))
    keys = ["img", "class_id", *spaces]
    cut = grabcut(tri.join(feats, PIXEL), keys, iterations, guide).select(*keys, "y", "x", "fg", *guide)
    if not smooth:
        return cut
    guided = guided_filter(cut, "fg", keys=keys, placed=True)
    return guided.select(*keys, "y", "x", F.col("snapped").alias("fg"))


def segment_single(pixels: DataFrame, space: str = "oklab", **options) -> DataFrame:
    """(img, y, x, label) from one colour space."""
    masks = class_masks(pixels, features(pixels.select(*PIXEL, "r", "g", "b"), space), **options)
    return fuse_classes(masks.join(scribble_distances(pixels), [*PIXEL, "class_id"]), pixels)


def segment_ensemble(pixels: DataFrame, trio: Sequence[str] = DEFAULT_TRIO, tie_pref: int = 0, **options) -> DataFrame:
    """(img, y, x, label): each of three spaces is segmented and the labels are voted on."""
    if len(trio) != 3:
        raise ValueError("an ensemble has exactly three colour spaces")
    feats = ensemble_features(pixels.select(*PIXEL, "r", "g", "b"), trio).drop("space")
    masks = class_masks(pixels, feats, spaces=["slot"], **options)
    return fuse_slots(masks.join(scribble_distances(pixels), [*PIXEL, "class_id"]), pixels, tie_pref)
