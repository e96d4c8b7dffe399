"""The batch job: a folder of images and a folder of annotations in, palette masks and a summary out."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.operators.palette import palette
from pixelweft.operators.segment import segment_ensemble, segment_single
from pixelweft.operators.spatial import resize_nearest, sobel_edges
from pixelweft.runtime import join_checked, materialize
from pixelweft.sources.images import file_name, list_files, listing, match_images, read_annotations, read_images, write_masks
from pixelweft.sources.sessions import summary

PIXEL = ["img", "y", "x"]


@dataclass
class Batch:
    """``results`` is (path, base, image, ok, reason), one row for each annotation; ``masks`` (base, file); ``summary`` one row with its JSON."""

    results: DataFrame
    masks: DataFrame
    summary: DataFrame


def _sizes(pixels: DataFrame, names: tuple[str, str]) -> DataFrame:
    return pixels.groupBy("img").agg((F.max("y") + 1).alias(names[0]), (F.max("x") + 1).alias(names[1]))


def run_batch(spark: SparkSession, images_dir: str, anns_dir: str, out_dir: str, work_dir: str, *, space: str = "oklab", trio: Sequence[str] | None = None, start: int = 1, count: int = 0, **options) -> Batch:
    """Segment every annotation's image and write ``<base>_index.png``. Annotations are listed in order of their names, from the ``start``-th on, ``count`` of
    them (0: all); one whose image is missing is skipped, one of another size than its image is resized. ``trio`` votes over three spaces. Seeds grow against
    Sobel edges, as the learned ones aren't at hand.
    Where two annotations have the same base name, the first one counts and the others are skipped. Images and annotations are read by
    Spark, and those without a partner go by a join with the pairs. ``ms`` in the summary is the job's time over its images."""
    began = time.monotonic()
    anns = listing(list_files(spark, anns_dir), start=start, count=count)
    pairs = match_images(anns, list_files(spark, images_dir))
    again = pairs.groupBy("base").agg(F.min("path").alias("pw_first"))
    reason = F.when(F.col("image").isNull(), "image not found").when(F.col("path") != F.col("pw_first"), "base name seen before")
    results = pairs.join(again, "base").withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
    results = materialize(results.select("path", "base", "image", "ok", "reason"), f"{work_dir}/results")
    todo = results.filter("ok").select(file_name("path").alias("ann_file"), file_name("image").alias("image_file"), "base", F.xxhash64("base").alias("img"))
    pixels = read_images(spark, images_dir).withColumn("image_file", file_name("path")).drop("path")
    pixels = join_checked(pixels, todo.select("image_file", "img"), ["image_file"]).drop("image_file")
    marks = read_annotations(spark, anns_dir, "*.[nN][pP][yY]").withColumn("ann_file", file_name("path")).drop("path")
    marks = join_checked(marks, todo.select("ann_file", "img"), ["ann_file"]).drop("ann_file")
    sizes = _sizes(marks, ("sh", "sw")).join(_sizes(pixels, ("dh", "dw")), "img")
    marks = resize_nearest(marks, sizes).select(*PIXEL, "ann")
    edges = sobel_edges(pixels, (F.col("r") + F.col("g") + F.col("b")) / 3.0).select(*PIXEL, "edge")
    own = materialize(pixels.join(edges, PIXEL).join(marks, PIXEL, "left").withColumn("ann", F.coalesce("ann", F.lit(0))), f"{work_dir}/pixels")
    labels = segment_ensemble(own, trio, **options) if trio else segment_single(own, space, **options)
    colors = [(r.r, r.g, r.b) for r in palette(spark).orderBy("index").collect()]
    named = join_checked(labels, todo.select("img", "base"), ["img"])
    masks = materialize(write_masks(named.select("base", "y", "x", "label"), out_dir, colors, key="base"), f"{work_dir}/masks")
    took = (time.monotonic() - began) * 1000.0
    done = results.filter("ok").count()
    timed = results.withColumn("ms", F.lit(took / max(done, 1)))
    settings = {"gc_iters": options.get("iterations", 5), "tie_mode": "nearest-scribble", "color_space": space, "enable_majority_vote": trio is not None, "ensemble_trio": ",".join(trio or ())}
    return Batch(results, masks, summary(timed, settings))
