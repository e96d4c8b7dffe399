"""The cuts that a session's actions call for, with models and masks kept from action to action.

Each micro-batch of plan rows (``session_stream`` with cells) runs the cuts of its images and classes, in order, and writes what they leave: one row
for each image and class with its mask's cells and its two models. A batch that is run again writes its own rows again. The latest row of each class, unless its
image was reset later, is the session as it stands. Seeds are the strokes themselves: growing them is up to who makes ``features``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelweft.operators.grabcut import Mixture, segment
from pixelweft.operators.seeds import BACKGROUND, FOREGROUND, MAYBE_BACKGROUND, MAYBE_FOREGROUND
from pixelweft.runtime import make_folder, materialize
from pixelweft.streaming.session import session_stream

KEYS = ["img", "class_id"]
CUTS = "img long, class_id int, seq long, iterations int, cells array<int>, bg_model array<double>, fg_model array<double>"
RESETS = "img long, seq long"


def _epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    make_folder(spark, path)
    return spark.read.schema(f"{schema}, epoch long").option("basePath", path).parquet(path)


def standing(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The latest mask and models of each image and class: (img, class_id, seq, iterations, cells, bg_model, fg_model). ``before`` leaves out that epoch and later ones."""
    cuts, resets = _epochs(spark, f"{store}/cuts", CUTS), _epochs(spark, f"{store}/resets", RESETS)
    if before is not None:
        cuts, resets = cuts.filter(F.col("epoch") < before), resets.filter(F.col("epoch") < before)
    names = [f.split()[0] for f in CUTS.split(", ")]
    last = cuts.groupBy(*KEYS).agg(F.max_by(F.struct(*names[2:]), "seq").alias("c")).select(*KEYS, "c.*")
    gone = resets.groupBy("img").agg(F.max("seq").alias("pw_reset"))
    return last.join(gone, "img", "left").filter("pw_reset IS NULL OR seq > pw_reset").select(*names)


def run_cuts(plan: DataFrame, features: DataFrame, store: str, epoch: int, *, width: int, iterations: int = 5, refine_iterations: int = 2) -> None:
    """Run a batch's plan rows over (img, y, x, f0, f1, f2); a cell is y * ``width`` + x. A segment starts from its seeds alone, a refine goes on from the models that
    the class has, if any."""
    spark = plan.sparkSession
    plan = materialize(plan, f"{store}/plans/epoch={epoch}")
    materialize(plan.filter("mode = 'reset'").select("img", "seq"), f"{store}/resets/epoch={epoch}")
    actions = F.array_sort(F.collect_list(F.struct("seq", "mode", "iterations", "cells", "against"))).alias("actions")
    todo = plan.filter("mode <> 'reset'").groupBy(*KEYS).agg(actions)
    todo = todo.join(standing(spark, store, epoch).select(*KEYS, "bg_model", "fg_model"), KEYS, "left")
    todo = materialize(todo, f"{store}/todo/epoch={epoch}")
    again = spark.read.schema(todo.schema).parquet(f"{store}/todo/epoch={epoch}")  # a table of its own, as a cogroup's sides may not share one
    pixels = features.join(again.select(*KEYS), "img").select(*KEYS, "y", "x", "f0", "f1", "f2")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        y, x = left["y"].to_numpy(), left["x"].to_numpy()
        image = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3))
        for k in range(3):
            image[y, x, k] = left[f"f{k}"].to_numpy()
        row = right.to_pylist()[0]
        models: tuple = tuple(Mixture.of(row[c]) if row[c] else None for c in ("bg_model", "fg_model"))
        for action in row["actions"]:
            mask = np.full(image.shape[:2], MAYBE_BACKGROUND)
            for cells, value in ((action["against"], BACKGROUND), (action["cells"], FOREGROUND)):
                at = np.array(cells, dtype=np.int64)
                mask[at // width, at % width] = value
            again = action["mode"] == "eval" and None not in models
            mask, *found = segment(image, mask, models if again else (None, None), refine_iterations if again else iterations)
            models = tuple(found)
        front = np.flatnonzero(np.isin(mask[y, x], (FOREGROUND, MAYBE_FOREGROUND)))
        cells = np.sort(y[front].astype(np.int64) * width + x[front]).tolist()
        last = row["actions"][-1]
        values = (row["img"], row["class_id"], last["seq"], last["iterations"], cells, *(m.flat() for m in models))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in CUTS.split(", ")])

    done = pixels.groupBy(*KEYS).cogroup(todo.groupBy(*KEYS)).applyInArrow(work, CUTS)
    materialize(done, f"{store}/cuts/epoch={epoch}")


def start_session(actions: DataFrame, features: DataFrame, store: str, checkpoint: str, *, width: int, **options) -> StreamingQuery:
    """A streaming query that runs the cuts of a stream of actions."""
    plan = session_stream(actions, cells=True)
    return plan.writeStream.foreachBatch(lambda batch, epoch: run_cuts(batch, features, store, epoch, width=width, **options)).option("checkpointLocation", checkpoint).start()
