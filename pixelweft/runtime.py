"""Session-level helpers: where shared intermediate tables go and how they are removed."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application, so that they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="pixelweft-zip-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "pixelweft.zip", "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(folder / "pixelweft.zip"))


def shared_base(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset, and only for a local
    master (one machine, as in tests), a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="pixelweft-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    path = f"{shared_base(spark)}/pixelweft/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


#: Paths handed out inside open ``scratch`` blocks.
_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What workspaces hold that are made inside goes at the end: for steps whose result is written elsewhere."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            discard(spark, path)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a Parquet table and read it back: cuts the lineage in a way that survives
    the loss of an executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of at most some hundred bytes that a broadcast may hold.
BROADCAST_ROWS = 200_000


def join_checked(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table that is small as a rule, such as one row for each image. Its rows are counted first, at most BROADCAST_ROWS and one, which needs no
    more than its keys: up to that many it is broadcast, so that ``df`` needn't be shuffled; beyond, the join is a plain one. Left to itself, the
    planner would guess the size of an aggregate from its input, and shuffle both sides before it sees better."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(small) if few else small, on, how)


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder, so that a reader finds it even if no file is written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
