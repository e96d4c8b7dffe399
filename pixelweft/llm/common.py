"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.sources.files import open_output as open_output  # noqa: PLC0414

T = TypeVar("T")
#: Byte table that lower-cases A-Z and nothing else.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


_HELD: dict = {}


def worker_memo(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one thing at a time, so that the memos of operators that ran before
    don't add up in a worker that goes on to another one."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            release_memory()
        _HELD[key] = make()
    return _HELD[key]


def release_memory(cycles: bool = True) -> None:
    """Give freed memory back to the system, where the C library can: a worker that waits for its next task would keep it. Without
    ``cycles``, objects that refer to each other aren't looked for, which takes a walk over all objects."""
    import ctypes
    import gc

    if cycles:
        gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python in batches of a few MB at most, or fewer if it does so already. A batch of whole texts is otherwise as large as a
    partition, and the executor holds it outside its heap, twice while it grows, beside the worker's own copy. Rows and results stay the same."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_runs(texts: pa.Array, chars: int) -> list[tuple[int, int]]:
    """Slices of an array of texts, of about so many characters each."""
    import pyarrow.compute as pc

    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(total // chars, prepend=0)).tolist() if len(total) else []
    edges = [0, *[c + 1 for c in cuts], len(total)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(col: str) -> Column:
    return F.col(col).cast("long")


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` increasing split points of a whole-number key, from its quantiles.

    The list holds one number for each part, never one for each row.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, shares, max(10_000, 4 * parts)).alias("q")).first()[0]
    return sorted(set(got or []))


def range_bucket(key: str, bounds: list[int]) -> Column:
    """Number of split points at or below the key, as a balanced tree of comparisons: 0 for null."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds)).cast("int")
