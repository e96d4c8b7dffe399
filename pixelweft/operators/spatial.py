"""Operators over pixel neighbourhoods, as windows over full lattices or, where they go on for rounds, as numpy groups.

A lattice is a relation with a row for every pixel of an image: (img, y, x, ...). Row and column windows are keyed by image and
line, so that an image has to fit a task's window buffer line by line, not as a whole. What goes to numpy is held by whole images, small ones of one shape
together (``in_groups``).
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.runtime import join_checked

DIAGONAL = math.sqrt(2.0)
#: Chamfer weights of a 3x3 distance transform for straight and diagonal steps.
CHAMFER = (0.955, 1.3693)


def _row(keys: Sequence[str]):
    return Window.partitionBy(*keys, "y").orderBy("x")


def _column(keys: Sequence[str]):
    return Window.partitionBy(*keys, "x").orderBy("y")


def normalize_p95(df: DataFrame, col: str = "edge", keys: Sequence[str] = ("img",)) -> DataFrame:
    """Divide by the image's 95th percentile (linear between ranks) and clip to 0..1; images whose percentile is
    at most 1e-6 stay as they are."""
    p = df.groupBy(*keys).agg(F.percentile(col, F.lit(0.95)).alias("pw_p95"))
    v = F.col(col)
    return join_checked(df, p, list(keys)).withColumn(col, F.when(F.col("pw_p95") > 1e-6, F.least(F.greatest(v / F.col("pw_p95"), F.lit(0.0)), F.lit(1.0))).otherwise(v)).drop("pw_p95")


def gaussian_weights(sigma: float, radius: int) -> list[float]:
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _blur_lines(df: DataFrame, col: str, line: str, along: str, weights: list[float], keys: Sequence[str]) -> DataFrame:
    """Weighted sums along one axis; beyond the border, the line is mirrored without its last pixel."""
    r = len(weights) // 2
    rest = [c for c in df.columns if c not in (*keys, line, along, col)]
    cells = F.array_sort(F.collect_list(F.struct(F.col(along).alias("at"), F.col(col).alias("v"), *rest)))
    rows = df.groupBy(*keys, line).agg(cells.alias("cells")).withColumn("n", F.size("cells"))

    def mirrored(i: Column) -> Column:
        n = F.col("n")
        turn = F.greatest(2 * (n - 1), F.lit(1))
        j = F.pmod(i, turn)
        return F.when(n == 1, F.lit(0)).when(j < n, j).otherwise(turn - j)

    def blurred(cell: Column, i: Column) -> Column:
        total = sum((w * F.get(F.col("cells"), mirrored(i + k - r)).v for k, w in enumerate(weights)), F.lit(0.0))
        return F.struct(cell.at.alias(along), total.alias(col), *[cell[c].alias(c) for c in rest])

    return rows.select(*keys, line, F.inline(F.transform("cells", blurred))).select(*df.columns)


def gaussian_blur(df: DataFrame, col: str = "edge", sigma: float = 0.8, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Separable Gaussian: the kernel has round(8 sigma + 1) taps, made odd."""
    radius = (round(sigma * 8 + 1) | 1) // 2
    w = gaussian_weights(sigma, radius)
    return _blur_lines(_blur_lines(df, col, "y", "x", w, keys), col, "x", "y", w, keys)


def edge_cost(edge: Column, alpha: float = 3.0) -> Column:
    return 1.0 + alpha * F.pow(edge, F.lit(0.8))


def sobel_edges(df: DataFrame, value: Column, keys: Sequence[str] = ("img",)) -> DataFrame:
    """A gradient magnitude as edge map, a stand-in where no learned detector is at hand; borders repeat their pixel."""
    rows, cols = _row(keys), _column(keys)
    df = df.withColumn("v", value)
    take = lambda c, f, w: F.coalesce(f(c, 1).over(w), F.col(c))
    df = df.withColumns({"l": take("v", F.lag, rows), "r": take("v", F.lead, rows)})
    df = df.withColumns({"sx": F.col("r") - F.col("l"), "sy": F.col("l") + 2 * F.col("v") + F.col("r")})
    gx = take("sx", F.lag, cols) + 2 * F.col("sx") + take("sx", F.lead, cols)
    gy = take("sy", F.lead, cols) - take("sy", F.lag, cols)
    return df.withColumn("edge", F.sqrt(gx * gx + gy * gy)).drop("v", "l", "r", "sx", "sy")


def _per_image(df: DataFrame, keys: Sequence[str], work, schema: str) -> DataFrame:
    """One whole image at a time in numpy: for what windows can't express, or only dearly."""
    return df.groupBy(*keys).applyInArrow(work, schema)


#: Pixels of the groups that numpy takes at a time: small images share their numpy calls, a larger one has its own.
TOGETHER = 1 << 15


def in_groups(df: DataFrame, keys: Sequence[str], work: Callable[[list[pa.Table]], Iterator[pa.Table]], schema: str, placed: bool = False) -> DataFrame:
    """As a grouped map, but ``work`` gets several whole groups at once, some TOGETHER pixels or one that has more. ``placed`` rows come from such a map by
    the same keys: groups lie in a row already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, most = 0, TOGETHER
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                groups = _groups(held, keys)
                held = groups[-1].to_batches()  # it may go on
                n = groups[-1].num_rows
                most = max(TOGETHER, 2 * n)  # a large group isn't looked through anew at each batch
                yield from _in_turn(groups[:-1], work)
        if n:
            yield from _in_turn(_groups(held, keys), work)

    return (df if placed else df.repartition(*keys).sortWithinPartitions(*keys)).mapInArrow(run, schema)


def _groups(batches: list[pa.RecordBatch], keys: Sequence[str]) -> list[pa.Table]:
    """Cuts rows in the order of their keys where a key changes; nulls are one key."""
    table = pa.Table.from_batches(batches).combine_chunks()
    changes = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for k in keys:
        a, b = table[k].slice(1), table[k].slice(0, table.num_rows - 1)
        changes |= pc.fill_null(pc.not_equal(a, b), False).to_numpy().astype(bool) | (a.is_null().to_numpy().astype(bool) != b.is_null().to_numpy().astype(bool))
    edges = [0, *(np.flatnonzero(changes) + 1).tolist(), table.num_rows]
    return [table.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def by_shape(tables: list[pa.Table]) -> dict[tuple[int, int], list[tuple[pa.Table, np.ndarray, np.ndarray]]]:
    """Images' tables and their rows' places, by the images' heights and widths."""
    out = defaultdict(list)
    for table in tables:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        out[int(y.max()) + 1, int(x.max()) + 1].append((table, y, x))
    return out


def _in_turn(groups: list[pa.Table], work: Callable[[list[pa.Table]], Iterator[pa.Table]]) -> Iterator[pa.RecordBatch]:
    while groups:
        size = np.cumsum([g.num_rows for g in groups])
        n = max(1, int(np.searchsorted(size, TOGETHER, side="right")))
        for out in work(groups[:n]):
            yield from out.to_batches()
        groups = groups[n:]


def _grid(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    y, x = table["y"].to_numpy(), table["x"].to_numpy()
    shape = (int(y.max()) + 1, int(x.max()) + 1)
    out = []
    for n in names:
        a = np.zeros(shape)
        a[y, x] = table[n].to_numpy()
        out.append(a)
    return out


def geodesic_within(df: DataFrame, seeds: dict[str, Column], radius: float, cost: str = "cost", keys: Sequence[str] = ("img",), eight: bool = True) -> DataFrame:
    """Distances from seed pixels over a cost surface, exact wherever at most ``radius``, null beyond.

    A step costs its length (1, or the root of 2) times the mean cost of its ends. As costs are at least 1, a path of
    length r has at most r steps, so floor(r) rounds of taking the least over neighbours are enough. ``seeds`` maps a
    result column to the seed condition. Whole images in numpy: as windows, every round would sort all pixels twice.
    """
    names = list(seeds)
    steps = [(1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)] + ([(a, b, DIAGONAL) for a in (1, -1) for b in (1, -1)] if eight else [])
    df = df.withColumns({n: F.coalesce(s, F.lit(False)) for n, s in seeds.items()})

    def spread(d: np.ndarray, c: np.ndarray) -> np.ndarray:
        h, w = c.shape[1:]
        around = np.full((len(c), h + 2, w + 2), np.inf)
        costs = around.copy()
        costs[:, 1:-1, 1:-1] = c
        for _ in range(math.floor(radius)):
            around[:, 1:-1, 1:-1] = d
            new = d
            for dy, dx, far in steps:
                there = slice(None), slice(1 + dy, 1 + dy + h), slice(1 + dx, 1 + dx + w)
                new = np.minimum(new, around[there] + far * 0.5 * (c + costs[there]))
            if (new == d).all():
                break
            d = new
        return d

    def work(tables: list[pa.Table]) -> Iterator[pa.Table]:
        for shape, groups in by_shape(tables).items():
            c = np.full((len(groups), *shape), np.inf)
            for g, (table, y, x) in enumerate(groups):
                c[g, y, x] = table[cost].to_numpy()
            out = pa.concat_tables([table for table, _, _ in groups])
            for n in names:
                d = np.full(c.shape, np.inf)
                for g, (table, y, x) in enumerate(groups):
                    d[g, y, x] = np.where(table[n].to_numpy(), 0.0, np.inf)
                d = spread(d, c)
                v = np.concatenate([d[g, y, x] for g, (_, y, x) in enumerate(groups)])
                out = out.set_column(out.column_names.index(n), n, pa.array(v, mask=~(v <= radius)))
            yield out

    schema = ", ".join(f"`{f.name}` {'double' if f.name in names else f.dataType.simpleString()}" for f in df.schema)
    return in_groups(df, keys, work, schema)


def geodesic_exact(df: DataFrame, seed: str, cost: str = "cost", keys: Sequence[str] = ("img",), eight: bool = True) -> DataFrame:
    """Distances without a bound, by a heap, one image a task: adds ``dist`` (null where no seed reaches)."""
    steps = [(1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)] + ([(a, b, DIAGONAL) for a in (1, -1) for b in (1, -1)] if eight else [])
    cols = [*keys, "y", "x"]

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c, s = _grid(table, cost, "pw_seed")
        d = np.where(s > 0, 0.0, np.inf)
        heap = [(0.0, int(y), int(x)) for y, x in np.argwhere(s > 0)]
        while heap:
            at, y, x = heapq.heappop(heap)
            if at > d[y, x]:
                continue
            for dy, dx, w in steps:
                ny, nx = y + dy, x + dx
                if 0 <= ny < d.shape[0] and 0 <= nx < d.shape[1]:
                    far = at + w * 0.5 * (c[y, x] + c[ny, nx])
                    if far < d[ny, nx]:
                        d[ny, nx] = far
                        heapq.heappush(heap, (far, ny, nx))
        v = d[table["y"].to_numpy(), table["x"].to_numpy()]
        return table.select(cols).append_column("dist", pa.array(v, mask=np.isinf(v)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in cols) + ", dist double"
    return _per_image(df.select(*cols, cost, F.coalesce(F.col(seed), F.lit(False)).cast("double").alias("pw_seed")), keys, work, schema)


def chamfer(seeds: np.ndarray) -> np.ndarray:
    """Distance to the nearest seed in steps of CHAMFER weights: two sweeps, each line at once along its axis. The last two axes are an image's."""
    a, b = CHAMFER
    h, w = seeds.shape[-2:]
    d = np.where(seeds, 0.0, np.inf)
    ramp = a * np.arange(w)

    def along(line: np.ndarray) -> np.ndarray:
        ahead = np.minimum.accumulate(line - ramp, axis=-1) + ramp
        return np.minimum(ahead, np.minimum.accumulate((line + ramp)[..., ::-1], axis=-1)[..., ::-1] - ramp)

    def from_line(line: np.ndarray) -> np.ndarray:
        side = np.full(line.shape, np.inf)
        side[..., 1:] = line[..., :-1]
        side[..., :-1] = np.minimum(side[..., :-1], line[..., 1:])
        return np.minimum(line + a, side + b)

    for rows in (range(h), range(h - 1, -1, -1)):
        last = None
        for y in rows:
            if last is not None:
                d[..., y, :] = np.minimum(d[..., y, :], from_line(d[..., last, :]))
            d[..., y, :] = along(d[..., y, :])
            last = y
    return d


def distance_transform(df: DataFrame, seed: str, keys: Sequence[str] = ("img",), absent: float = 1e6) -> DataFrame:
    """Adds ``dist``: the chamfer distance to the image's nearest seed, ``absent`` in images without any."""
    cols = [*keys, "y", "x"]

    def work(tables: list[pa.Table]) -> Iterator[pa.Table]:
        for shape, groups in by_shape(tables).items():
            here = np.zeros((len(groups), *shape), dtype=bool)
            for g, (table, y, x) in enumerate(groups):
                here[g, y, x] = table["pw_seed"].to_numpy() > 0
            d = np.where(here.any(axis=(1, 2))[:, None, None], chamfer(here), absent)
            yield pa.concat_tables([table.select(cols) for table, _, _ in groups]).append_column("dist", pa.array(np.concatenate([d[g, y, x] for g, (_, y, x) in enumerate(groups)])))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in cols) + ", dist double"
    rows = df.select(*cols, F.coalesce(F.col(seed), F.lit(False)).cast("double").alias("pw_seed"))
    cols[:] = [f.name for f in df.schema if f.name in cols]
    return in_groups(rows, keys, work, schema)


def _box_sums(a: np.ndarray, radius: int) -> np.ndarray:
    """Sums over squares of images (the last two axes), cut off at the border: first along lines, then along columns, each from its least place on."""
    for axis in (-1, -2):
        n = a.shape[axis]
        out = np.zeros_like(a)
        at = lambda lo, hi, axis=axis: (..., slice(lo, hi), *[slice(None)] * (-1 - axis))
        for k in range(-radius, radius + 1):
            if abs(k) < n:
                out[at(max(-k, 0), n - max(k, 0))] += a[at(max(k, 0), n + min(k, 0))]
        a = out
    return a


def _guided(here: np.ndarray, i: np.ndarray, p: np.ndarray, radius: int, eps: float) -> np.ndarray:
    """The smoothed mask of images (groups, y, x), by their guide's three channels. What is null is NaN and adds nothing to a sum."""
    n = _box_sums(here.astype(float), radius)
    mean = lambda a: _box_sums(np.where(here & ~np.isnan(a), a, 0.0), radius) / n
    m, mp = [mean(c) for c in i], mean(p)
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    c = {(a, b): mean(i[a] * i[b]) - m[a] * m[b] + (eps if a == b else 0.0) for a, b in pairs}
    v = [mean(i[k] * p) - m[k] * mp for k in range(3)]
    s = lambda a, b: c[min(a, b), max(a, b)]
    minor = lambda a, b: (lambda r, q: s(r[0], q[0]) * s(r[1], q[1]) - s(r[0], q[1]) * s(r[1], q[0]))([k for k in range(3) if k != a], [k for k in range(3) if k != b])
    made = {(a, b): (-1.0) ** (a + b) * minor(a, b) for a, b in pairs}
    co = lambda a, b: made[min(a, b), max(a, b)]
    det = s(0, 0) * co(0, 0) + s(0, 1) * co(0, 1) + s(0, 2) * co(0, 2)
    fit = [(co(k, 0) * v[0] + co(k, 1) * v[1] + co(k, 2) * v[2]) / np.where(det == 0, np.nan, det) for k in range(3)]
    rest = mp - fit[0] * m[0] - fit[1] * m[1] - fit[2] * m[2]
    fit = [mean(f) for f in fit]
    return fit[0] * i[0] + fit[1] * i[1] + fit[2] * i[2] + mean(rest)


def guided_filter(df: DataFrame, mask: str, radius: int = 4, eps: float = 1e-6, guide: Sequence[str] = ("r", "g", "b"), keys: Sequence[str] = ("img",), placed: bool = False) -> DataFrame:
    """Smooth a 0/1 mask along the edges of a colour guide, and cut at a half: adds ``smooth`` and ``snapped``.

    In each square the mask is fitted as a linear function of the guide's three channels; a pixel takes the mean of the fits of
    all squares that hold it. Whole images in numpy; sums are taken in the order of windows over lines and columns. ``placed``: see ``in_groups``.
    """

    def work(tables: list[pa.Table]) -> Iterator[pa.Table]:
        for shape, groups in by_shape(tables).items():
            here = np.zeros((len(groups), *shape), dtype=bool)
            i, p = np.full((3, *here.shape), np.nan), np.full(here.shape, np.nan)
            for g, (table, y, x) in enumerate(groups):
                here[g, y, x] = True
                p[g, y, x] = pc.cast(table[mask], pa.float64()).to_numpy()
                for k, c in enumerate(guide):
                    i[k, g, y, x] = pc.cast(table[c], pa.float64()).to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                smooth = _guided(here, i, p, radius, eps)
            v = np.concatenate([smooth[g, y, x] for g, (_, y, x) in enumerate(groups)])
            null = np.isnan(v)
            out = pa.concat_tables([table for table, _, _ in groups])
            yield out.append_column("smooth", pa.array(v, mask=null)).append_column("snapped", pa.array((v >= 0.5).astype(np.int32), mask=null))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", smooth double, snapped int"
    return in_groups(df, keys, work, schema, placed)


def resize_nearest(df: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Pixels of each image at another size, from the nearest ones of the old. ``sizes`` has the keys, sh, sw (old) and dh, dw (new)."""
    grid = sizes.select(*keys, "sh", "sw", "dh", "dw", F.explode(F.sequence(F.lit(0), F.col("dh") - 1)).alias("ny")).withColumn("nx", F.explode(F.sequence(F.lit(0), F.col("dw") - 1)))
    near = lambda n, s, d: F.least(F.floor(F.col(n) * F.col(s) / F.col(d)).cast("int"), F.col(s) - 1)
    grid = grid.select(*keys, "ny", "nx", near("ny", "sh", "dh").alias("y"), near("nx", "sw", "dw").alias("x"))
    return grid.join(df, [*keys, "y", "x"]).drop("y", "x").withColumnsRenamed({"ny": "y", "nx": "x"})
