"""Graph-cut segmentation of one image and class at a time.

Two colour mixtures (background, foreground) and a minimum cut on the 8-neighbour grid are refitted in turn, after Rother,
Kolmogorov and Blake, "GrabCut" (2004). Max-flow has no relational form, so a group is an (image, class, space) key and its
pixels go to numpy, small groups of one shape together; groups are independent, and nothing is shared or random: the first split of the mixtures follows their main axes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelweft.operators.seeds import BACKGROUND, FOREGROUND, MAYBE_BACKGROUND, MAYBE_FOREGROUND
from pixelweft.operators.spatial import by_shape, in_groups

COMPONENTS = 5
GAMMA = 50.0
#: Neighbours to one side; the other side's are the same edges.
AROUND = ((0, 1, 1.0), (1, 0, 1.0), (1, 1, 2**0.5), (1, -1, 2**0.5))


@dataclass
class Mixture:
    """Weights, means and covariances of a colour mixture. Kept as 5 x (1 + 3 + 9) numbers."""

    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def flat(self) -> list[float]:
        return np.concatenate([self.weight, self.mean.ravel(), self.cov.ravel()]).tolist()

    @classmethod
    def of(cls, flat: Sequence[float] | None) -> Mixture | None:
        """A stored model; an empty one, all zeros, counts as none."""
        if flat is None or not np.any(flat):
            return None
        a = np.asarray(flat, dtype=float)
        k = COMPONENTS
        return cls(a[:k], a[k : 4 * k].reshape(k, 3), a[4 * k :].reshape(k, 3, 3))

    def cost(self, x: np.ndarray) -> np.ndarray:
        return Mixtures(self.weight[None], self.mean[None], self.cov[None]).cost(x.T[:, None])[0]


def _moments(x: np.ndarray, part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and covariances of parts 0 to n - 1 of pixels, given by channel. A part's sums are in its pixels' order, whatever else is beside it."""
    count = np.bincount(part, minlength=n)
    at_least = np.maximum(count, 1)
    mean = np.stack([np.bincount(part, c, n) / at_least for c in x], axis=1)
    d = [c - mean[part, i] for i, c in enumerate(x)]
    cov = np.empty((n, 3, 3))
    for i in range(3):
        for j in range(i, 3):
            cov[:, i, j] = cov[:, j, i] = np.bincount(part, d[i] * d[j], n) / at_least
    return count, mean, cov


@dataclass
class Mixtures:
    """The mixtures of several groups: as ``Mixture``, with the group first. Pixels are given by channel and group: (3, groups, pixels)."""

    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def one(self, g: int) -> Mixture:
        return Mixture(self.weight[g], self.mean[g], self.cov[g])

    @classmethod
    def fit(cls, x: np.ndarray, inside: np.ndarray, label: np.ndarray) -> Mixtures:
        """Fitted to the pixels ``inside``, by their labels."""
        groups = len(inside)
        part = (np.arange(groups)[:, None] * COMPONENTS + label)[inside]
        count, mean, cov = _moments(x[:, inside], part, groups * COMPONENTS)
        cov += 0.01 * np.eye(3) * (np.linalg.det(cov) <= 1e-6)[:, None, None]
        cov[count == 0] = np.eye(3)
        total = np.maximum(inside.sum(axis=1), 1)
        return cls(count.reshape(groups, COMPONENTS) / total[:, None], mean.reshape(groups, COMPONENTS, 3), cov.reshape(groups, COMPONENTS, 3, 3))

    def where(self, these: np.ndarray, other: Mixtures) -> Mixtures:
        """These groups' own mixtures, and the others' from ``other``."""
        pick = lambda a, b: np.where(these.reshape(-1, *[1] * (a.ndim - 1)), a, b)
        return Mixtures(pick(self.weight, other.weight), pick(self.mean, other.mean), pick(self.cov, other.cov))

    def densities(self, x: np.ndarray):
        """Of each component in turn."""
        inv, scale = np.linalg.inv(self.cov), 1.0 / np.sqrt(np.linalg.det(self.cov))
        for k in range(COMPONENTS):
            d = [c - self.mean[:, k, i, None] for i, c in enumerate(x)]
            q = 0.0
            for i in range(3):
                q = q + d[i] * (inv[:, k, i, 0, None] * d[0] + inv[:, k, i, 1, None] * d[1] + inv[:, k, i, 2, None] * d[2])
            yield np.where(self.weight[:, k, None] > 0, np.exp(-0.5 * q) * scale[:, k, None], 0.0)

    def cost(self, x: np.ndarray) -> np.ndarray:
        total = sum(d * self.weight[:, k, None] for k, d in enumerate(self.densities(x)))
        return -np.log(np.maximum(total, 1e-300))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The densest component, the first one on ties."""
        label, best = np.zeros(x.shape[1:], dtype=np.int64), None
        for k, d in enumerate(self.densities(x)):
            if best is None:
                best = d
            else:
                label[d > best] = k
                best = np.maximum(best, d)
        return label


def split(x: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A first labelling of the pixels ``inside``: the widest part is cut at its mean along its main axis until there are enough."""
    groups = len(inside)
    label = np.zeros(inside.shape, dtype=np.int64)
    rows, own = np.arange(groups), np.nonzero(inside)[0]
    for k in range(1, COMPONENTS):
        count, mean, cov = _moments(x[:, inside], own * COMPONENTS + label[inside], groups * COMPONENTS)
        spread = np.where(count > 1, np.linalg.eigvalsh(cov)[:, -1], -1.0).reshape(groups, COMPONENTS)
        j = spread.argmax(axis=1)
        axis = np.linalg.eigh(cov.reshape(groups, COMPONENTS, 3, 3)[rows, j])[1][:, :, -1]
        mean = mean.reshape(groups, COMPONENTS, 3)[rows, j]
        side = sum((c - mean[:, i, None]) * axis[:, i, None] for i, c in enumerate(x))
        label[inside & (label == j[:, None]) & (side > 0) & (spread[rows, j] > 0)[:, None]] = k
    return label


def _shift(a: np.ndarray, dy: int, dx: int, fill: float) -> np.ndarray:
    """Each pixel's neighbour at (dy, dx)."""
    out = np.full_like(a, fill)
    h, w = a.shape
    ys, xs = slice(max(dy, 0), h + min(dy, 0)), slice(max(dx, 0), w + min(dx, 0))
    yd, xd = slice(max(-dy, 0), h + min(-dy, 0)), slice(max(-dx, 0), w + min(-dx, 0))
    out[yd, xd] = a[ys, xs]
    return out


def smoothness(image: np.ndarray) -> np.ndarray:
    """Weights of the edges to the neighbours in AROUND; 0 beyond the border."""
    return _smoothness(image[None])[:, 0]


def _smoothness(images: np.ndarray) -> np.ndarray:
    groups, h, w = images.shape[:3]
    diffs, total, count = np.zeros((len(AROUND), groups, h, w)), np.zeros(groups), 0
    for out, (dy, dx, _) in zip(diffs, AROUND, strict=True):
        here, there = _pairs(h, w, dy, dx)
        for c in range(3):
            out[here] += (images[(*here, c)] - images[(*there, c)]) ** 2
        total += out.reshape(groups, -1).sum(axis=1)
        count += max(h - dy, 0) * max(w - abs(dx), 0)
    beta = np.where(total <= 1e-12, 0.0, count / (2.0 * np.maximum(total, 1e-12)))
    weights = np.zeros_like(diffs)
    for out, d, (dy, dx, length) in zip(weights, diffs, AROUND, strict=True):
        here, _ = _pairs(h, w, dy, dx)
        out[here] = GAMMA / length * np.exp(-beta[:, None, None] * d[here])
    return weights


def _pairs(h: int, w: int, dy: int, dx: int) -> tuple[tuple, tuple]:
    """Where pixels have a neighbour at (dy, dx), and where those are, in all groups."""
    here = slice(None), slice(max(-dy, 0), h + min(-dy, 0)), slice(max(-dx, 0), w + min(-dx, 0))
    return here, (slice(None), slice(max(dy, 0), h + min(dy, 0)), slice(max(dx, 0), w + min(dx, 0)))


def min_cut(source: np.ndarray, sink: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """True where a pixel stays with the source. Push and relabel on the whole grid at once: all pixels with excess push to
    neighbours one level lower, one direction after the other; levels are renewed from the sink every few rounds."""
    return _min_cuts(source[None], sink[None], weights[:, None])[0]


def _min_cuts(source: np.ndarray, sink: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """As ``min_cut``, for several grids of one shape: (groups, y, x), and weights (4, groups, y, x). Groups don't meet: grids lie in one row of numbers with
    empty cells between their lines and between themselves, so that neighbours are at fixed distances. Groups that are done go from time to time."""
    groups, h, w = source.shape
    out = np.empty(source.shape, dtype=bool)
    line, grid = w + 1, (h + 1) * (w + 1)
    off = [dy * line + dx for dy, dx, _ in AROUND]
    off, back = [*off, *(-o for o in off)], [4, 5, 6, 7, 0, 1, 2, 3]
    margin, n = line + 1, h * w + 2
    level = np.float32 if n < 1 << 24 else np.float64
    through = np.minimum(source, sink)
    tiny = 1e-9 * np.maximum(1.0, np.maximum(source.max(axis=(1, 2)), sink.max(axis=(1, 2))))

    def laid(a: np.ndarray) -> np.ndarray:
        """A row of numbers with a margin at both ends."""
        flat = np.zeros(2 * margin + len(a) * grid)
        flat[margin:-margin].reshape(len(a), h + 1, line)[:, :h, :w] = a
        return flat

    ids = np.arange(groups)
    excess, to_sink = laid(source - through), laid(sink - through)
    cap = [laid(x) for x in weights]
    for x, o in zip(list(cap), off, strict=False):
        back_x = np.zeros_like(x)
        back_x[margin + o : len(x) - margin + o] = x[margin:-margin]
        cap.append(back_x)
    least = np.repeat(tiny, grid)
    height = None
    rounds = 0
    while True:
        size = len(ids) * grid
        own, near = slice(margin, margin + size), [slice(margin + o, margin + o + size) for o in off]
        e, t = excess[own], to_sink[own]

        def reach(d: np.ndarray, step: float) -> np.ndarray:
            """The least way to what is set in d, along open edges."""
            ways = [np.where(cap[k][own] > least, level(step), level(np.inf)) for k in range(8)]
            while True:
                before = d.copy()
                for way, there in zip(ways, near, strict=True):
                    np.minimum(d[own], d[there] + way, out=d[own])
                if (d == before).all():
                    return d

        def levels() -> np.ndarray:
            d = np.full(len(excess), np.inf, level)
            d[own] = np.where(t > least, 1.0, np.inf)
            return np.minimum(reach(d, 1.0), level(n))

        if height is None:
            height = levels()
        here = height[own]
        active = (e > least) & (here < n)
        busy = active.reshape(len(ids), grid).any(axis=1)
        if not busy.all() and 2 * busy.sum() <= len(ids):
            d = np.full(len(excess), np.inf, level)
            d[own] = np.where(t > least, 0.0, np.inf)
            apart = np.isinf(reach(d, 0.0)[own]).reshape(len(ids), h + 1, line)[:, :h, :w]
            out[ids[~busy]] = apart[~busy]
            if not busy.any():
                return out
            keep = lambda a: np.concatenate([a[:margin], a[own].reshape(len(busy), grid)[busy].ravel(), a[len(a) - margin :]])
            excess, to_sink, height, cap = keep(excess), keep(to_sink), keep(height), [keep(c) for c in cap]
            least, ids = least.reshape(len(busy), grid)[busy].ravel(), ids[busy]
            continue
        push = np.where(active & (here == 1), np.minimum(e, t), 0.0)
        e -= push
        t -= push
        high = here < n
        for k in range(8):
            push = np.where((e > least) & high & (height[near[k]] == here - 1), np.minimum(e, cap[k][own]), 0.0)
            if push.any():
                e -= push
                cap[k][own] -= push
                excess[near[k]] += push
                cap[back[k]][near[k]] += push
        rounds += 1
        if rounds % 8 == 0:
            height = levels()
        else:
            low = np.where(t > least, level(0), level(np.inf))
            for k in range(8):
                np.minimum(low, np.where(cap[k][own] > least, height[near[k]], level(np.inf)), out=low)
            stuck = (e > least) & high & (low + 1 > here)
            here[stuck] = np.minimum(low[stuck] + 1, n)


def energy(image: np.ndarray, mask: np.ndarray, bg: Mixture, fg: Mixture, weights: np.ndarray) -> float:
    """Colour cost of a labelling plus the weights of the edges that it cuts."""
    x = image.reshape(-1, 3)
    front = np.isin(mask, (FOREGROUND, MAYBE_FOREGROUND))
    cut = sum(float((w * (front != _shift(front.astype(float), dy, dx, 0.0).astype(bool))).sum()) for w, (dy, dx, _) in zip(weights, AROUND, strict=True))
    return float(np.where(front.ravel(), fg.cost(x), bg.cost(x)).sum()) + cut


def segment(image: np.ndarray, mask: np.ndarray, models: tuple[Mixture | None, Mixture | None] = (None, None), iterations: int = 5) -> tuple[np.ndarray, Mixture, Mixture]:
    """Refine a trimap. With models given, they are applied as they are first (evaluation), else mixtures start from the mask."""
    mask, bg, fg = segment_together(image[None], mask[None], [models], iterations)
    return mask[0], bg.one(0), fg.one(0)


def segment_together(images: np.ndarray, masks: np.ndarray, models: Sequence[tuple[Mixture | None, Mixture | None]], iterations: int = 5) -> tuple[np.ndarray, Mixtures, Mixtures]:
    """As ``segment``, for several groups of one shape, each of which comes out as it would alone."""
    groups, h, w = masks.shape
    images = images.astype(float)
    x = np.ascontiguousarray(images.reshape(groups, h * w, 3).transpose(2, 0, 1))
    weights = _smoothness(images)
    masks = masks.copy()
    front = np.isin(masks, (FOREGROUND, MAYBE_FOREGROUND)).reshape(groups, -1)
    fg = Mixtures.fit(x, front, split(x, front))
    bg = Mixtures.fit(x, ~front, split(x, ~front)).where((~front).any(axis=1), fg)
    given = np.array([b is not None and f is not None for b, f in models])
    for g in np.flatnonzero(given):
        for new, old in zip(models[g], (bg, fg), strict=True):
            old.weight[g], old.mean[g], old.cov[g] = new.weight, new.mean, new.cov
    free = (masks != FOREGROUND) & (masks != BACKGROUND)
    most = 9 * GAMMA
    for _ in range(iterations):
        front = np.isin(masks, (FOREGROUND, MAYBE_FOREGROUND)).reshape(groups, -1)
        fg = Mixtures.fit(x, front, fg.assign(x)).where(front.any(axis=1), fg)
        bg = Mixtures.fit(x, ~front, bg.assign(x)).where((~front).any(axis=1), bg)
        source = np.where(masks == FOREGROUND, most, np.where(masks == BACKGROUND, 0.0, bg.cost(x).reshape(masks.shape)))
        sink = np.where(masks == BACKGROUND, most, np.where(masks == FOREGROUND, 0.0, fg.cost(x).reshape(masks.shape)))
        low = np.minimum(source, sink)
        source, sink = np.where(free, source - low, source), np.where(free, sink - low, sink)
        masks = np.where(free, np.where(_min_cuts(source, sink, weights), MAYBE_FOREGROUND, MAYBE_BACKGROUND), masks)
    return masks, bg, fg


def grabcut(rows: DataFrame, keys: Sequence[str] = ("img", "class_id"), iterations: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """Segment groups of (keys, y, x, f0, f1, f2, trimap): gives (keys, y, x, fg, bg_model, fg_model), the models on the
    first pixel only, and the columns ``keep``. A group without foreground seeds has no foreground and no model. Groups that bring columns
    bg_model and fg_model of an earlier run, on any pixel, go on from them, for as many rounds."""
    import pyspark.sql.functions as F

    stored = {"bg_model", "fg_model"} <= set(rows.columns)
    cols = [*keys, "y", "x", *keep]

    def work(tables: list[pa.Table]) -> Iterator[pa.Table]:
        for shape, groups in by_shape(tables).items():
            masks, images = np.full((len(groups), *shape), MAYBE_BACKGROUND), np.zeros((len(groups), *shape, 3))
            models = [(None, None)] * len(groups)
            for g, (table, y, x) in enumerate(groups):
                masks[g, y, x] = table["trimap"].to_numpy()
                for k in range(3):
                    images[g, y, x, k] = table[f"f{k}"].to_numpy()
                if stored:
                    models[g] = tuple(Mixture.of(next((m for m in table[c].to_pylist() if m), None)) for c in ("bg_model", "fg_model"))
            some = np.flatnonzero((masks == FOREGROUND).any(axis=(1, 2)))
            fg, found = np.zeros(masks.shape, np.int32), {}
            if len(some):
                cut, *mixtures = segment_together(images[some], masks[some], [models[g] for g in some], iterations)
                fg[some] = np.isin(cut, (FOREGROUND, MAYBE_FOREGROUND))
                found = {g: [m.one(i).flat() for m in mixtures] for i, g in enumerate(some.tolist())}
            out = pa.concat_tables([table.select(cols) for table, _, _ in groups])
            lists = [pa.array([v for g, (table, _, _) in enumerate(groups) for v in (found[g][i] if g in found else None, *[None] * (table.num_rows - 1))], pa.list_(pa.float64())) for i in range(2)]
            yield out.append_column("fg", pa.array(np.concatenate([fg[g, y, x] for g, (_, y, x) in enumerate(groups)]))).append_column("bg_model", lists[0]).append_column("fg_model", lists[1])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in cols)
    order = sorted(cols, key=[f.name for f in rows.schema].index)
    cols[:] = order
    out = rows.select(*cols, "f0", "f1", "f2", "trimap", *(["bg_model", "fg_model"] if stored else []))
    return in_groups(out, keys, work, f"{schema}, fg int, bg_model array<double>, fg_model array<double>").select("*", F.lit(iterations).alias("iterations"))
