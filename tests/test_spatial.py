"""Neighbourhood operators against small numpy models, and the traps of seeds and fusion."""

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelweft.operators import fuse, grabcut, seeds, segment, spatial, strokes
from pixelweft.operators.palette import palette


def lattice(spark, shape, **cols):
    h, w = shape
    rows = [(0, y, x, *[float(a[y][x]) for a in cols.values()]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "img long, y int, x int" + "".join(f", {k} double" for k in cols))


def grid(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r[col] is None else r[col]
    return out


def dijkstra(cost, seed):
    d = np.where(seed, 0.0, np.inf)
    heap = [(0.0, *p) for p in np.argwhere(seed).tolist()]
    while heap:
        at, y, x = heapq.heappop(heap)
        if at > d[y, x]:
            continue
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                ny, nx = y + dy, x + dx
                if (dy or dx) and 0 <= ny < d.shape[0] and 0 <= nx < d.shape[1]:
                    far = at + math.hypot(dy, dx) * 0.5 * (cost[y, x] + cost[ny, nx])
                    if far < d[ny, nx]:
                        d[ny, nx] = far
                        heapq.heappush(heap, (far, ny, nx))
    return d


@pytest.mark.parametrize("seed", [1, 2])
def test_relaxation_is_dijkstra(spark, seed):
    rng = np.random.default_rng(seed)
    cost, start = 1 + 3 * rng.random((9, 7)), rng.random((9, 7)) < 0.06
    start[0, 0] = True
    px = lattice(spark, (9, 7), cost=cost, s=start)
    want = dijkstra(cost, start)
    got = grid(spatial.geodesic_within(px, {"d": F.col("s") > 0}, 6), "d", (9, 7))
    assert np.allclose(got, np.where(want <= 6, want, np.nan), equal_nan=True)
    got = grid(spatial.geodesic_exact(px.withColumn("b", F.col("s") > 0), "b"), "dist", (9, 7))
    assert np.allclose(got, want)


def test_no_seed_reaches_nothing(spark):
    px = lattice(spark, (3, 3), cost=np.ones((3, 3)))
    assert np.isnan(grid(spatial.geodesic_within(px, {"d": F.lit(False)}, 2), "d", (3, 3))).all()
    assert np.isnan(grid(spatial.geodesic_exact(px.withColumn("b", F.lit(False)), "b"), "dist", (3, 3))).all()


def test_p95_guard(spark):
    flat = lattice(spark, (3, 3), edge=np.zeros((3, 3)))
    assert (grid(spatial.normalize_p95(flat), "edge", (3, 3)) == 0).all()


def test_blur_mirrors_without_the_border(spark):
    a = np.zeros((5, 5))
    a[0, 1] = 1
    w = np.array(spatial.gaussian_weights(0.8, 3))
    pad = np.pad(a, 3, mode="reflect")
    want = sum(w[i] * w[j] * pad[i : i + 5, j : j + 5] for i in range(7) for j in range(7))
    got = grid(spatial.gaussian_blur(lattice(spark, (5, 5), edge=a)), "edge", (5, 5))
    assert np.allclose(got, want)
    one = spatial.gaussian_blur(lattice(spark, (1, 1), edge=[[0.5]]))
    assert math.isclose(one.first().edge, 0.5)


def test_guided_filter_on_flat_and_stepped_guides(spark):
    h, w = 9, 10
    mask = np.zeros((h, w))
    mask[:, 5:] = 1
    flat = lattice(spark, (h, w), r=np.full((h, w), 7), g=np.full((h, w), 7), b=np.full((h, w), 7), m=mask)
    got = grid(spatial.guided_filter(flat, "m"), "smooth", (h, w))
    assert np.isfinite(got).all() and got.min() >= -1e-6 and got.max() <= 1 + 1e-6
    step = np.where(mask > 0, 200, 10)
    edge = lattice(spark, (h, w), r=step, g=step, b=step, m=mask)
    assert (grid(spatial.guided_filter(edge, "m"), "snapped", (h, w)) == mask).all()


def test_chamfer_without_and_with_seeds(spark):
    s = np.zeros((6, 8), bool)
    s[2, 3] = s[5, 7] = True
    want = np.min([[[min(abs(y - a), abs(x - b)) * 1.3693 + abs(abs(y - a) - abs(x - b)) * 0.955 for x in range(8)] for y in range(6)] for a, b in np.argwhere(s)], axis=0)
    assert np.allclose(spatial.chamfer(s), want)
    none = lattice(spark, (2, 2), s=np.zeros((2, 2))).withColumn("b", F.col("s") > 0)
    assert {r.dist for r in spatial.distance_transform(none, "b").collect()} == {1e6}


def test_foreground_scribble_near_background_turns_into_background(spark):
    ann = np.zeros((5, 9))
    ann[2, 2], ann[2, 3] = 2, 1
    px = lattice(spark, (5, 9), ann=ann, cost=np.ones((5, 9))).withColumn("ann", F.col("ann").cast("int"))
    out = seeds.expand(seeds.one_vs_rest(px), 3, cost="cost")
    row = out.filter("y = 2 AND x = 2").first()
    assert not row.seed_fg and row.seed_bg
    assert out.filter("seed_fg AND seed_bg").count() == 0


def masks(spark, rows):
    return spark.createDataFrame([(0, 0, x, c, fg, float(d)) for x, c, fg, d in rows], "img long, y int, x int, class_id int, fg int, dist double")


def test_exact_and_single_precision_fusion_differ(spark):
    m = masks(spark, [(0, 2, 1, 31), (0, 3, 1, 1), (1, 2, 0, 1), (1, 3, 0, 2)])
    px = m.select("img", "y", "x").distinct()
    label = lambda **k: {r.x: r.label for r in fuse.fuse_classes(m, px, **k).collect()}
    assert label() == {0: 2, 1: 0}
    assert label(exact=False) == {0: 1, 1: 0}


def test_session_fusion_modes(spark):
    m = masks(spark, [(0, 2, 1, 1), (0, 4, 1, 9), (1, 3, 1, 5), (2, 2, 0, 0)])
    px = m.select("img", "y", "x").distinct()
    assert {r.x: r.label for r in fuse.fuse_session(m, px).collect()} == {0: 1, 1: 2, 2: 0}
    assert {r.x: r.label for r in fuse.fuse_session(m, px, "last-wins").collect()} == {0: 3, 1: 2, 2: 0}
    with pytest.raises(ValueError):
        fuse.fuse_session(m, px, "first")


def test_vote_is_symmetric_unless_all_differ(spark):
    v = spark.createDataFrame([(a, b, c) for a in range(3) for b in range(3) for c in range(3)], "a int, b int, c int")
    for r in v.select("*", *[fuse.vote(F.col("a"), F.col("b"), F.col("c"), t).alias(f"t{t}") for t in range(3)]).collect():
        if len({r.a, r.b, r.c}) < 3:
            assert r.t0 == r.t1 == r.t2 == max((r.a, r.b, r.c), key=(r.a, r.b, r.c).count)
        else:
            assert (r.t0, r.t1, r.t2) == (r.a, r.b, r.c)


def test_vote_needs_three_masks(spark):
    m = spark.createDataFrame([(0, 0, 0, 0, 1), (0, 0, 0, 1, 1)], "img long, y int, x int, slot int, label int")
    with pytest.raises(Exception, match="shape"):
        fuse.majority_vote(m).collect()


def test_merge_never_clears(spark):
    s = "img long, y int, x int, ann int"
    old = spark.createDataFrame([(0, 0, 0, 2), (0, 0, 1, 1)], s)
    new = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 3), (0, 0, 2, 2)], s)
    assert sorted(tuple(r) for r in fuse.merge_annotations(old, new).collect()) == [(0, 0, 0, 2), (0, 0, 1, 3), (0, 0, 2, 2)]


def test_palette(spark):
    rows = {r["index"]: (r.r, r.g, r.b) for r in palette(spark).collect()}
    assert rows[0] == (0, 0, 0) and rows[1] == (128, 0, 0) and rows[2] == (0, 128, 0) and len(rows) == 256


def patch():
    """A bright square on a dark ground; most of the square is foreground scribble."""
    image = np.zeros((24, 24, 3))
    image[6:18, 6:18] = 200
    image += np.random.default_rng(0).normal(0, 3, image.shape)
    mask = np.full((24, 24), seeds.MAYBE_BACKGROUND)
    mask[1:4, 1:23], mask[6:15, 6:18] = seeds.BACKGROUND, seeds.FOREGROUND
    return image, mask


def test_graph_cut_finds_the_square():
    image, mask = patch()
    out, bg, fg = grabcut.segment(image, mask)
    front = np.isin(out, (seeds.FOREGROUND, seeds.MAYBE_FOREGROUND))
    assert (out[mask == seeds.BACKGROUND] == seeds.BACKGROUND).all() and (out[mask == seeds.FOREGROUND] == seeds.FOREGROUND).all()
    assert front[6:18, 6:18].all() and front.sum() == 144
    assert (grabcut.segment(image, mask)[0] == out).all()
    assert len(bg.flat()) == 65 and np.allclose(grabcut.Mixture.of(fg.flat()).cov, fg.cov)


def test_energy_does_not_rise():
    image, mask = patch()
    weights = grabcut.smoothness(image)
    last = None
    for n in (1, 2, 3, 4):
        out, bg, fg = grabcut.segment(image, mask, iterations=n)
        e = grabcut.energy(image, out, bg, fg, weights)
        assert last is None or e <= last * 1.02 + 1e-6
        last = e


def test_a_refine_of_two_rounds_is_two_of_one():
    image, mask = patch()
    _, bg, fg = grabcut.segment(image, mask, iterations=1)
    one, bg1, fg1 = grabcut.segment(image, mask, (bg, fg), 1)
    twice, bg2, fg2 = grabcut.segment(image, one, (bg1, fg1), 1)
    both, bg3, fg3 = grabcut.segment(image, mask, (bg, fg), 2)
    assert (twice == both).all() and np.allclose(bg2.flat(), bg3.flat()) and np.allclose(fg2.flat(), fg3.flat())


def test_refining_runs_the_rounds_it_is_given(spark):
    image, mask = patch()
    cells = [(0, 2, y, x, *(int(v) for v in np.clip(image[y, x], 0, 255)), int(mask[y, x])) for y in range(24) for x in range(24)]
    rows = spark.createDataFrame(cells, "img long, class_id int, y int, x int, f0 int, f1 int, f2 int, trimap int")
    models = grabcut.grabcut(rows, iterations=1).filter("bg_model IS NOT NULL").select("img", "class_id", "bg_model", "fg_model")
    flat = models.first()
    got = grabcut.grabcut(rows.join(models, ["img", "class_id"]), iterations=3).filter("bg_model IS NOT NULL").first()
    exact = np.array([[c[4], c[5], c[6]] for c in cells], float).reshape(24, 24, 3)
    _, bg, _ = grabcut.segment(exact, mask, (grabcut.Mixture.of(flat.bg_model), grabcut.Mixture.of(flat.fg_model)), 3)
    assert got.iterations == 3 and np.allclose(got.bg_model, bg.flat())


def test_an_ensemble_fuses_as_its_slots_do(spark):
    rng = np.random.default_rng(6)
    cells = [(0, y, x) for y in range(4) for x in range(5)]
    masks = [(*c, k, s, int(rng.random() < 0.5), float(rng.integers(0, 3))) for c in cells[:-2] for k in (2, 3, 4) for s in range(3)]
    px = spark.createDataFrame(cells, "img long, y int, x int")
    m = spark.createDataFrame(masks, "img long, y int, x int, class_id int, slot int, fg int, dist double")
    for tie in (0, 1, 2):
        apart = functools.reduce(lambda a, b: a.unionByName(b), [fuse.fuse_classes(m.filter(f"slot = {s}"), px).selectExpr("*", f"{s} AS slot") for s in range(3)])
        assert sorted(fuse.fuse_slots(m, px, tie).collect()) == sorted(fuse.majority_vote(apart, tie).collect())


def test_default_radius_on_images_of_unequal_size(spark):
    rng = np.random.default_rng(7)
    shapes = {1: (31, 47), 2: (52, 20)}
    cost = {i: 1 + 3 * rng.random(s) for i, s in shapes.items()}
    seed = {i: rng.random(s) < 0.004 for i, s in shapes.items()}
    rows = [(i, y, x, float(cost[i][y, x]), bool(seed[i][y, x]), "z") for i, (h, w) in shapes.items() for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "img long, y int, x int, cost double, mark boolean, other string")
    got = {(r.img, r.y, r.x): r.d for r in spatial.geodesic_within(df, {"d": df.mark}, 12).collect()}
    every = {(r.img, r.y, r.x): r.dist for r in spatial.geodesic_exact(df, "mark").collect()}
    assert set(got) == set(every) and sum(d is not None for d in got.values()) > 300
    for k, d in every.items():
        assert (got[k] is None) == (d is None or d > 12) and (got[k] is None or math.isclose(got[k], d))


def test_min_cut_is_minimal_on_small_grids():
    rng = np.random.default_rng(5)
    for _ in range(4):
        h, w = 3, 3
        a, b = rng.random((h, w)) * 5, rng.random((h, w)) * 5
        weights = np.stack([rng.random((h, w)) * grabcut._shift(np.ones((h, w)), dy, dx, 0.0) for dy, dx, _ in grabcut.AROUND])

        def value(front):
            cut = sum((wt * (front != grabcut._shift(front.astype(float), dy, dx, 0.0).astype(bool))).sum() for wt, (dy, dx, _) in zip(weights, grabcut.AROUND, strict=True))
            return a[~front].sum() + b[front].sum() + cut

        best = min(value(np.array([(k >> i) & 1 for i in range(9)], bool).reshape(h, w)) for k in range(512))
        assert math.isclose(value(grabcut.min_cut(a.copy(), b.copy(), weights.copy())), best, rel_tol=1e-6)


def test_empty_foreground_has_no_model(spark):
    rows = spark.createDataFrame([(0, 2, y, x, 1, 2, 3, 2) for y in range(3) for x in range(3)], "img long, class_id int, y int, x int, f0 int, f1 int, f2 int, trimap int")
    out = grabcut.grabcut(rows)
    assert out.filter("fg <> 0 OR bg_model IS NOT NULL").count() == 0
    assert grabcut.Mixture.of([0.0] * 65) is None


def test_ensemble_needs_three_spaces(spark):
    with pytest.raises(ValueError):
        segment.segment_ensemble(None, ("oklab", "xyz"))


def test_no_class_gives_background_everywhere(spark):
    a = np.zeros((4, 4))
    px = lattice(spark, (4, 4), r=a, g=a, b=a, edge=a, ann=a).withColumns({"ann": F.lit(1), **{c: F.col(c).cast("int") for c in "rgb"}})
    assert {r.label for r in segment.segment_single(px, radius=2).collect()} == {0}


def test_annotation_range(spark):
    ok = spark.createDataFrame([(0, 0), (0, 30)], "img long, ann int")
    assert seeds.check_annotations(ok).first().warn
    with pytest.raises(Exception, match="out of range"):
        seeds.check_annotations(spark.createDataFrame([(0, 300)], "img long, ann int")).collect()


def test_lines_and_strokes(spark):
    assert strokes.line_cells(0, 0, 3, 1) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert strokes.line_cells(2, 2, 2, 2) == [(2, 2)]
    schema = "img long, seq long, class_id int, brush int, points array<struct<x:int,y:int>>"
    s = spark.createDataFrame([(0, 1, 1, 1, [(0, 0), (3, 0)]), (0, 2, 2, 1, [(3, 0), (3, 9)]), (0, 3, 3, 5, [(1, 1)]), (0, 4, 1, 3, None)], schema)
    sizes = spark.createDataFrame([(0, 4, 4)], "img long, h int, w int")
    got = {(r.y, r.x): r.ann for r in strokes.rasterise(s, sizes).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (0, 2): 1, (0, 3): 2, (1, 3): 2, (2, 3): 2, (3, 3): 2}
    left = strokes.erase(s, spark.createDataFrame([(0, 3, 8, 2)], "img long, x int, y int, brush int"))
    assert sorted(r.seq for r in left.collect()) == [1, 3, 4]


def test_history_against_a_list_model(spark):
    import random

    rng = random.Random(3)
    log = [(s, k, rng.choice(["add", "add", "undo", "redo", "clear", "undo"]), k) for s in range(6) for k in range(30)]
    want = {}
    for s in range(6):
        now, undo, redo = [], [], []
        for _, k, a, _ in (r for r in log if r[0] == s):
            if a in ("add", "clear"):
                undo, redo, now = [*undo, now], [], [*now, k] if a == "add" else []
            elif a == "undo" and undo:
                undo, redo, now = undo[:-1], [*redo, now], undo[-1]
            elif a == "redo" and redo:
                undo, redo, now = [*undo, now], redo[:-1], redo[-1]
        want[s] = now
    df = spark.createDataFrame(log, "session long, seq long, action string, stroke long")
    assert {r.session: r.present for r in strokes.history(df).collect()} == want


def test_small_groups_share_numpy_calls_and_come_out_as_alone(spark):
    """Images of two sizes, in batches that cut through them, one with a null key and one without foreground."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for img, (h, w) in enumerate([(6, 5), (7, 4)] * 9):
        image, mask = rng.integers(0, 256, (h, w, 3)), rng.choice([0, 1, 2], (h, w), p=[0.3, 0.2, 0.5])
        if img == 4:
            mask[mask == 1] = 2
        name = None if img == 7 else img
        rows += [(name, 2, y, x, *map(int, image[y, x]), int(mask[y, x])) for y in range(h) for x in range(w)]
        cut = grabcut.segment(image, mask)[0] if (mask == 1).any() else mask
        want |= {(name, y, x): int(cut[y, x] in (1, 3)) for y in range(h) for x in range(w)}
    df = spark.createDataFrame(rows, "img long, class_id int, y int, x int, f0 int, f1 int, f2 int, trimap int").repartition(2, "img")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "17")
    try:
        assert {(r.img, r.y, r.x): r.fg for r in grabcut.grabcut(df).collect()} == want

        def sizes(tables):
            yield pa.table({"n": [len(tables)], "rows": [sum(t.num_rows for t in tables)]})

        got = spatial.in_groups(df, ["img", "class_id"], sizes, "n long, rows long").collect()
        assert sum(r.n for r in got) == 18 and sum(r.rows for r in got) == len(rows) and len(got) < 18
    finally:
        spark.conf.set(name, before)


def test_a_group_larger_than_what_goes_together(monkeypatch):
    monkeypatch.setattr(spatial, "TOGETHER", 10)
    parts = []

    class Frame:
        def mapInArrow(self, f, schema):  # noqa: N802
            return f

    def work(tables):
        parts.append([t.num_rows for t in tables])
        yield pa.concat_tables(tables)

    run = spatial.in_groups(Frame(), ["k"], work, "k long", placed=True)
    keys = [1] * 4 + [2] * 45 + [3] * 3 + [4] * 3 + [5] * 9
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 6]}) for i in range(0, len(keys), 6)]
    assert [k for b in run(iter(batches)) for k in b["k"].to_pylist()] == keys
    assert sorted(sum(parts, [])) == [3, 3, 4, 9, 45] and max(map(len, parts)) > 1
