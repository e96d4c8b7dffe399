"""Queries over neighbourhoods, seeds, masks and fusion (O-40 to O-54, O-60 to O-76)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pixelweft.operators import fuse, seeds, segment, spatial, strokes
from pixelweft.operators.features import features
from pixelweft.operators.grabcut import grabcut
from pixelweft.plans.fixtures import PX, pixels
from pixelweft.plans.registry import query

#: The test images are 16 x 16: the usual radius of 12 would reach every pixel.
SMALL_RADIUS = 3
PIXEL = ["img", "y", "x"]


def _px(spark, sf_dir):
    return pixels(spark, sf_dir, extra=True)


@query("o40_classes", f"WITH {PX} SELECT DISTINCT img, ann AS class_id FROM px WHERE ann > 1")
def o40(spark, sf_dir):
    return seeds.classes(_px(spark, sf_dir))


OVR = "ovr AS (SELECT px.*, c.class_id, ann = c.class_id AS seed_fg, (ann = 1 OR (ann > 1 AND ann <> c.class_id)) AS seed_bg FROM px JOIN (SELECT DISTINCT img, ann AS class_id FROM px WHERE ann > 1) c USING (img))"


@query("o41_one_vs_rest", f"WITH {PX}, {OVR} SELECT img, y, x, class_id, seed_fg, seed_bg FROM ovr")
def o41(spark, sf_dir):
    return seeds.one_vs_rest(_px(spark, sf_dir)).select(*PIXEL, "class_id", "seed_fg", "seed_bg")


@query("o42_empty_guard", f"WITH {PX} SELECT px.img, y, x, coalesce(k.n, 0) AS n_classes, CASE WHEN coalesce(k.n, 0) = 0 THEN 0 ELSE ann END AS label FROM px LEFT JOIN (SELECT img, count(DISTINCT ann) AS n FROM px WHERE ann > 1 AND img % 2 = 0 GROUP BY img) k USING (img)")
def o42(spark, sf_dir):
    px = _px(spark, sf_dir)
    n = seeds.classes(px.filter("img % 2 = 0")).groupBy("img").agg(F.count("*").alias("n"))
    n_classes = F.coalesce("n", F.lit(0).cast("long"))
    return px.join(n, "img", "left").select(*PIXEL, n_classes.alias("n_classes"), F.when(n_classes == 0, 0).otherwise(F.col("ann")).alias("label"))


@query("o42b_bool_mask", f"WITH {PX} SELECT img, y, x, ((((r - 128) * 64) % 256 + 256) % 256) > 0 AS m FROM px")
def o42b(spark, sf_dir):
    return _px(spark, sf_dir).select(*PIXEL, seeds.as_bool((F.col("r") - 128) * 64).alias("m"))


@query("o42c_range_check", f"WITH {PX} SELECT img, min(ann) AS least, max(ann) AS most, (max(ann) > 21 OR min(ann) < 0) AS warn FROM px GROUP BY img")
def o42c(spark, sf_dir):
    return seeds.check_annotations(_px(spark, sf_dir))


_TAPS = spatial.gaussian_weights(0.8, 3)
_SOBEL = """sv AS (SELECT img, y, x, (r + g + b) / 3e0 AS v FROM px),
 s1 AS (SELECT *, coalesce(lag(v) OVER a, v) AS l, coalesce(lead(v) OVER a, v) AS r FROM sv WINDOW a AS (PARTITION BY img, y ORDER BY x)),
 s2 AS (SELECT *, r - l AS sx, l + 2 * v + r AS sy FROM s1),
 s3 AS (SELECT *, coalesce(lag(sx) OVER a, sx) + 2 * sx + coalesce(lead(sx) OVER a, sx) AS gx, coalesce(lead(sy) OVER a, sy) - coalesce(lag(sy) OVER a, sy) AS gy FROM s2 WINDOW a AS (PARTITION BY img, x ORDER BY y))"""


@query("o43_sobel_edges", f"WITH {PX}, {_SOBEL} SELECT img, y, x, round(sqrt(gx * gx + gy * gy), 6) AS edge FROM s3")
def o43(spark, sf_dir):
    """A stand-in: the learned edge detector's model isn't public here, so edge maps are an input."""
    px = pixels(spark, sf_dir)
    return spatial.sobel_edges(px, (F.col("r") + F.col("g") + F.col("b")) / 3.0).select(*PIXEL, F.round("edge", 6).alias("edge"))


P95 = "pn AS (SELECT px.* REPLACE (CASE WHEN p > 1e-6 THEN least(greatest(edge / p, 0e0), 1e0) ELSE edge END AS edge) FROM px JOIN (SELECT img, quantile_cont(edge, 0.95) AS p FROM px GROUP BY img) q USING (img))"


@query("o44_p95", f"WITH {PX}, {P95} SELECT img, y, x, round(edge, 6) AS edge FROM pn")
def o44(spark, sf_dir):
    return spatial.normalize_p95(_px(spark, sf_dir)).select(*PIXEL, F.round("edge", 6).alias("edge"))


def blur_sql(src: str) -> str:
    """Two passes over a 16 x 16 lattice; places beyond the border are mirrored without the last pixel."""
    at = lambda e: f"(CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > 15 THEN 30 - ({e}) ELSE {e} END)"
    total = lambda line, i: " + ".join(f"{w!r}::DOUBLE * {line}[1 + {at(f'{i} + ({k - 3})')}]" for k, w in enumerate(_TAPS))
    return f"""bx0 AS (SELECT img, y, list(edge ORDER BY x) AS line FROM {src} GROUP BY img, y),
 bx AS (SELECT {src}.img, {src}.y, x, {total("line", "x")} AS e1 FROM {src} JOIN bx0 USING (img, y)),
 by0 AS (SELECT img, x, list(e1 ORDER BY y) AS line FROM bx GROUP BY img, x),
 bl AS (SELECT bx.img, y, bx.x, {total("line", "y")} AS edge FROM bx JOIN by0 USING (img, x))"""


@query("o45_gaussian_blur", f"WITH {PX}, {blur_sql('px')} SELECT img, y, x, round(edge, 6) AS edge FROM bl")
def o45(spark, sf_dir):
    return spatial.gaussian_blur(_px(spark, sf_dir).select(*PIXEL, "edge")).select(*PIXEL, F.round("edge", 6).alias("edge"))


COST = "cs AS (SELECT img, y, x, 1e0 + 3e0 * pow(edge, 0.8e0) AS cost2 FROM bl)"


@query("o46_edge_cost", f"WITH {PX}, {P95}, {blur_sql('pn')}, {COST} SELECT img, y, x, round(cost2, 6) AS cost FROM cs")
def o46(spark, sf_dir):
    e = spatial.gaussian_blur(spatial.normalize_p95(_px(spark, sf_dir)).select(*PIXEL, "edge"))
    return e.select(*PIXEL, F.round(spatial.edge_cost(F.col("edge")), 6).alias("cost"))


def relax_sql(src: str, names: list[str], radius: int, cost: str, keys: str = "img", eight: bool = True) -> str:
    """Rounds of taking the least over neighbours, as steps g0, g1, ... of a query."""
    out, last = [], src
    rest = f"{keys}, y, x, {cost}"
    for i in range(radius):
        cols = [*names, cost]
        rows = ", ".join(f"lag({n}) OVER a AS l_{n}, lead({n}) OVER a AS r_{n}" for n in cols)
        h = ["", "l_", "r_"] if eight else [""]
        lines = ", ".join(f"{f}({s}{n}) OVER b AS {v}{s}{n}" for v, f in (("u", "lag"), ("d", "lead")) for s in h for n in cols)
        near = lambda n: ", ".join(f"{p}{n} + {w!r}::DOUBLE * 0.5e0 * ({cost} + {p}{cost})" for p, w in [("l_", 1.0), ("r_", 1.0), *[(v + s, math.sqrt(2.0) if s else 1.0) for v in "ud" for s in h]])
        out.append(f"ga{i} AS (SELECT *, {rows} FROM {last} WINDOW a AS (PARTITION BY {keys}, y ORDER BY x))")
        out.append(f"gb{i} AS (SELECT *, {lines} FROM ga{i} WINDOW b AS (PARTITION BY {keys}, x ORDER BY y))")
        out.append(f"g{i} AS (SELECT {rest}, {', '.join(f'least({n}, {near(n)}) AS {n}' for n in names)} FROM gb{i})")
        last = f"g{i}"
    return ", ".join(out)


def _geo(radius: int, eight: bool = True) -> str:
    return f"""WITH {PX}, s AS (SELECT img, y, x, cost, CASE WHEN ann > 1 THEN 0e0 END AS d FROM px), {relax_sql('s', ['d'], radius, 'cost', eight=eight)}
     SELECT img, y, x, round(CASE WHEN d <= {radius} THEN d END, 6) AS d FROM g{radius - 1}"""


@query("o47_geodesic_12", _geo(12))
def o47(spark, sf_dir):
    px = _px(spark, sf_dir).select(*PIXEL, "ann", "cost")
    return spatial.geodesic_within(px, {"d": F.col("ann") > 1}, 12).select(*PIXEL, F.round("d", 6).alias("d"))


@query("o47_geodesic_4_connected", _geo(5, eight=False))
def o47_four(spark, sf_dir):
    px = _px(spark, sf_dir).select(*PIXEL, "ann", "cost")
    return spatial.geodesic_within(px, {"d": F.col("ann") > 1}, 5, eight=False).select(*PIXEL, F.round("d", 6).alias("d"))


@query("o47_geodesic_exact", _geo(40).replace("CASE WHEN d <= 40 THEN d END", "d").replace("AS d FROM g39", "AS dist FROM g39"))
def o47_exact(spark, sf_dir):
    px = _px(spark, sf_dir).withColumn("seed", F.col("ann") > 1)
    return spatial.geodesic_exact(px, "seed").select(*PIXEL, F.round("dist", 6).alias("dist"))


EXPAND = f"""{P95}, {blur_sql('pn')}, {COST}, {OVR},
 sd AS (SELECT ovr.img, ovr.class_id, ovr.y, ovr.x, cost2, CASE WHEN seed_fg THEN 0e0 END AS df, CASE WHEN seed_bg THEN 0e0 END AS db FROM ovr JOIN cs USING (img, y, x)),
 {relax_sql('sd', ['df', 'db'], SMALL_RADIUS, 'cost2', 'img, class_id')},
 ex AS (SELECT g.img, g.class_id, g.y, g.x, coalesce(df <= {SMALL_RADIUS}, false) AND NOT coalesce(db <= {SMALL_RADIUS}, false) AND NOT seed_bg AS seed_fg,
   coalesce(db <= {SMALL_RADIUS}, false) OR seed_bg AS seed_bg FROM g{SMALL_RADIUS - 1} g JOIN ovr USING (img, class_id, y, x))"""


@query("o48_expand_seeds", f"WITH {PX}, {EXPAND} SELECT img, class_id, y, x, seed_fg, seed_bg FROM ex")
def o48(spark, sf_dir):
    return seeds.expand(seeds.one_vs_rest(_px(spark, sf_dir)), SMALL_RADIUS).select("img", "class_id", "y", "x", "seed_fg", "seed_bg")


def _guided_sql() -> str:
    g = ("r", "g", "b")
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    first = {f"i{k}": f"{c}::DOUBLE" for k, c in enumerate(g)} | {"p": "m::DOUBLE"} | {f"ip{k}": f"{c}::DOUBLE * m" for k, c in enumerate(g)} | {f"ii{a}{b}": f"{g[a]}::DOUBLE * {g[b]}" for a, b in pairs}

    def box(src: str, out: str, cols: list[str], keep: str) -> str:
        rows = ", ".join(f"sum({c}) OVER a AS {c}" for c in cols)
        lines = ", ".join(f"sum({c}) OVER b / sum(n) OVER b AS {c}" for c in cols)
        return f"""{out}r AS (SELECT {keep}, {rows}, count(*) OVER a AS n FROM {src} WINDOW a AS (PARTITION BY img, y ORDER BY x RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
 {out} AS (SELECT {keep}, {lines} FROM {out}r WINDOW b AS (PARTITION BY img, x ORDER BY y RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING))"""

    keep = "img, y, x, r, g, b"
    c = {f"c{a}{b}": f"ii{a}{b} - i{a} * i{b}" + (" + 1e-6" if a == b else "") for a, b in pairs} | {f"v{k}": f"ip{k} - i{k} * p" for k in range(3)}
    minors = {"m00": "c11 * c22 - c12 * c12", "m01": "-(c01 * c22 - c12 * c02)", "m02": "c01 * c12 - c11 * c02", "m11": "c00 * c22 - c02 * c02", "m12": "-(c00 * c12 - c01 * c02)", "m22": "c00 * c11 - c01 * c01"}
    sel = lambda d: ", ".join(f"{e} AS {k}" for k, e in d.items())
    return f"""WITH {PX}, q0 AS (SELECT *, CASE WHEN vote_a > 0 THEN 1 ELSE 0 END AS m FROM px), q1 AS (SELECT {keep}, {sel(first)} FROM q0),
 {box('q1', 'q2', list(first), keep)}, q3 AS (SELECT *, {sel(c)} FROM q2), q4 AS (SELECT *, {sel(minors)} FROM q3), q5 AS (SELECT *, c00 * m00 + c01 * m01 + c02 * m02 AS det FROM q4),
 q6 AS (SELECT *, (m00 * v0 + m01 * v1 + m02 * v2) / det AS a0, (m01 * v0 + m11 * v1 + m12 * v2) / det AS a1, (m02 * v0 + m12 * v1 + m22 * v2) / det AS a2 FROM q5),
 q7 AS (SELECT *, p - a0 * i0 - a1 * i1 - a2 * i2 AS a3 FROM q6), {box('q7', 'q8', ['a0', 'a1', 'a2', 'a3'], keep)}
 SELECT img, y, x, round(a0 * r + a1 * g + a2 * b + a3, 4) AS smooth, CASE WHEN a0 * r + a1 * g + a2 * b + a3 >= 0.5 THEN 1 ELSE 0 END AS snapped FROM q8"""


@query("o49_guided_filter", _guided_sql())
def o49(spark, sf_dir):
    px = _px(spark, sf_dir).withColumn("m", F.when(F.col("vote_a") > 0, 1).otherwise(0))
    return spatial.guided_filter(px, "m").select(*PIXEL, F.round("smooth", 4).alias("smooth"), "snapped")


#: The chamfer distance between two pixels in closed form: diagonal steps first.
CHAMFER = "least(abs(p.x - s.x), abs(p.y - s.y)) * 1.3693e0 + (greatest(abs(p.x - s.x), abs(p.y - s.y)) - least(abs(p.x - s.x), abs(p.y - s.y))) * 0.955e0"
DIST = f"ds AS (SELECT p.img, p.y, p.x, s.ann AS class_id, min({CHAMFER}) AS dist FROM px p JOIN px s ON p.img = s.img AND s.ann > 1 GROUP BY ALL)"


@query("o50_scribble_distance", f"WITH {PX}, {DIST} SELECT img, y, x, class_id, round(dist, 6) AS dist FROM ds")
def o50(spark, sf_dir):
    return segment.scribble_distances(_px(spark, sf_dir)).select(*PIXEL, "class_id", F.round("dist", 6).alias("dist"))


@query("o51_resize_nearest", f"WITH {PX} SELECT px.img, ny::INT AS y, nx::INT AS x, ann FROM (SELECT unnest(range(20)) AS ny) a, (SELECT unnest(range(10)) AS nx) b JOIN px ON px.y = least(floor(ny * 16 / 20e0), 15) AND px.x = least(floor(nx * 16 / 10e0), 15)")
def o51(spark, sf_dir):
    px = _px(spark, sf_dir)
    sizes = px.select("img").distinct().withColumns({"sh": F.lit(16), "sw": F.lit(16), "dh": F.lit(20), "dw": F.lit(10)})
    return spatial.resize_nearest(px.select(*PIXEL, "ann"), sizes).select(*PIXEL, "ann")


def stroke_fixture(spark, sf_dir):
    """Strokes of 32 points: one for each run of 32 events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    p = e.select(F.floor(F.col("event_id") / 32).cast("long").alias("s"), "event_id", F.struct((F.col("user_id") * 7 % 20 - 2).cast("int").alias("x"), ((F.col("user_id") * 3 + F.col("event_id")) % 20 - 2).cast("int").alias("y")).alias("p"))
    g = p.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "p"))), lambda v: v.p).alias("points"))
    return g.select(F.floor(F.col("s") / 8).cast("long").alias("img"), F.col("s").alias("seq"), (1 + F.col("s") % 3).cast("int").alias("class_id"), (1 + F.col("s") % 5).cast("int").alias("brush"), "points")


STROKES = """pt AS (SELECT event_id // 32 AS seq, event_id, CAST(user_id * 7 % 20 - 2 AS INT) AS x, CAST((user_id * 3 + event_id) % 20 - 2 AS INT) AS y FROM events),
 st AS (SELECT seq // 8 AS img, seq, CAST(1 + seq % 3 AS INT) AS class_id, CAST(1 + seq % 5 AS INT) AS brush, list(x ORDER BY event_id) AS xs, list(y ORDER BY event_id) AS ys FROM pt GROUP BY seq)"""


#: A line's cells, one step of every line in each round.
LINES = f"""{STROKES},
 sg AS (SELECT img, seq, class_id, brush // 2 AS radius, unnest(range(1, len(xs))) AS part, xs, ys FROM st),
 se AS (SELECT img, seq, class_id, radius, part, greatest(0, least(15, xs[part])) AS x1, greatest(0, least(15, ys[part])) AS y1, greatest(0, least(15, xs[part + 1])) AS x2, greatest(0, least(15, ys[part + 1])) AS y2 FROM sg),
 ln AS (SELECT img, seq, class_id, radius, part, 0 AS step, x1 AS x, y1 AS y, x2, y2, abs(x2 - x1) AS dx, abs(y2 - y1) AS dy, abs(x2 - x1) - abs(y2 - y1) AS slack, CASE WHEN x1 < x2 THEN 1 ELSE -1 END AS sx, CASE WHEN y1 < y2 THEN 1 ELSE -1 END AS sy FROM se
  UNION ALL SELECT img, seq, class_id, radius, part, step + 1, CASE WHEN 2 * slack > -dy THEN x + sx ELSE x END, CASE WHEN 2 * slack < dx THEN y + sy ELSE y END, x2, y2, dx, dy,
   slack - CASE WHEN 2 * slack > -dy THEN dy ELSE 0 END + CASE WHEN 2 * slack < dx THEN dx ELSE 0 END, sx, sy FROM ln WHERE x <> x2 OR y <> y2),
 dk AS (SELECT img, seq, part, step, class_id, y + a.i AS y, x + b.i AS x FROM ln, range(-2, 3) a(i), range(-2, 3) b(i) WHERE a.i * a.i + b.i * b.i <= radius * radius AND abs(a.i) <= radius AND abs(b.i) <= radius)"""


@query("o52_rasterise", f"WITH RECURSIVE {LINES} SELECT img, y::INT AS y, x::INT AS x, arg_max(class_id, (seq, part, step)) AS ann FROM dk WHERE y BETWEEN 0 AND 15 AND x BETWEEN 0 AND 15 GROUP BY ALL")
def o52(spark, sf_dir):
    s = stroke_fixture(spark, sf_dir)
    sizes = s.select("img").distinct().withColumns({"h": F.lit(16), "w": F.lit(16)})
    return strokes.rasterise(s, sizes)


@query("o53_erase", f"WITH {STROKES}, er AS (SELECT img, xs[1] + 1 AS ex, ys[1] AS ey, 2 AS eb FROM st WHERE seq % 8 = 0) SELECT img, seq, class_id FROM st WHERE NOT EXISTS (SELECT 1 FROM er, pt WHERE er.img = st.img AND pt.seq = st.seq AND (pt.x - ex) * (pt.x - ex) + (pt.y - ey) * (pt.y - ey) < eb * eb)")
def o53(spark, sf_dir):
    s = stroke_fixture(spark, sf_dir)
    eraser = s.filter("seq % 8 = 0").select("img", (F.col("points")[0].x + 1).alias("x"), F.col("points")[0].y.alias("y"), F.lit(2).alias("brush"))
    return strokes.erase(s, eraser).select("img", "seq", "class_id")


@query("o54_coordinates", "SELECT event_id, CAST(trunc((value - ((640e0 - 16 * 2.5e0) / 2 + user_id % 7)) / 2.5e0) AS INT) AS image_x, CAST(trunc(event_id % 16 * 2.5e0 + ((640e0 - 16 * 2.5e0) / 2 + user_id % 7)) AS INT) AS view_x FROM events")
def o54(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    args = F.lit(640.0), F.lit(16), F.lit(2.5), F.col("user_id") % 7
    return e.select("event_id", strokes.to_image(F.col("value"), *args).alias("image_x"), strokes.to_view(F.col("event_id") % 16, *args).alias("view_x"))


@query("o60_trimap", f"WITH {PX}, {OVR} SELECT img, y, x, class_id, CASE WHEN seed_fg THEN 1 WHEN seed_bg THEN 0 ELSE 2 END AS trimap FROM ovr")
def o60(spark, sf_dir):
    return seeds.one_vs_rest(_px(spark, sf_dir)).select(*PIXEL, "class_id", seeds.trimap().alias("trimap"))


def _cut_input(spark, sf_dir):
    px = _px(spark, sf_dir)
    tri = seeds.one_vs_rest(px).select(*PIXEL, "class_id", seeds.trimap().alias("trimap"))
    return tri.join(features(px.select(*PIXEL, "r", "g", "b"), "oklab"), PIXEL)


@query("o61_grabcut")
def o61(spark, sf_dir):
    return grabcut(_cut_input(spark, sf_dir)).select("img", "class_id", "y", "x", "fg")


@query("o62_grabcut_refine")
def o62(spark, sf_dir):
    """A second run with the first one's models."""
    rows = _cut_input(spark, sf_dir)
    models = grabcut(rows).filter("bg_model IS NOT NULL").select("img", "class_id", "bg_model", "fg_model")
    return grabcut(rows.join(models, ["img", "class_id"], "left")).select("img", "class_id", "y", "x", "fg")


#: What holds of any cut: seeds of a class belong to it, those of the background and of other classes don't, and a class without seeds has no pixel.
_KEPT = f"WITH {PX}, {OVR} SELECT img, class_id, count(*) AS n_pixels, count_if(seed_fg) AS fg_kept, 0::BIGINT AS bg_taken FROM ovr GROUP BY img, class_id"


def _kept(px, cut):
    rows = seeds.one_vs_rest(px).select(*PIXEL, "class_id", "seed_fg", "seed_bg").join(cut, [*PIXEL, "class_id"])
    one = lambda c: F.count_if(F.col(c) & (F.col("fg") == 1))
    return rows.groupBy("img", "class_id").agg(F.count("*").alias("n_pixels"), one("seed_fg").alias("fg_kept"), one("seed_bg").alias("bg_taken"))


@query("o61_grabcut_keeps_seeds", _KEPT)
def o61_seeds(spark, sf_dir):
    return _kept(_px(spark, sf_dir), o61(spark, sf_dir))


@query("o62_refine_keeps_seeds", _KEPT)
def o62_seeds(spark, sf_dir):
    return _kept(_px(spark, sf_dir), o62(spark, sf_dir))


@query("o63_labels_are_classes", f"WITH {PX} SELECT img, count(*) AS n_pixels, 0::BIGINT AS n_foreign FROM px GROUP BY img")
def o63_labels(spark, sf_dir):
    """Labels of a whole segmentation are 0, or one less than a class that the image's scribbles have."""
    px = _px(spark, sf_dir)
    own = seeds.classes(px).groupBy("img").agg(F.collect_set("class_id").alias("own"))
    rows = o63(spark, sf_dir).join(own, "img", "left")
    foreign = (F.col("label") != 0) & ~F.coalesce(F.array_contains("own", F.col("label") + 1), F.lit(False))
    return rows.groupBy("img").agg(F.count("*").alias("n_pixels"), F.count_if(foreign).alias("n_foreign"))


@query("o63_one_space_segmentation")
def o63(spark, sf_dir):
    return segment.segment_single(_px(spark, sf_dir), "oklab", radius=SMALL_RADIUS)


@query("o60_grabcut_ensemble")
def ensemble(spark, sf_dir):
    """The whole default segmentation: seeds, cuts in three spaces, smoothing, fusion and vote."""
    return segment.segment_ensemble(_px(spark, sf_dir), radius=SMALL_RADIUS)


def _masks(spark, sf_dir):
    """Claims of two classes on each pixel, by the vote columns."""
    px = _px(spark, sf_dir)
    d = segment.scribble_distances(px)
    claim = F.when(F.col("class_id") == 2, F.col("vote_a") > 0).otherwise(F.col("vote_b") > 0)
    return px, d.join(px.select(*PIXEL, "vote_a", "vote_b"), PIXEL).select(*PIXEL, "class_id", claim.cast("int").alias("fg"), F.round("dist", 6).alias("dist"))


MASKS = f"{DIST}, mk AS (SELECT ds.* REPLACE (round(dist, 6) AS dist), CASE WHEN class_id = 2 THEN vote_a > 0 ELSE vote_b > 0 END::INT AS fg FROM ds JOIN px USING (img, y, x))"


def _fused(won: str) -> str:
    return f"WITH {PX}, {MASKS}, w AS ({won}) SELECT px.img, px.y, px.x, CAST(coalesce(w.class_id - 1, 0) AS INT) AS label FROM px LEFT JOIN w USING (img, y, x)"


@query("o70_fuse_classes", _fused("SELECT img, y, x, arg_min(class_id, (dist, class_id)) AS class_id FROM mk WHERE fg > 0 GROUP BY ALL"))
def o70(spark, sf_dir):
    px, masks = _masks(spark, sf_dir)
    return fuse.fuse_classes(masks, px)


@query("o70_fuse_classes_f32", _fused("SELECT img, y, x, arg_max(class_id, (CAST(fg::FLOAT * 1e9::FLOAT - dist::FLOAT AS FLOAT), -class_id)) AS class_id FROM mk WHERE fg > 0 GROUP BY ALL"))
def o70_f32(spark, sf_dir):
    px, masks = _masks(spark, sf_dir)
    return fuse.fuse_classes(masks, px, exact=False)


@query("o71_fuse_session", _fused("SELECT img, y, x, arg_min(class_id, (dist, class_id)) AS class_id FROM mk WHERE fg > 0 GROUP BY ALL"))
def o71(spark, sf_dir):
    px, masks = _masks(spark, sf_dir)
    return fuse.fuse_session(masks, px)


@query("o72_fuse_last_wins", _fused("SELECT img, y, x, max(class_id) AS class_id FROM mk WHERE fg > 0 GROUP BY ALL"))
def o72(spark, sf_dir):
    px, masks = _masks(spark, sf_dir)
    return fuse.fuse_session(masks, px, "last-wins")


for _t in (0, 1, 2):

    @query(f"o73_majority_vote_tie{_t}", f"WITH {PX} SELECT img, y, x, CASE WHEN vote_a = vote_b OR vote_a = vote_c THEN vote_a WHEN vote_b = vote_c THEN vote_b ELSE {('vote_a', 'vote_b', 'vote_c')[_t]} END AS label FROM px")
    def o73(spark, sf_dir, tie=_t):
        px = _px(spark, sf_dir)
        slots = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.col(f"vote_{c}").alias("label")) for k, c in enumerate("abc")]))
        return fuse.majority_vote(px.select(*PIXEL, slots.alias("s")).select(*PIXEL, "s.slot", "s.label"), tie)


@query("o76_merge_annotations", f"WITH {PX} SELECT img, y, x, CASE WHEN vote_c > 0 AND img % 3 = 0 THEN vote_c ELSE ann END AS ann FROM px")
def o76(spark, sf_dir):
    px = _px(spark, sf_dir)
    return fuse.merge_annotations(px.select(*PIXEL, "ann"), px.filter("img % 3 = 0").select(*PIXEL, F.col("vote_c").alias("ann")))


@query("o88_mean_iou", f"WITH {PX}, t AS (SELECT label, sum(tp)::DOUBLE / sum(1) AS iou FROM (SELECT unnest(CASE WHEN vote_a = vote_b THEN [vote_a] ELSE [vote_a, vote_b] END) AS label, (vote_a = vote_b)::INT AS tp FROM px) GROUP BY label) SELECT label, round(iou, 6) AS iou FROM t")
def o88(spark, sf_dir):
    px = _px(spark, sf_dir).select(F.col("vote_a").alias("truth"), F.col("vote_b").alias("label"))
    return fuse.mean_iou(px).select("label", F.round("iou", 6).alias("iou"))
