"""Queries over listings, palettes, aggregates, reports and sessions (O-02 to O-16, O-80 to O-95, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelweft.operators import palette as colors
from pixelweft.operators import strokes
from pixelweft.operators.batch import run_batch
from pixelweft.plans.fixtures import PX, pixels, table
from pixelweft.plans.registry import query
from pixelweft.runtime import workspace
from pixelweft.sources import images, sessions
from pixelweft.streaming.session import session_batch

PIXEL = ["img", "y", "x"]
TRIO = ("ruderman_lab", "jzazbz", "oklch")
SUFFIXES = ("_anns_scribbleids", "_scribbleids", "_anns", "", "_anns_anns")
SQL_SUFFIX = "['_anns_scribbleids', '_scribbleids', '_anns', '', '_anns_anns'][1 + event_id % 5]"
EXTS = ("png", "JPG", "tif", "jpeg", "bmp", "txt")
SQL_EXT = "['png', 'JPG', 'tif', 'jpeg', 'bmp', 'txt'][1 + event_id % 6]"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def _ann_files(spark, sf_dir):
    """Annotation paths: one for each event; every seventh in capitals, every eleventh of another kind."""
    e = F.col("event_id")
    name = F.concat(F.lit("/anns/u"), F.col("user_id").cast("string"), F.lit("_"), e.cast("string"), _pick(SUFFIXES, e % 5))
    kind = F.when(e % 11 == 0, ".txt").when(e % 7 == 0, ".NPY").otherwise(".npy")
    return _events(spark, sf_dir).select(F.concat(name, kind).alias("path"))


SQL_ANNS = f"an AS (SELECT '/anns/u' || user_id || '_' || event_id || {SQL_SUFFIX} || CASE WHEN event_id % 11 = 0 THEN '.txt' WHEN event_id % 7 = 0 THEN '.NPY' ELSE '.npy' END AS path FROM events)"


def _image_files(spark, sf_dir):
    """Image paths: two in three of those base names have one or two images, of several kinds."""
    e = F.col("event_id")
    base = F.concat(F.lit("/imgs/u"), F.col("user_id").cast("string"), F.lit("_"), e.cast("string"), F.lit("."))
    rows = _events(spark, sf_dir).filter("event_id % 3 <> 0")
    return rows.select(F.concat(base, _pick(EXTS, e % 6)).alias("path")).unionByName(rows.filter("event_id % 4 = 0").select(F.concat(base, F.lit("bmp")).alias("path")))


SQL_IMGS = f"im AS (SELECT '/imgs/u' || user_id || '_' || event_id || '.' || {SQL_EXT} AS path FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT '/imgs/u' || user_id || '_' || event_id || '.bmp' FROM events WHERE event_id % 3 <> 0 AND event_id % 4 = 0)"


@query("o12_listing", f"WITH {SQL_ANNS} SELECT path FROM an WHERE regexp_matches(lower(path), '\\.npy$')")
def o12(spark, sf_dir):
    return images.listing(_ann_files(spark, sf_dir))


@query("o13_base_names", f"WITH {SQL_ANNS} SELECT path, regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), '(_anns_scribbleids|_scribbleids|_anns)$', '') AS base FROM an")
def o13(spark, sf_dir):
    return images.with_base(_ann_files(spark, sf_dir)).select("path", images.base_name(F.col("stem")).alias("base"))


MATCH = f"""{SQL_ANNS}, {SQL_IMGS}, ab AS (SELECT path, regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), '(_anns_scribbleids|_scribbleids|_anns)$', '') AS base FROM an),
 ib AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS base, list_position(['jpg', 'jpeg', 'png', 'bmp', 'tif', 'tiff'], lower(regexp_extract(path, '\\.([^.]*)$', 1))) AS k FROM im),
 best AS (SELECT base, arg_min(path, (k, path)) AS image FROM ib WHERE k > 0 GROUP BY base)"""


@query("o14_image_lookup", f"WITH {MATCH} SELECT path, base, image FROM ab LEFT JOIN best USING (base)")
def o14(spark, sf_dir):
    return images.match_images(_ann_files(spark, sf_dir), _image_files(spark, sf_dir))


@query("o15_unmatched", f"WITH {MATCH} SELECT path, base FROM ab ANTI JOIN best USING (base)")
def o15(spark, sf_dir):
    return images.match_images(_ann_files(spark, sf_dir), _image_files(spark, sf_dir)).filter("image IS NULL").select("path", "base")


def _palette_sql() -> str:
    bits = lambda c: " | ".join(f"(((i >> {3 * j + c}) & 1) << {7 - j})" for j in range(8))
    return f"SELECT i::INT AS index, ({bits(0)})::INT AS r, ({bits(1)})::INT AS g, ({bits(2)})::INT AS b FROM range(256) t(i)"


@query("o16_palette", _palette_sql())
def o16(spark, sf_dir):
    return colors.palette(spark)


@query("o03_mask_files", f"WITH {PX} SELECT img || '_index.png' AS file, y, x, vote_a AS label FROM px")
def o03(spark, sf_dir):
    """Write each image's labels as a palette PNG, and read the indices back (O-03 to O-06)."""
    out = workspace(spark, "o03")
    px = pixels(spark, sf_dir, extra=True)
    table_of = [(r.r, r.g, r.b) for r in colors.palette(spark).orderBy("index").collect()]
    images.write_masks(px, out, table_of, value="vote_a").count()
    return images.read_masks(spark, out)


@query("o01_image_source", f"WITH {PX}, pal AS ({_palette_sql()}) SELECT img, y, x, pal.r, pal.g, pal.b FROM px JOIN pal ON pal.index = px.r")
def o01(spark, sf_dir):
    """Write palette PNGs of the red levels, and read them as images: each pixel gets its index's colour."""
    out = workspace(spark, "o01")
    table_of = [(r.r, r.g, r.b) for r in colors.palette(spark).orderBy("index").collect()]
    images.write_masks(pixels(spark, sf_dir), out, table_of, value="r").count()
    return images.read_images(spark, out).select(F.regexp_extract("path", r"(\d+)_index", 1).cast("long").alias("img"), "y", "x", "r", "g", "b")


@query("o06_scribble_export", f"WITH {PX} SELECT img || '_index.png' AS file, y, x, ann + 1 AS label FROM px")
def o06(spark, sf_dir):
    """Annotations as palette PNGs, each index one higher than its class."""
    out = workspace(spark, "o06")
    images.write_masks(pixels(spark, sf_dir, extra=True), out, [], value="ann", shift=1).count()
    return images.read_masks(spark, out)


@query("o05_mask_export", f"WITH {PX} SELECT img || '_index.png' AS file, y, x, vote_a AS label, 10 * vote_a AS r, 10 * vote_a + 1 AS g, 10 * vote_a + 2 AS b FROM px")
def o05(spark, sf_dir):
    """Masks with the colours of the user's classes: label k has that of class k + 1, so the palette is shifted by one."""
    out = workspace(spark, "o05")
    own = [(10 * k, 10 * k + 1, 10 * k + 2) for k in range(25)]
    classes = {k + 1: c for k, c in enumerate(own)}
    images.write_masks(pixels(spark, sf_dir, extra=True), out, images.label_palette(classes), value="vote_a").count()
    seen = images.read_images(spark, out).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "y", "x", "r", "g", "b")
    return images.read_masks(spark, out).join(seen, ["file", "y", "x"]).select("file", "y", "x", "label", "r", "g", "b")


BATCH = f"""WITH {PX}, im AS (SELECT DISTINCT img FROM px), al AS (SELECT img, img % 5 <> 4 AS has_image FROM im)
 SELECT img || '_anns.npy' AS annotation, has_image AS ok, CASE WHEN has_image THEN img || '_index.png' END AS mask, CASE WHEN has_image THEN 256 ELSE 0 END::BIGINT AS n_pixels,
  count_if(has_image) OVER () AS processed, count_if(NOT has_image) OVER () AS skipped FROM al"""


@query("o00_batch_job", BATCH)
def o00(spark, sf_dir):
    """The whole batch job from folders to folders: annotations of 8 x 8 for images of 16 x 16, every fifth without an image."""
    out = workspace(spark, "o00")
    px = pixels(spark, sf_dir, extra=True)
    grey = [(k, k, k) for k in range(256)]
    images.write_masks(px.filter("img % 5 <> 4").withColumn("name", F.col("img").cast("string")), f"{out}/images", grey, value="r", key="name", suffix="").count()
    small = px.filter("y % 2 = 1 AND x % 2 = 1").select((F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x"), F.col("img").cast("string").alias("name"), "ann")
    images.write_masks(small, f"{out}/anns", [], kind="npy", value="ann", key="name", suffix="_anns").count()
    done = run_batch(spark, f"{out}/images", f"{out}/anns", f"{out}/masks", f"{out}/work", radius=3)
    back = images.read_masks(spark, f"{out}/masks").groupBy(F.col("file").alias("mask")).agg(F.count("*").alias("n_pixels"))
    rows = done.results.select(images.file_name("path").alias("annotation"), "ok", F.when(F.col("ok"), F.concat("base", F.lit("_index.png"))).alias("mask"))
    totals = done.summary.select("processed", "skipped")
    return rows.join(back, "mask", "left").withColumn("n_pixels", F.coalesce("n_pixels", F.lit(0).cast("long"))).crossJoin(F.broadcast(totals))


@query("o02_annotation_files", f"WITH {PX} SELECT img, y, x, ann FROM px")
def o02(spark, sf_dir):
    """Write annotations as .npy, and read them back."""
    out = workspace(spark, "o02")
    images.write_masks(pixels(spark, sf_dir, extra=True), out, [], kind="npy", value="ann").count()
    back = images.read_annotations(spark, out)
    return back.select(F.regexp_extract("path", r"(\d+)_index", 1).cast("long").alias("img"), "y", "x", "ann")


@query("o07_session_round_trip", f"WITH {PX} SELECT img, count_if(ann > 0) AS marked, sum(vote_a)::BIGINT AS mask_sum, 2 AS n_models, 'oklab' AS color_space, 3 AS iterations FROM px GROUP BY img")
def o07(spark, sf_dir):
    """Save a session and load it again (O-07 to O-09)."""
    out = workspace(spark, "o07")
    px = pixels(spark, sf_dir, extra=True)
    ids = px.select("img").distinct()
    models = ids.withColumn("class_id", F.explode(F.array(F.lit(2), F.lit(3)))).withColumns({"bg_model": F.array_repeat(F.lit(0.5), 65), "fg_model": F.array_repeat(F.lit(0.25), 65)})
    models = models.unionByName(ids.select("img", F.lit(4).alias("class_id"), F.lit(None).cast("array<double>").alias("bg_model"), F.lit(None).cast("array<double>").alias("fg_model")))
    meta = ids.select("img", F.array(F.lit(16), F.lit(16)).alias("image_shape"), F.lit("oklab").alias("color_space"), F.lit(5).alias("gc_iters"), F.lit("nearest-scribble").alias("tie_mode"), F.array(F.lit(2), F.lit(3)).alias("classes"), F.create_map(F.lit("2"), F.lit(3)).alias("iteration_counts"))
    sessions.save_session(out, px.select(*PIXEL, "ann"), px.select(*PIXEL, F.col("vote_a").alias("label")), models, meta)
    s = sessions.load_session(spark, out)
    a = s["annotations"].groupBy(F.col("img").cast("long").alias("img")).agg(F.count_if(F.col("ann") > 0).alias("marked"))
    m = s["final_mask"].groupBy(F.col("img").cast("long").alias("img")).agg(F.sum("label").alias("mask_sum"))
    n = s["models"].groupBy("img").agg(F.count("class_id").cast("int").alias("n_models"))
    md = s["metadata"].select("img", "color_space", F.col("iteration_counts")["2"].alias("iterations"))
    return a.join(m, "img").join(n, "img").join(md, "img").select("img", "marked", "mask_sum", "n_models", "color_space", "iterations")


@query("o09_ensemble_session", f"WITH {PX} SELECT img, count_if(ann > 0) AS marked, 'ruderman_lab,jzazbz,oklch' AS color_spaces, (img % 3)::INT AS label_tie_pref, true AS apply_seed_refinement, img % 2 = 0 AS apply_post_smoothing, count_if(vote_a = 1) AS ones_0, count_if(vote_b = 1) AS ones_1, count_if(vote_c = 1) AS ones_2 FROM px GROUP BY img")
def o09(spark, sf_dir):
    """Save an ensemble's session, its own metadata and one session for each space, and load it again."""
    out = workspace(spark, "o09")
    px = pixels(spark, sf_dir, extra=True)
    ids = px.select("img").distinct()
    shared = ids.select("img", F.array(F.lit(16), F.lit(16)).alias("image_shape"), F.lit(5).alias("gc_iters"), F.lit("nearest-scribble").alias("tie_mode"))
    meta = shared.withColumns({"color_spaces": F.array(*map(F.lit, TRIO)), "label_tie_pref": (F.col("img") % 3).cast("int"), "apply_seed_refinement": F.lit(True), "apply_post_smoothing": F.col("img") % 2 == 0})
    slots = []
    for k, space in enumerate(TRIO):
        models = ids.select("img", F.lit(2).alias("class_id"), F.array_repeat(F.lit(0.5), 65).alias("bg_model"), F.array_repeat(F.lit(0.25), 65).alias("fg_model"))
        own = shared.withColumns({"color_space": F.lit(space), "classes": F.array(F.lit(2)), "iteration_counts": F.create_map(F.lit("2"), F.lit(k))})
        slots.append((px.select(*PIXEL, F.col(f"vote_{'abc'[k]}").alias("label")), models, own))
    sessions.save_ensemble(out, px.select(*PIXEL, "ann"), px.select(*PIXEL, F.col("vote_a").alias("label")), meta, slots)
    back = sessions.load_ensemble(spark, out)
    done = back["metadata"].select("img", F.array_join("color_spaces", ",").alias("color_spaces"), "label_tie_pref", "apply_seed_refinement", "apply_post_smoothing")
    done = done.join(back["annotations"].groupBy(F.col("img").cast("long").alias("img")).agg(F.count_if(F.col("ann") > 0).alias("marked")), "img")
    for k, part in enumerate(back["slots"]):
        done = done.join(part["final_mask"].groupBy(F.col("img").cast("long").alias("img")).agg(F.count_if(F.col("label") == 1).alias(f"ones_{k}")), "img")
    return done


def _metrics(spark, sf_dir):
    e = F.col("event_id")
    return _events(spark, sf_dir).select(
        (e + 1).alias("index"), F.when(e % 2 == 0, "segment").otherwise("refine").alias("action"), F.when(e % 3 == 0, "ensemble").otherwise("single").alias("mode"), F.lit("oklab").alias("color_space"),
        F.array(F.lit("ruderman_lab"), F.lit("jzazbz"), F.lit("oklch")).alias("color_spaces"), F.lit("640x480").alias("image_size"), (F.floor(F.col("value") * 4) / 16).alias("time_sec"), (F.floor(F.col("value") * 2) / 4).alias("peak_ram_mb"),
    )


@query(
    "o10_metrics_rows",
    """SELECT (event_id + 1)::VARCHAR AS "Index", CASE WHEN event_id % 2 = 0 THEN 'Segment' ELSE 'Refine' END AS "Action", CASE WHEN event_id % 3 = 0 THEN 'Ensemble' ELSE 'Single' END AS "Mode",
    CASE WHEN event_id % 3 = 0 THEN 'ruderman_lab, jzazbz, oklch' ELSE 'oklab' END AS "Color Space(s)", '640x480' AS "Image Size",
    format('{:.3f}', floor(floor(value * 4) / 16 * 1000 + 0.5) / 1000) AS "Time (s)", printf('%.2f', floor(value * 2) / 4) AS "Peak RAM (MB)" FROM events""",
)
def o10(spark, sf_dir):
    return sessions.metrics_rows(_metrics(spark, sf_dir))


@query("o11_batch_summary", """SELECT count_if(event_id % 9 <> 0) AS processed, count_if(event_id % 9 = 0) AS skipped, round(avg(CASE WHEN event_id % 9 <> 0 THEN user_id END), 3) AS timing_ms_avg,
 '{"processed":' || processed || ',"skipped":' || skipped || ',"timing_ms_avg":' || timing_ms_avg || ',"params":{"gc_iters":5,"tie_mode":"nearest-scribble"}}' AS json FROM events""")
def o11(spark, sf_dir):
    r = _events(spark, sf_dir).select((F.col("event_id") % 9 != 0).alias("ok"), F.col("user_id").cast("double").alias("ms"))
    return sessions.summary(r, {"gc_iters": 5, "tie_mode": "nearest-scribble"})


AGG = "count_if(ann > 0) AS marked, count_if(ann > 1) AS claims, bool_or(ann = 3) AS any_three, min(r) AS least, max(r) AS most, array_to_string(list_sort(list_distinct(list(ann))), ',') AS classes, count(DISTINCT CASE WHEN ann > 0 THEN ann END) AS n_classes"


@query("o80_aggregates", f"WITH {PX} SELECT img, {AGG}, round(avg(edge), 6) AS mean_edge, round(quantile_cont(edge, 0.95), 6) AS p95, arg_max(y * 16 + x, (r, -(y * 16 + x))) AS brightest FROM px GROUP BY img")
def o80(spark, sf_dir):
    """The aggregates of O-80 to O-87, by image."""
    at = F.col("y") * 16 + F.col("x")
    return pixels(spark, sf_dir, extra=True).groupBy("img").agg(
        F.count_if(F.col("ann") > 0).alias("marked"), F.count_if(F.col("ann") > 1).alias("claims"), F.bool_or(F.col("ann") == 3).alias("any_three"), F.min("r").alias("least"), F.max("r").alias("most"),
        F.array_join(F.array_sort(F.collect_set("ann")).cast("array<string>"), ",").alias("classes"), F.count_distinct(F.when(F.col("ann") > 0, F.col("ann"))).alias("n_classes"),
        F.round(F.avg("edge"), 6).alias("mean_edge"), F.round(F.percentile("edge", F.lit(0.95)), 6).alias("p95"), F.max_by(at, F.struct("r", -at)).alias("brightest"),
    )


@query("o86_counters", "SELECT event_type, count_if(value > 50) AS processed, count_if(value <= 50) AS skipped, avg(CASE WHEN value > 1e9 THEN value END) AS mean_of_none FROM events GROUP BY event_type")
def o86(spark, sf_dir):
    v = F.col("value")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(v > 50).alias("processed"), F.count_if(v <= 50).alias("skipped"), F.avg(F.when(v > 1e9, v)).alias("mean_of_none"))


@query("o90_listing_slice", f"WITH {SQL_ANNS} SELECT path FROM an WHERE regexp_matches(lower(path), '\\.npy$') ORDER BY path LIMIT 25 OFFSET 9")
def o90(spark, sf_dir):
    return images.listing(_ann_files(spark, sf_dir), start=10, count=25)


@query("o91_overlay", f"WITH {PX}, pal AS ({_palette_sql()}) SELECT img, y, x, pal.r, pal.g, pal.b, 102 AS alpha FROM (SELECT img, y, x, vote_a AS label FROM px WHERE vote_a > 0) m JOIN pal ON pal.index = m.label + 1")
def o91(spark, sf_dir):
    px = pixels(spark, sf_dir, extra=True).select(*PIXEL, F.col("vote_a").alias("label"))
    return colors.overlay(px, colors.palette(spark).withColumnRenamed("index", "class_id"), 0.4)


@query("o92_class_colors", f"WITH pal AS ({_palette_sql()}) SELECT i::INT AS class_id, CASE WHEN i IN (3, 5) THEN 10 + i WHEN i <= 21 THEN pal.r ELSE (i * 97 + 61) % 206 + 50 END::INT AS r, CASE WHEN i IN (3, 5) THEN 20 + i WHEN i <= 21 THEN pal.g ELSE (i * 57 + 131) % 206 + 50 END::INT AS g, CASE WHEN i IN (3, 5) THEN 30 + i WHEN i <= 21 THEN pal.b ELSE (i * 171 + 17) % 206 + 50 END::INT AS b FROM range(1, 51) t(i) JOIN pal ON pal.index = i")
def o92(spark, sf_dir):
    wanted = spark.range(1, 51).select(F.col("id").cast("int").alias("class_id"))
    own = wanted.filter("class_id IN (3, 5)").select("class_id", *[(F.col("class_id") + 10 * (k + 1)).alias(c) for k, c in enumerate("rgb")])
    return colors.class_colors(wanted, own, colors.palette(spark).withColumnRenamed("index", "class_id").filter("class_id BETWEEN 1 AND 21"))


_KIND = "CASE WHEN event_id % 7 = 3 THEN 'undo' WHEN event_id % 11 = 5 THEN 'redo' WHEN event_id % 29 = 8 THEN 'clear' ELSE 'add' END"
#: The fold, one action of every session in each round, with stacks of whole lists.
_FOLD = f"""lg AS (SELECT user_id AS session, event_id AS stroke, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, {_KIND} AS a FROM events),
 st AS (SELECT DISTINCT session, 0::BIGINT AS k, []::BIGINT[] AS now, []::BIGINT[][] AS undo, []::BIGINT[][] AS redo FROM lg
  UNION ALL SELECT lg.session, lg.k,
   CASE WHEN a = 'add' THEN list_append(now, stroke) WHEN a = 'clear' THEN []::BIGINT[] WHEN a = 'undo' AND len(undo) > 0 THEN undo[len(undo)] WHEN a = 'redo' AND len(redo) > 0 THEN redo[len(redo)] ELSE now END,
   CASE WHEN a IN ('add', 'clear') OR a = 'redo' AND len(redo) > 0 THEN list_append(undo, now) WHEN a = 'undo' AND len(undo) > 0 THEN undo[1:len(undo) - 1] ELSE undo END,
   CASE WHEN a IN ('add', 'clear') THEN []::BIGINT[][] WHEN a = 'undo' AND len(undo) > 0 THEN list_append(redo, now) WHEN a = 'redo' AND len(redo) > 0 THEN redo[1:len(redo) - 1] ELSE redo END
   FROM st JOIN lg ON lg.session = st.session AND lg.k = st.k + 1)"""


@query("o94_undo_redo", f"WITH RECURSIVE {_FOLD} SELECT session, max(k) AS n_actions, array_to_string(arg_max(now, k), ',') AS present FROM st GROUP BY session")
def o94_present(spark, sf_dir):
    """Undo and redo over each user's events as a log of actions."""
    log = _events(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.expr(_KIND).alias("action"), F.col("event_id").alias("stroke"))
    return strokes.history(log).select("session", "n_actions", F.array_join(F.col("present").cast("array<string>"), ",").alias("present"))


CHANGES = "ch AS (SELECT (event_id * 7 % 60)::INT AS class_id, event_id AS seq, ['add', 'edit', 'remove', 'add'][1 + event_id % 4] AS op, 'c' || event_id AS name FROM events)"


@query("o95_class_registry", f"WITH {CHANGES}, last AS (SELECT class_id, arg_max(op, seq) AS op, arg_max(name, seq) AS name FROM ch WHERE class_id BETWEEN 1 AND 50 GROUP BY class_id), reg AS (SELECT i::INT AS class_id, 'r' || i AS name FROM range(1, 6) t(i)) SELECT class_id, CASE WHEN last.op IN ('add', 'edit') THEN last.name ELSE reg.name END AS name FROM reg FULL JOIN last USING (class_id) WHERE NOT coalesce(last.op = 'remove' AND class_id <> 1, false) AND CASE WHEN last.op IN ('add', 'edit') THEN last.name ELSE reg.name END IS NOT NULL")
def o95(spark, sf_dir):
    e = F.col("event_id")
    ch = _events(spark, sf_dir).select((e * 7 % 60).cast("int").alias("class_id"), e.alias("seq"), _pick(("add", "edit", "remove", "add"), e % 4).alias("op"), F.concat(F.lit("c"), e.cast("string")).alias("name"))
    reg = spark.range(1, 6).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"))
    return sessions.upsert_classes(reg, ch)


#: Each cell's last stroke before an action, since the last reset; a class's rows since the last segment number its iterations.
_SESSION = """WITH lg AS (SELECT event_id // 256 AS img, event_id AS seq, (event_id % 4)::INT AS class_id, user_id % 4 AS m,
  CASE WHEN event_id % 13 = 12 THEN 'segment' WHEN event_id % 13 = 6 THEN 'refine' WHEN event_id % 211 = 100 THEN 'reset' ELSE 'stroke' END AS action FROM events),
 ep AS (SELECT *, count(*) FILTER (WHERE action = 'reset') OVER (PARTITION BY img ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM lg),
 w AS (SELECT img, epoch, seq, class_id, unnest(list_transform(range(m + 1), lambda c: (c * 31 + seq) % 256)) AS cell FROM ep WHERE action = 'stroke' AND class_id > 0),
 ce AS (SELECT p.img, p.epoch, p.seq, p.action, w.cell, arg_max(w.class_id, w.seq) AS k FROM ep p JOIN w ON p.img = w.img AND p.epoch = w.epoch AND w.seq < p.seq WHERE p.action IN ('segment', 'refine') GROUP BY ALL),
 cl AS (SELECT img, epoch, seq, action, k, count(*) AS n_cells FROM ce WHERE k > 1 GROUP BY ALL),
 ru AS (SELECT *, count(*) FILTER (WHERE action = 'segment') OVER (PARTITION BY img, epoch, k ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM cl),
 it AS (SELECT *, row_number() OVER (PARTITION BY img, epoch, k, g ORDER BY seq) AS i FROM ru)
 SELECT img, seq, action, k AS class_id, CASE WHEN action = 'refine' AND i > 1 THEN 'eval' ELSE 'init' END AS mode, action = 'segment' AS grow, n_cells::INT AS n_cells, i::INT AS iterations FROM it"""


@query("o64_session_log", _SESSION)
def o64(spark, sf_dir):
    """A finished log of session actions; the stream gives the same rows (see the tests)."""
    e = F.col("event_id")
    kind = F.when(e % 13 == 12, "segment").when(e % 13 == 6, "refine").when(e % 211 == 100, "reset").otherwise("stroke")
    cells = F.sequence(F.lit(0), F.col("user_id") % 4).cast("array<int>")
    log = _events(spark, sf_dir).select(F.floor(e / 256).cast("long").alias("img"), e.alias("seq"), kind.alias("action"), (e % 4).cast("int").alias("class_id"), F.transform(cells, lambda c: ((c * 31 + e) % 256).cast("int")).alias("cells"))
    return session_batch(log)
