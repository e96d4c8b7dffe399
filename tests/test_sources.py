"""Files, sessions, reports and the stream of actions."""

import io
import struct
import zlib

import numpy as np
import pytest

from pixelweft.sources import images, sessions
from pixelweft.streaming.session import session_batch, session_stream


def test_indexed_png_round_trip_and_filters():
    a = np.random.default_rng(0).integers(0, 22, (7, 5)).astype(np.uint8)
    pal = np.arange(768).reshape(256, 3) % 256
    assert (images.decode_indexed_png(images.encode_indexed_png(a, pal)) == a).all()
    for kind in range(5):
        raw = bytearray()
        for y in range(7):
            raw.append(kind)
            for x in range(5):
                left, up, corner = (int(a[y, x - 1]) if x else 0), (int(a[y - 1, x]) if y else 0), (int(a[y - 1, x - 1]) if x and y else 0)
                p = left + up - corner
                guess = [0, left, up, (left + up) // 2, min((left, up, corner), key=lambda v, p=p: abs(p - v))][kind]
                raw.append((int(a[y, x]) - guess) & 255)
        head = struct.pack(">IIBBBBB", 5, 7, 8, 3, 0, 0, 0)
        png = b"\x89PNG\r\n\x1a\n" + images._chunk(b"IHDR", head) + images._chunk(b"IDAT", zlib.compress(bytes(raw))) + images._chunk(b"IEND", b"")
        assert (images.decode_indexed_png(png) == a).all()
    with pytest.raises(ValueError):
        images.decode_indexed_png(b"\x89PNG\r\n\x1a\n" + images._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 2, 0, 0, 0)))


def test_image_reader_gives_red_first(spark, tmp_path):
    rgb = np.array([[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [9, 8, 7]]], dtype=np.uint8)
    rows = b"".join(b"\0" + r.tobytes() for r in rgb)
    png = b"\x89PNG\r\n\x1a\n" + images._chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + images._chunk(b"IDAT", zlib.compress(rows)) + images._chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in images.read_images(spark, str(tmp_path)).collect()}
    assert got == {(y, x): tuple(int(v) for v in rgb[y, x]) for y in range(2) for x in range(2)}


def test_annotations_are_npy_only(spark, tmp_path):
    buffer = io.BytesIO()
    np.save(buffer, np.array([[0, 1], [2, 21]]))
    (tmp_path / "a.npy").write_bytes(buffer.getvalue())
    assert {(r.y, r.x): r.ann for r in images.read_annotations(spark, str(tmp_path)).collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 21}
    (tmp_path / "b.png").write_bytes(b"x")
    with pytest.raises(Exception, match="npy"):
        images.read_annotations(spark, str(tmp_path)).collect()


def test_base_names(spark):
    names = {"2007_000032_anns_scribbleids": "2007_000032", "image_001_anns": "image_001", "a_anns_anns": "a_anns", "b_scribbleids_anns": "b_scribbleids", "c": "c"}
    df = spark.createDataFrame([(k,) for k in names], "stem string")
    assert {r.stem: r.b for r in df.select("stem", images.base_name(df.stem).alias("b")).collect()} == names


def test_listing_offsets(spark):
    df = spark.createDataFrame([(f"/a/{k}.npy",) for k in "dbac"] + [("/a/x.txt",)], "path string")
    assert [r.path[3] for r in images.listing(df, start=2, count=2).collect()] == ["b", "c"]
    assert [r.path[3] for r in images.listing(df, start=0).collect()] == ["a", "b", "c", "d"]


def test_lookup_prefers_the_first_extension(spark):
    anns = spark.createDataFrame([("/a/x_anns.npy",), ("/a/y.npy",)], "path string")
    imgs = spark.createDataFrame([("/i/x.png",), ("/i/x.JPEG",), ("/i/x.gif",)], "path string")
    assert {r.base: r.image for r in images.match_images(anns, imgs).collect()} == {"x": "/i/x.JPEG", "y": None}


def test_session_with_a_foreign_model_raises(spark, out_dir):
    ids = spark.createDataFrame([(0,)], "img long")
    px = spark.createDataFrame([(0, 0, 0, 2)], "img long, y int, x int, ann int")
    models = spark.createDataFrame([(0, 9, [1.0], [1.0])], "img long, class_id int, bg_model array<double>, fg_model array<double>")
    meta = spark.createDataFrame([(0, [1, 1], "oklab", 5, "nearest-scribble", [2], {"2": 1})], sessions.METADATA)
    sessions.save_session(out_dir, px, px, models, meta, slot=1)
    loaded = sessions.load_session(spark, out_dir, slot=1)
    assert loaded["metadata"].first().iteration_counts == {"2": 1}
    assert ids.count() == 1
    with pytest.raises(Exception, match="metadata"):
        loaded["models"].collect()


def test_summary_of_nothing_has_no_mean(spark):
    r = sessions.summary(spark.createDataFrame([(False, 3.0)], "ok boolean, ms double"), {"gc_iters": 5}).first()
    assert (r.processed, r.skipped, r.timing_ms_avg) == (0, 1, None)
    assert r.json == '{"processed":0,"skipped":1,"timing_ms_avg":null,"params":{"gc_iters":5}}'


def test_metrics_csv(spark, out_dir):
    m = spark.createDataFrame([(1, "segment", "ensemble", "oklab", ["a", "b", "c"], "4x4", 1.23456, 10.0)], "index int, action string, mode string, color_space string, color_spaces array<string>, image_size string, time_sec double, peak_ram_mb double")
    sessions.write_metrics_csv(m, out_dir)
    assert spark.read.csv(out_dir, header=True).first().asDict() == {"Index": "1", "Action": "Segment", "Mode": "Ensemble", "Color Space(s)": "a, b, c", "Image Size": "4x4", "Time (s)": "1.235", "Peak RAM (MB)": "10.00"}


def test_registry_ids(spark):
    reg = spark.createDataFrame([(1, "bg"), (2, "cat")], "class_id int, name string")
    ch = spark.createDataFrame([(1, 1, "remove", None), (2, 1, "remove", None), (51, 1, "add", "x"), (7, 2, "add", "dog")], "class_id int, seq long, op string, name string")
    after = sessions.upsert_classes(reg, ch)
    assert {r.class_id: r.name for r in after.collect()} == {1: "bg", 7: "dog"}
    assert sessions.next_class_id(after).first().next_id == 8


ACTIONS = "img long, seq long, action string, class_id int, cells array<int>"
LOG = [
    (0, 1, "stroke", 2, [1, 2, 3]), (0, 2, "segment", 0, []), (0, 3, "refine", 0, []), (0, 4, "stroke", 0, [1]), (0, 5, "stroke", 3, [3]),
    (0, 6, "refine", 0, []), (0, 7, "segment", 0, []), (0, 8, "reset", 0, []), (0, 9, "segment", 0, []), (1, 1, "stroke", 5, [9]), (1, 2, "refine", 0, []),
]


def test_session_semantics(spark):
    got = [tuple(r)[1:] for r in session_batch(spark.createDataFrame(LOG, ACTIONS)).filter("img = 0").orderBy("seq", "class_id").collect()]
    assert got == [
        (2, "segment", 2, "init", True, 3, 1), (3, "refine", 2, "eval", False, 3, 2), (6, "refine", 2, "eval", False, 2, 3), (6, "refine", 3, "init", False, 1, 1),
        (7, "segment", 2, "init", True, 2, 1), (7, "segment", 3, "init", True, 1, 1),
    ]


def test_stream_gives_the_batch_rows(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([r for r in LOG if (r[1] - 1) // 3 == k], ACTIONS).coalesce(1).write.mode("append").parquet(str(src))
        import time

        time.sleep(1.1)
    stream = spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = session_stream(stream).writeStream.outputMode("append").format("memory").queryName("session_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = sorted(tuple(r) for r in session_batch(spark.createDataFrame(LOG, ACTIONS)).collect())
    assert sorted(tuple(r) for r in spark.table("session_rows").collect()) == want


def test_a_stream_of_actions_is_cut(spark, tmp_path):
    """What the stream leaves is what the cuts give one after the other."""
    from pixelweft.operators import grabcut, seeds
    from pixelweft.streaming.cuts import standing, start_session

    rng = np.random.default_rng(2)
    image = rng.integers(0, 20, (12, 12, 3))
    image[2:7, 2:7], image[8:11, 1:11] = image[2:7, 2:7] + 150, image[8:11, 1:11] + 60
    features = spark.createDataFrame([(i, y, x, *(int(v) for v in image[y, x])) for i in (0, 1) for y in range(12) for x in range(12)], "img long, y int, x int, f0 int, f1 int, f2 int")
    cell = lambda y, x: y * 12 + x
    square, bar, ground = [cell(y, 4) for y in (3, 4, 5)], [cell(9, x) for x in range(2, 9)], [cell(0, x) for x in range(12)]
    log = [(0, 1, "stroke", 2, square), (0, 2, "stroke", 1, ground), (0, 3, "segment", 0, []), (0, 4, "stroke", 3, bar), (0, 5, "refine", 0, []), (0, 6, "refine", 0, []), (1, 1, "stroke", 2, square), (1, 2, "segment", 0, []), (1, 3, "reset", 0, [])]
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([r for r in log if (r[1] - 1) // 2 == k], ACTIONS).coalesce(1).write.mode("append").parquet(str(src))
        import time

        time.sleep(1.1)
    stream = spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(str(src))
    store = f"file://{tmp_path}/store"
    q = start_session(stream, features, store, str(tmp_path / "cp"), width=12)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.img, r.class_id): r for r in standing(spark, store).collect()}

    def trimap(fg, bg):
        mask = np.full((12, 12), seeds.MAYBE_BACKGROUND)
        mask.ravel()[bg], mask.ravel()[fg] = seeds.BACKGROUND, seeds.FOREGROUND
        return mask

    x = image.astype(float)
    _, *models = grabcut.segment(x, trimap(square, ground))
    for _ in range(2):
        mask, *models = grabcut.segment(x, trimap(square, ground + bar), tuple(models), 2)
    front = np.flatnonzero(np.isin(mask, (seeds.FOREGROUND, seeds.MAYBE_FOREGROUND)).ravel()).tolist()
    assert set(got) == {(0, 2), (0, 3)} and got[0, 2].cells == front and set(square) <= set(front)
    assert (got[0, 2].seq, got[0, 2].iterations, got[0, 3].iterations) == (6, 3, 2)
    assert np.allclose(got[0, 2].bg_model, models[0].flat()) and set(bar) <= set(got[0, 3].cells)
