"""Colours on hand-made pixels."""

import math

import pytest
from pyspark.sql import functions as F

from pixelweft.functions import color
from pixelweft.operators.features import ensemble_features, features, unpack_images


def lattice(spark, colors, img=0):
    return spark.createDataFrame([(img, 0, x, *c) for x, c in enumerate(colors)], "img long, y int, x int, r int, g int, b int")


def test_uniform_image_has_zero_range(spark):
    got = features(lattice(spark, [(10, 20, 30)] * 4), "oklab").select("f0", "f1", "f2").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 0, 0)]


@pytest.mark.parametrize("name", sorted(set(color.SPACES) - {"rgb", "hsv_conic", "cielab", "srgb_linear", "ycbcr_bt709", "oklch", "jzczhz"}))
def test_ranged_channels_span_everything_or_nothing(spark, name):
    px = lattice(spark, [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (90, 140, 20)])
    for c in ("f0", "f1", "f2"):
        lo, hi = features(px, name).agg(F.min(c), F.max(c)).first()
        assert (lo, hi) in ((0, 255), (0, 0))


def test_black_and_white(spark):
    got = {r.x: tuple(r)[3:] for r in features(lattice(spark, [(0, 0, 0), (255, 255, 255), (128, 128, 128)]), "cielab").select("img", "y", "x", "f0", "f1", "f2").collect()}
    assert got[0] == (0, 128, 128) and got[1] == (255, 128, 128) and got[2][1:] == (128, 128)
    got = {r.x: tuple(r)[3:] for r in features(lattice(spark, [(0, 0, 0), (255, 255, 255)]), "hsv_conic").select("img", "y", "x", "f0", "f1", "f2").collect()}
    assert got[0] == (0, 127, 127) and got[1] == (255, 127, 127)


def test_hue_of_primaries(spark):
    px = lattice(spark, [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255)])
    h = [r.h for r in px.select("x", color.hsv_levels(*(F.col(c).cast("long") for c in "rgb"))[0].alias("h")).orderBy("x").collect()]
    assert h == [0, 60, 120, 30, 150]


def test_response_keeps_its_pedestal_below_zero(spark):
    a, b = spark.range(1).select(color.response(F.lit(2.0)), color.response(F.lit(-2.0))).first()
    assert math.isclose(a + b, 0.2)


def test_unknown_space_and_case(spark):
    assert color.space("OKLab") is color.oklab
    for name in ("log_chroma", "lalphabeta", ""):
        with pytest.raises(ValueError):
            color.space(name)


def test_null_level_gives_null(spark):
    px = spark.createDataFrame([(0, 0, 0, None, 1, 2), (0, 0, 1, 3, 4, 5)], "img long, y int, x int, r int, g int, b int")
    assert features(px, "xyz").count() == 2


def test_layouts_prefer_hwc(spark):
    data = list(range(27))
    df = spark.createDataFrame([(0, 3, 3, [3, 3, 3], data)], "img long, h int, w int, shape array<int>, data array<int>")
    first = unpack_images(df).filter("y = 0 AND x = 1").first()
    assert (first.r, first.g, first.b) == (3, 4, 5)
    bad = spark.createDataFrame([(0, 2, 2, [4], [1, 2, 3, 4])], "img long, h int, w int, shape array<int>, data array<int>")
    with pytest.raises(Exception, match="three channels"):
        unpack_images(bad).collect()


def test_ensemble_has_slots(spark):
    out = ensemble_features(lattice(spark, [(1, 2, 3), (200, 100, 0)]), ("oklab", "XYZ", "rgb"))
    assert {(r.slot, r.space) for r in out.collect()} == {(0, "oklab"), (1, "xyz"), (2, "rgb")}


def test_ycbcr_levels_on_edges(spark):
    """Values within a rounding of a level's edge: what DuckDB makes of the query's SQL."""
    want = {(119, 119, 76): (115, 106, 129), (37, 37, 110): (42, 164, 124), (149, 94, 29): (100, 88, 157), (247, 247, 236): (246, 121, 128), (205, 205, 246): (207, 148, 125), (221, 30, 77): (73, 129, 220)}
    got = {r.x: (r.f0, r.f1, r.f2) for r in features(lattice(spark, list(want)), "ycbcr_bt709").collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
