"""Queries over colour spaces and features (O-20 to O-39, O-74's fan-out)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelweft.functions import color
from pixelweft.operators.features import ensemble_features, features, scale_to_range, unpack_images
from pixelweft.plans.color_sql import LINEAR, color_sql
from pixelweft.plans.fixtures import PX, pixels
from pixelweft.plans.registry import query

NUMBERS = {"rgb": 20, "hsv_conic": 21, "cielab": 22, "c02_scd": 23, "c16_scd": 24, "oklab": 26, "oklch": 27, "jzazbz": 28, "jzczhz": 29, "ictcp_pq": 30, "xyz": 31, "ycbcr_bt709": 32, "srgb_linear": 33, "ruderman_lab": 34, "opponent": 35}

for _name, _n in NUMBERS.items():
    query(f"o{_n}_{_name}", color_sql(_name))(lambda spark, sf_dir, name=_name: features(pixels(spark, sf_dir), name))


@query("o25_c16_ucs", color_sql("c16_ucs"))
def c16_ucs(spark, sf_dir):
    let = color.Steps()
    channels = color.c16_ucs(let, *(F.col(k).cast("double") for k in "rgb"))
    return let.apply(pixels(spark, sf_dir)).select("img", "y", "x", *[F.round(c.value, 6).alias(f"f{i}") for i, c in enumerate(channels)])


@query("o36_srgb_decode", f"WITH {PX}, {LINEAR} SELECT img, y, x, round(lr, 6) AS lr, round(lg, 6) AS lg, round(lb, 6) AS lb FROM lin")
def srgb_decode(spark, sf_dir):
    return pixels(spark, sf_dir).select("img", "y", "x", *[F.round(color.decode(F.col(k).cast("double")), 6).alias(f"l{k}") for k in "rgb"])


@query(
    "o37_scale_to_range",
    f"WITH {PX} SELECT img, y, x, " + ", ".join(f"CASE WHEN max({k}) OVER w > min({k}) OVER w THEN CAST(floor(({k} - min({k}) OVER w) / (max({k}) OVER w - min({k}) OVER w)::DOUBLE * 255e0) AS INT) ELSE 0 END AS {k}" for k in "rgb") + " FROM px WINDOW w AS (PARTITION BY img)",
)
def range_scaled(spark, sf_dir):
    return scale_to_range(pixels(spark, sf_dir), ["r", "g", "b"])


_LAYOUTS = ("hwc", "flat", "chw", "run")


@query("o38_layouts", f"WITH {PX}, k AS (SELECT unnest(['hwc', 'flat', 'chw', 'run']) AS layout) SELECT layout, img, y, x, r, g, b FROM px, k")
def layouts(spark, sf_dir):
    """Pack each image in every layout, and unpack it again."""
    px = pixels(spark, sf_dir)
    cells = px.select("img", (F.col("y") * 16 + F.col("x")).alias("i"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(k).alias("v")) for c, k in enumerate("rgb")])).alias("s"))
    out = None
    for name, shape in zip(_LAYOUTS, ([16, 16, 3], [256, 3], [3, 16, 16], [768]), strict=True):
        order = F.col("s.c") * 256 + F.col("i") if name == "chw" else F.col("i") * 3 + F.col("s.c")
        packed = cells.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("s.v").alias("v")))), lambda e: e.v).alias("data"))
        packed = packed.withColumns({"h": F.lit(16), "w": F.lit(16), "shape": F.array(*map(F.lit, shape))})
        part = unpack_images(packed).select(F.lit(name).alias("layout"), "img", "y", "x", "r", "g", "b")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "o39_signed_response",
    f"WITH {PX} SELECT img, y, x, round(sign(r - 128) * 400e0 * pow(abs((r - 128) / 16e0), 0.42e0) / (pow(abs((r - 128) / 16e0), 0.42e0) + 27.13e0) + 0.1e0, 6) AS response FROM px",
)
def signed_response(spark, sf_dir):
    return pixels(spark, sf_dir).select("img", "y", "x", F.round(color.response((F.col("r") - 128) / 16.0), 6).alias("response"))


TRIO = ("ruderman_lab", "jzazbz", "oklch")


@query("o74_ensemble_features", " UNION ALL ".join(f"(SELECT *, {i} AS slot, '{n}' AS space FROM ({color_sql(n)}))" for i, n in enumerate(TRIO)))
def trio_features(spark, sf_dir):
    return ensemble_features(pixels(spark, sf_dir), TRIO)
