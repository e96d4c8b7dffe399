"""DuckDB SQL for the colour-space queries, written as chains of named steps over the pixel relation."""

from __future__ import annotations

import math

from pixelweft.functions import color as c
from pixelweft.plans.fixtures import PX


def num(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def dot(row, names) -> str:
    return " + ".join(f"{num(k)} * {n}" for k, n in zip(row, names, strict=True))


def step(name: str, src: str, **exprs: str) -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in exprs.items())} FROM {src})"


def mat(name: str, src: str, m, into, names) -> str:
    return step(name, src, **{o: dot(row, names) for o, row in zip(into, m, strict=True)})


def turn(y: str, x: str) -> str:
    return f"CASE WHEN degrees(atan2({y}, {x})) < 0 THEN degrees(atan2({y}, {x})) + 360 ELSE degrees(atan2({y}, {x})) END"


LINEAR = step("lin", "px", **{f"l{k}": f"CASE WHEN {k} / 255e0 <= 0.04045e0 THEN {k} / 255e0 / 12.92e0 ELSE pow(({k} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END" for k in "rgb"})
L = ("lr", "lg", "lb")
XYZ = mat("xyz", "lin", c.SRGB_TO_XYZ, ("cx", "cy", "cz"), L)


def pq(x: str, m2: float) -> str:
    p = f"pow(greatest({x}, 0e0), {num(c.PQ_N)})"
    return f"pow(({num(c.PQ_C1)} + {num(c.PQ_C2)} * {p}) / greatest(1e0 + {num(c.PQ_C3)} * {p}, 1e-12), {num(m2)})"


def select(ctes: list[str], src: str, channels: list[tuple[str, str]]) -> str:
    """Channels are (kind, expression): ranged, level (cut), whole (a level already) or plain (rounded doubles)."""
    cols, raw = [], []
    for i, (kind, e) in enumerate(channels):
        raw.append(f"{e} AS v{i}")
        if kind == "ranged":
            lo, hi = f"min(v{i}) OVER (PARTITION BY img)", f"max(v{i}) OVER (PARTITION BY img)"
            cols.append(f"CASE WHEN {hi} > {lo} THEN CAST(least(greatest(floor((v{i} - {lo}) / ({hi} - {lo}) * 255e0), 0), 255) AS INT) ELSE 0 END AS f{i}")
        elif kind == "level":
            cols.append(f"CAST(least(greatest(floor(v{i}), 0), 255) AS INT) AS f{i}")
        elif kind == "whole":
            cols.append(f"CAST(v{i} AS INT) AS f{i}")
        else:
            cols.append(f"round(v{i}, 6) AS f{i}")
    return f"WITH {', '.join([PX, *ctes])}, raw AS (SELECT img, y, x, {', '.join(raw)} FROM {src}) SELECT img, y, x, {', '.join(cols)} FROM raw"


def ranged(*e: str) -> list[tuple[str, str]]:
    return [("ranged", x) for x in e]


def _oklab() -> list[str]:
    return [LINEAR, mat("lms", "lin", c.OKLAB_M1, ("a0", "a1", "a2"), L), step("cb", "lms", **{f"b{i}": f"cbrt(greatest(a{i}, 0e0))" for i in range(3)}), mat("lab", "cb", c.OKLAB_M2, ("o0", "o1", "o2"), ("b0", "b1", "b2"))]


def _jz() -> list[str]:
    return [
        LINEAR, XYZ,
        step("ad", "xyz", xp=f"{num(c.JZ_B)} * cx - {num(c.JZ_B - 1)} * cz", yp=f"{num(c.JZ_G)} * cy - {num(c.JZ_G - 1)} * cx"),
        mat("cone", "ad", c.JZ_M1, ("a0", "a1", "a2"), ("xp", "yp", "cz")),
        step("pqs", "cone", **{f"b{i}": pq(f"a{i}", c.JZ_P) for i in range(3)}),
        mat("iab", "pqs", c.JZ_M2, ("iz", "az", "bz"), ("b0", "b1", "b2")),
        step("jab", "iab", jz=f"{num(1 + c.JZ_D)} * iz / (1e0 + {num(c.JZ_D)} * iz) - {num(c.JZ_D0)}"),
    ]


def _appearance(view: c.Viewing) -> list[str]:
    k = view.constants()
    out = [LINEAR, XYZ, step("x100", "xyz", x1="cx * 100e0", x2="cy * 100e0", x3="cz * 100e0"), mat("c0", "x100", view.cones, ("p0", "p1", "p2"), ("x1", "x2", "x3")), step("c1", "c0", **{f"q{i}": f"p{i} * {num(g)}" for i, g in enumerate(k["gain"])})]
    last, names = "c1", ("q0", "q1", "q2")
    if view.compress:
        out += [mat("c2", "c1", c._invert(view.cones), ("s0", "s1", "s2"), names), mat("c3", "c2", view.compress, ("u0", "u1", "u2"), ("s0", "s1", "s2"))]
        last, names = "c3", ("u0", "u1", "u2")
    out.append(step("t0", last, **{f"t{i}": f"{num(k['fl'])} * {n} / 100e0" for i, n in enumerate(names)}))
    p = lambda i: f"pow(abs(t{i}), 0.42e0)"
    out.append(step("t1", "t0", **{f"ra{i}": f"sign(t{i}) * 400e0 * {p(i)} / ({p(i)} + 27.13e0) + 0.1e0" for i in range(3)}))
    out.append(step("t2", "t1", oa="ra0 - 12e0 / 11e0 * ra1 + ra2 / 11e0", ob="(ra0 + ra1 - 2e0 * ra2) / 9e0", low="ra0 + ra1 + 1.05e0 * ra2"))
    out.append(step("t3", "t2", hue=turn("ob", "oa"), light=f"100e0 * pow(greatest((2e0 * ra0 + ra1 + ra2 / 20e0 - 0.305e0) * {num(k['nbb'])}, 0e0) / {num(k['white'])}, {num(k['exponent'])})"))
    out.append(step("t4", "t3", chroma=f"pow({num(50000 / 13 * k['nc'] * k['nbb'])} * 0.25e0 * (cos(radians(hue) + 2e0) + 3.8e0) * sqrt(oa * oa + ob * ob) / (CASE WHEN abs(low) < 1e-6 THEN 1e-6 ELSE low END), 0.9e0) * sqrt(greatest(light, 0e0) / 100e0) * {num((1.64 - 0.29 ** k['n']) ** 0.73)} * {num(k['fl'] ** 0.25)}"))
    return out


def _uniform(view: c.Viewing, c2: float) -> tuple[list[str], list[str]]:
    ctes = [*_appearance(view), step("t5", "t4", mp=f"ln(1e0 + {num(c2)} * chroma) / {num(c2)}")]
    return ctes, ["1.7e0 * light / (1e0 + 0.007e0 * light)", "mp * cos(radians(hue))", "mp * sin(radians(hue))"]


def _hsv() -> list[str]:
    div = lambda top, by: f"CASE WHEN {by} = 0 THEN 0 ELSE CAST(round_even({top} / {by}::DOUBLE, 0) AS BIGINT) END"
    return [
        step("mm", "px", v="greatest(r, g, b)", d="greatest(r, g, b) - least(r, g, b)"),
        step("hs", "mm", s=f"CAST(floor((d * {div(255 << 12, 'v')} + 2048) / 4096e0) AS BIGINT)", h0=f"CAST(floor((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END * {div(30 << 12, 'd')} + 2048) / 4096e0) AS BIGINT)"),
        step("hh", "hs", h="CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END"),
    ]


def color_sql(name: str) -> str:
    if name == "rgb":
        return select([], "px", [("whole", "r"), ("whole", "g"), ("whole", "b")])
    if name == "hsv_conic":
        a = f"h * {num(math.pi)} / 90e0"
        return select(_hsv(), "hh", [("level", "v / 255e0 * 255e0"), ("level", f"(v / 255e0 * (s / 255e0) * sin({a}) + 1e0) * 127.5e0"), ("level", f"(v / 255e0 * (s / 255e0) * cos({a}) + 1e0) * 127.5e0")])
    if name == "cielab":
        f = lambda t: f"CASE WHEN {t} > 0.008856e0 THEN cbrt({t}) ELSE 7.787e0 * {t} + 16e0 / 116e0 END"
        ctes = [LINEAR, XYZ, step("nf", "xyz", fx=f("(cx / 0.950456e0)"), fy=f("cy"), fz=f("(cz / 1.088754e0)"))]
        cut = lambda e: ("whole", f"least(greatest(floor({e} + 0.5e0), 0), 255)")
        return select(ctes, "nf", [cut("(CASE WHEN cy > 0.008856e0 THEN 116e0 * cbrt(cy) - 16e0 ELSE 903.3e0 * cy END) * 255e0 / 100e0"), cut("500e0 * (fx - fy) + 128e0"), cut("200e0 * (fy - fz) + 128e0")])
    if name in ("c02_scd", "c16_scd", "c16_ucs"):
        ctes, ch = _uniform(c.CAM02 if name == "c02_scd" else c.CAM16, 0.0228 if name == "c16_ucs" else 0.0363)
        return select(ctes, "t5", [("plain" if name == "c16_ucs" else "ranged", x) for x in ch])
    if name == "oklab":
        return select(_oklab(), "lab", ranged("o0", "o1", "o2"))
    if name == "oklch":
        return select(_oklab(), "lab", [("level", "least(greatest(o0, 0e0), 1e0) * 255e0"), ("ranged", "sqrt(o1 * o1 + o2 * o2)"), ("level", f"({turn('o2', 'o1')}) / 360e0 * 255e0")])
    if name == "jzazbz":
        return select(_jz(), "jab", ranged("jz", "az", "bz"))
    if name == "jzczhz":
        return select(_jz(), "jab", [("ranged", "jz"), ("ranged", "sqrt(az * az + bz * bz)"), ("level", f"({turn('bz', 'az')}) / 360e0 * 255e0")])
    if name == "ictcp_pq":
        ctes = [LINEAR, XYZ, mat("wide", "xyz", c.XYZ_TO_BT2020, ("w0", "w1", "w2"), ("cx", "cy", "cz")), mat("lms", "wide", c.BT2020_TO_LMS, ("a0", "a1", "a2"), ("w0", "w1", "w2"))]
        ctes += [step("pqs", "lms", **{f"b{i}": pq(f"a{i}", c.BT2100_M2) for i in range(3)}), mat("itp", "pqs", c.LMS_TO_ICTCP, ("o0", "o1", "o2"), ("b0", "b1", "b2"))]
        return select(ctes, "itp", ranged("o0", "o1", "o2"))
    if name == "xyz":
        return select([LINEAR, XYZ], "xyz", ranged("cx", "cy", "cz"))
    if name == "srgb_linear":
        return select([LINEAR], "lin", [("level", f"{k} * 255e0") for k in L])
    if name == "ycbcr_bt709":
        p = ("r / 255e0", "g / 255e0", "b / 255e0")
        return select([], "px", [("level", f"({dot((0.2126, 0.7152, 0.0722), p)}) * 255e0"), ("level", f"({dot((-0.11457211, -0.38542789, 0.5), p)} + 0.5e0) * 255e0"), ("level", f"({dot((0.5, -0.4541529, -0.04584709), p)} + 0.5e0) * 255e0")])
    if name == "ruderman_lab":
        ctes = [LINEAR, mat("lms", "lin", c.RGB_TO_LMS, ("a0", "a1", "a2"), L), step("lg10", "lms", **{f"b{i}": f"log10(greatest(a{i}, 1e-6))" for i in range(3)})]
        return select(ctes, "lg10", ranged("(b0 + b1 + b2) / sqrt(3e0)", "(b0 + b1 - 2e0 * b2) / sqrt(6e0)", "(b0 - b1) / sqrt(2e0)"))
    if name == "opponent":
        return select([], "px", ranged("(r / 255e0 - g / 255e0) / sqrt(2e0)", "(r / 255e0 + g / 255e0 - 2e0 * (b / 255e0)) / sqrt(6e0)", "(r / 255e0 + g / 255e0 + b / 255e0) / sqrt(3e0)"))
    raise ValueError(name)
