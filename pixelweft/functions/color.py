"""Colour spaces as column expressions.

Models are chains of steps. A step's values are bound to columns of their own (``Steps``), as an expression that is put in
several times would grow with each step.

A space gives three channels from 8-bit r, g, b columns, and says for each how it becomes 0..255: by
a fixed factor (``Channel.fixed``) or by the range that the channel has in its image. Arithmetic is in doubles and levels are cut, not
rounded. Spaces are resolved when a plan is built, so a plan holds plain expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = tuple[tuple[float, float, float], ...]

# Published matrices and constants of the colour models.
CAT16: Matrix = ((0.401288, 0.650173, -0.051461), (-0.250268, 1.204414, 0.045854), (-0.002079, 0.048952, 0.953127))
SRGB_TO_XYZ: Matrix = ((0.412456, 0.357576, 0.180438), (0.212673, 0.715152, 0.072175), (0.019334, 0.119192, 0.950304))
XYZ_TO_BT2020: Matrix = ((1.71665114, -0.35567074, -0.25336626), (-0.66668436, 1.61648125, 0.01576854), (0.01763985, -0.04277061, 0.94210322))
BT2020_TO_LMS: Matrix = ((1688 / 4096, 2146 / 4096, 262 / 4096), (683 / 4096, 2951 / 4096, 462 / 4096), (99 / 4096, 309 / 4096, 3688 / 4096))
LMS_TO_ICTCP: Matrix = ((2048 / 4096, 2048 / 4096, 0.0), (6610 / 4096, -13613 / 4096, 7003 / 4096), (17933 / 4096, -17390 / 4096, -543 / 4096))
OKLAB_M1: Matrix = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB_M2: Matrix = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
JZ_M1: Matrix = ((0.41478972, 0.57999900, 0.01464800), (-0.20151000, 1.12064900, 0.05310080), (-0.01660080, 0.26480000, 0.66847990))
JZ_M2: Matrix = ((0.5, 0.5, 0.0), (3.524000, -4.066708, 0.542708), (0.199076, 1.096799, -1.295875))
JZ_B, JZ_G, JZ_D, JZ_D0 = 1.15, 0.66, -0.56, 1.6295499532821566e-11
PQ_C1, PQ_C2, PQ_C3, PQ_N, JZ_P, BT2100_M2 = 0.8359375, 18.8515625, 18.6875, 0.1593017578125, 134.034375, 78.84375
RGB_TO_LMS: Matrix = ((0.3811, 0.5783, 0.0402), (0.1967, 0.7244, 0.0782), (0.0241, 0.1288, 0.8444))
CAT02: Matrix = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834))
HPE: Matrix = ((0.38971, 0.68898, -0.07868), (-0.22981, 1.18340, 0.04641), (0.0, 0.0, 1.0))
WHITE_X, WHITE_Y = 0.3127, 0.3290


class Steps:
    """Collects projections, in order: each call binds expressions to new columns and returns those."""

    def __init__(self) -> None:
        self.made: list[dict[str, Column]] = []

    def __call__(self, *values: Column) -> list[Column]:
        step = {f"pw_step{len(self.made)}_{i}": v for i, v in enumerate(values)}
        self.made.append(step)
        return [F.col(k) for k in step]

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.made:
            df = df.withColumns(step)
        return df


@dataclass(frozen=True)
class Channel:
    """A channel's value, and its fixed scaling to 0..255 (None: by its range in the image)."""

    value: Column
    fixed: Callable[[Column], Column] | None = None
    exact: bool = False  # the value is a level already


def product(m: Matrix, v: list[Column]) -> list[Column]:
    return [sum((F.lit(c) * x for c, x in zip(row[1:], v[1:], strict=True)), F.lit(row[0]) * v[0]) for row in m]


def unit(level: Column) -> Column:
    return level / F.lit(255.0)


def decode(level: Column) -> Column:
    """Linear light of an 8-bit sRGB level."""
    x = unit(level)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def degrees_of(y: Column, x: Column) -> Column:
    """Direction in degrees, 0 to 360."""
    h = F.degrees(F.atan2(y, x))
    return F.when(h < 0, h + 360.0).otherwise(h)


def pq(x: Column, m2: float) -> Column:
    p = F.pow(F.greatest(x, F.lit(0.0)), F.lit(PQ_N))
    return F.pow((PQ_C1 + PQ_C2 * p) / F.greatest(1.0 + PQ_C3 * p, F.lit(1e-12)), F.lit(m2))


def response(t: Column) -> Column:
    """Compressed cone response; the pedestal of 0.1 is added on both sides of zero."""
    p = F.pow(F.abs(t), F.lit(0.42))
    v = 400.0 * p / (p + 27.13)
    return F.when(t >= 0, v).otherwise(-v) + 0.1


def _fixed_unit(x: Column) -> Column:
    return x * 255.0


def _fixed_turn(x: Column) -> Column:
    return x / 360.0 * 255.0


def _linear(let: Steps, r: Column, g: Column, b: Column) -> list[Column]:
    return let(decode(r), decode(g), decode(b))


def _xyz(let: Steps, r: Column, g: Column, b: Column) -> list[Column]:
    return let(*product(SRGB_TO_XYZ, _linear(let, r, g, b)))


def _ranged(values: list[Column]) -> list[Channel]:
    return [Channel(v) for v in values]


def rgb(let, r, g, b):
    return [Channel(x, exact=True) for x in (r, g, b)]


def hsv_levels(r: Column, g: Column, b: Column) -> list[Column]:
    """8-bit hue (0..179), saturation and value, in the integer arithmetic that imaging libraries use: reciprocals in 12-bit
    fixed point, rounded half up."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    scaled = lambda top, by: F.when(by == 0, F.lit(0)).otherwise(F.rint(F.lit(float(top)) / by).cast("long"))
    s = F.floor((d * scaled(255 << 12, v) + 2048) / 4096.0).cast("long")
    raw = F.when(v == r, g - b).when(v == g, b - r + 2 * d).otherwise(r - g + 4 * d)
    h = F.floor((raw * scaled(30 << 12, d) + 2048) / 4096.0).cast("long")
    return [F.when(h < 0, h + 180).otherwise(h), s, v.cast("long")]


def hsv_conic(let, r, g, b):
    h, s, v = let(*hsv_levels(r, g, b))
    vs, turn = v / 255.0 * (s / 255.0), h * math.pi / 90.0
    half = lambda x: (x + 1.0) * 127.5
    return [Channel(v / 255.0, _fixed_unit), Channel(vs * F.sin(turn), half), Channel(vs * F.cos(turn), half)]


def cielab(let, r, g, b):
    """8-bit CIELAB under D65: rounded, not cut. Libraries that work with tables may differ by a level."""
    x, y, z = _xyz(let, r, g, b)
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)
    fx, fy, fz = let(f(x / 0.950456), f(y), f(z / 1.088754))
    light = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    level = lambda c: F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(255))
    return [Channel(level(c), exact=True) for c in (light * 255.0 / 100.0, 500.0 * (fx - fy) + 128.0, 200.0 * (fy - fz) + 128.0)]


def white() -> list[float]:
    return [100.0 * WHITE_X / WHITE_Y, 100.0, 100.0 * (1 - WHITE_X - WHITE_Y) / WHITE_Y]


def _times(m: Matrix, v: list[float]) -> list[float]:
    return [sum(a * b for a, b in zip(row, v, strict=True)) for row in m]


def _invert(m: Matrix) -> Matrix:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    adj = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(x / det for x in row) for row in adj)


def _respond(t: float) -> float:
    p = abs(t) ** 0.42
    return math.copysign(400.0 * p / (p + 27.13), t) + 0.1


@dataclass(frozen=True)
class Viewing:
    """What of a colour appearance model depends on the viewing conditions only, as numbers. ``cones`` adapts,
    ``compress`` is the space in which responses are compressed."""

    surround: tuple[float, float, float]
    adapting: float
    cones: Matrix
    compress: Matrix | None = None

    def constants(self) -> dict:
        big_f, c, nc = self.surround
        rgb_w = _times(self.cones, white())
        d = min(1.0, max(0.0, big_f * (1 - math.exp(-(self.adapting + 42) / 92) / 3.6)))
        gain = [d * 100.0 / w + 1 - d for w in rgb_w]
        k = 1 / (5 * self.adapting + 1)
        fl = 0.2 * k**4 * 5 * self.adapting + 0.1 * (1 - k**4) ** 2 * (5 * self.adapting) ** (1 / 3)
        n = 20.0 / 100.0
        nbb = 0.725 * (1 / n) ** 0.2
        adapted = [g * w for g, w in zip(gain, rgb_w, strict=True)]
        if self.compress:
            adapted = _times(self.compress, _times(_invert(self.cones), adapted))
        a = [_respond(fl * x / 100) for x in adapted]
        return {"gain": gain, "fl": fl, "n": n, "nbb": nbb, "nc": nc, "exponent": c * (1.48 + n**0.5), "white": max((2 * a[0] + a[1] + a[2] / 20 - 0.305) * nbb, 1e-6)}


CAM16 = Viewing((0.9, 0.59, 0.9), 64.0 / math.pi * 20.0 / 100.0, CAT16)
CAM02 = Viewing((1.0, 0.69, 1.0), 64.0 / math.pi / 5.0, CAT02, HPE)


def appearance(let: Steps, view: Viewing, r: Column, g: Column, b: Column) -> list[Column]:
    """Lightness, colourfulness and hue angle."""
    k = view.constants()
    xyz = [x * 100.0 for x in _xyz(let, r, g, b)]
    cones = let(*[c * gain for c, gain in zip(product(view.cones, xyz), k["gain"], strict=True)])
    if view.compress:
        cones = let(*product(view.compress, let(*product(_invert(view.cones), cones))))
    ra, ga, ba = let(*[response(t) for t in let(*[k["fl"] * c / 100.0 for c in cones])])
    a, bb = let(ra - 12.0 / 11.0 * ga + ba / 11.0, (ra + ga - 2.0 * ba) / 9.0)
    (h,) = let(degrees_of(bb, a))
    e = 0.25 * (F.cos(F.radians(h) + 2.0) + 3.8)
    (light,) = let(100.0 * F.pow(F.greatest((2.0 * ra + ga + ba / 20.0 - 0.305) * k["nbb"], F.lit(0.0)) / k["white"], F.lit(k["exponent"])))
    low = ra + ga + 1.05 * ba
    low = F.when(F.abs(low) < 1e-6, F.lit(1e-6)).otherwise(low)
    t = 50000.0 / 13.0 * k["nc"] * k["nbb"] * e * F.sqrt(a * a + bb * bb) / low
    chroma = F.pow(t, F.lit(0.9)) * F.sqrt(F.greatest(light, F.lit(0.0)) / 100.0) * (1.64 - 0.29 ** k["n"]) ** 0.73
    return let(light, chroma * k["fl"] ** 0.25, h)


def uniform(let: Steps, view: Viewing, c2: float, r: Column, g: Column, b: Column) -> list[Column]:
    """J', a', b' of the uniform space with this colourfulness constant."""
    j, m, h = appearance(let, view, r, g, b)
    (mp,) = let(F.log1p(c2 * m) / c2)
    return [1.7 * j / (1.0 + 0.007 * j), mp * F.cos(F.radians(h)), mp * F.sin(F.radians(h))]


def c16_scd(let, r, g, b):
    return _ranged(uniform(let, CAM16, 0.0363, r, g, b))


def c16_ucs(let, r, g, b):
    return _ranged(uniform(let, CAM16, 0.0228, r, g, b))


def c02_scd(let, r, g, b):
    return _ranged(uniform(let, CAM02, 0.0363, r, g, b))


def _oklab(let, r, g, b) -> list[Column]:
    roots = let(*[F.cbrt(F.greatest(x, F.lit(0.0))) for x in product(OKLAB_M1, _linear(let, r, g, b))])
    return let(*product(OKLAB_M2, roots))


def oklab(let, r, g, b):
    return _ranged(_oklab(let, r, g, b))


def _polar(first: Channel, a: Column, b: Column) -> list[Channel]:
    return [first, Channel(F.sqrt(a * a + b * b)), Channel(degrees_of(b, a), _fixed_turn)]


def oklch(let, r, g, b):
    light, a, bb = _oklab(let, r, g, b)
    return _polar(Channel(F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0)), _fixed_unit), a, bb)


def _jzazbz(let, r, g, b) -> list[Column]:
    x, y, z = _xyz(let, r, g, b)
    adapted = [JZ_B * x - (JZ_B - 1.0) * z, JZ_G * y - (JZ_G - 1.0) * x, z]
    cones = let(*[pq(c, JZ_P) for c in let(*product(JZ_M1, let(*adapted)))])
    i, a, bb = let(*product(JZ_M2, cones))
    return [(1.0 + JZ_D) * i / (1.0 + JZ_D * i) - JZ_D0, a, bb]


def jzazbz(let, r, g, b):
    return _ranged(_jzazbz(let, r, g, b))


def jzczhz(let, r, g, b):
    j, a, bb = _jzazbz(let, r, g, b)
    return _polar(Channel(j), a, bb)


def ictcp_pq(let, r, g, b):
    lms = let(*product(BT2020_TO_LMS, let(*product(XYZ_TO_BT2020, _xyz(let, r, g, b)))))
    return _ranged(product(LMS_TO_ICTCP, let(*[pq(c, BT2100_M2) for c in lms])))


def xyz(let, r, g, b):
    return _ranged(_xyz(let, r, g, b))


def srgb_linear(let, r, g, b):
    return [Channel(x, _fixed_unit) for x in _linear(let, r, g, b)]


def ycbcr_bt709(let, r, g, b):
    # Levels are weighted before they are divided, as in the query's SQL: where a value lies on a level's edge, the order decides.
    dot = lambda p, q, s: F.lit(p) * r / 255.0 + F.lit(q) * g / 255.0 + F.lit(s) * b / 255.0
    off = lambda x: (x + 0.5) * 255.0
    return [Channel(dot(0.2126, 0.7152, 0.0722), _fixed_unit), Channel(dot(-0.11457211, -0.38542789, 0.5), off), Channel(dot(0.5, -0.4541529, -0.04584709), off)]


def ruderman_lab(let, r, g, b):
    lo, m, s = let(*[F.log10(F.greatest(x, F.lit(1e-6))) for x in product(RGB_TO_LMS, _linear(let, r, g, b))])
    return _ranged([(lo + m + s) / math.sqrt(3.0), (lo + m - 2.0 * s) / math.sqrt(6.0), (lo - m) / math.sqrt(2.0)])


def opponent(let, r, g, b):
    r, g, b = unit(r), unit(g), unit(b)
    return _ranged([(r - g) / math.sqrt(2.0), (r + g - 2.0 * b) / math.sqrt(6.0), (r + g + b) / math.sqrt(3.0)])


SPACES: dict[str, Callable[[Steps, Column, Column, Column], list[Channel]]] = {
    f.__name__: f for f in (rgb, hsv_conic, cielab, c02_scd, c16_scd, oklab, oklch, jzazbz, jzczhz, ictcp_pq, xyz, ycbcr_bt709, srgb_linear, ruderman_lab, opponent)
}


def space(name: str) -> Callable[[Steps, Column, Column, Column], list[Channel]]:
    """The space of this name, in any case of letters."""
    found = SPACES.get(name.lower())
    if found is None:
        raise ValueError(f"unknown colour space: {name!r}; known: {', '.join(sorted(SPACES))}")
    return found
