"""Colours as structs of doubles: r, g, b from 0 to 255 and a from 0 to 1."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tintlake.functions.values import js_number, let, round_half_up, trim

RGB = "struct<r:double,g:double,b:double,a:double>"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_PLAIN = r"^-?\d*\.?\d+$"


def rgb(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"), a.cast("double").alias("a"))


def _leading(c: Column) -> Column:
    """The number a text begins with."""
    return F.regexp_extract(c, _NUMBER, 0).try_cast("double")


def _clamp(c: Column, most: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), c))


def _alpha(c: Column) -> Column:
    n = _leading(c)
    return F.coalesce(F.when(c.endswith("%"), _clamp(n / 100, 1.0)).otherwise(_clamp(n, 1.0)), F.lit(1.0))


def _plain(c: Column) -> Column:
    return F.when(c == "none", 0.0).when(c.rlike(_PLAIN), c.try_cast("double"))


def _scaled(c: Column, scale: float) -> Column:
    """A percentage of the scale, or a plain number."""
    return F.when(c.endswith("%"), _leading(c) / 100 * scale).otherwise(_plain(c))


def _hue(c: Column) -> Column:
    t, n = F.lower(c), _leading(F.lower(c))
    # the suffix rad is also that of grad, and comes first
    return F.when(t == "none", 0.0).when(t.endswith("deg"), n).when(t.endswith("rad"), n * 180 / math.pi).when(t.endswith("turn"), n * 360).otherwise(n)


def parse_hex(c: Column) -> Column:
    digits = F.regexp_extract(trim(c), "^#([0-9a-fA-F]{3,8})$", 1)
    digits = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)

    def byte(at: int) -> Column:
        return F.conv(F.substring(digits, at, 2), 16, 10).cast("double")

    return F.when(F.length(digits).isin(6, 8), rgb(byte(1), byte(3), byte(5), F.when(F.length(digits) == 8, byte(7) / 255).otherwise(1.0)))


def to_linear(c: Column) -> Column:
    return let(c / 255, lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))))


def from_linear(c: Column) -> Column:
    v = let(c, lambda x: F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(F.abs(x), F.lit(1 / 2.4)) * F.signum(x) * 1.055 - 0.055))
    return _clamp(v * 255, 255.0)


def _weighted(parts: tuple[Column, Column, Column], weights: tuple[float, float, float]) -> Column:
    return parts[0] * weights[0] + parts[1] * weights[1] + parts[2] * weights[2]


def _triple(*parts: Column) -> Column:
    return F.array(*(p.cast("double") for p in parts))


def _three(c: Column) -> tuple[Column, Column, Column]:
    return c[0], c[1], c[2]


def _xyz_to_rgb(xyz: Column, a: Column) -> Column:
    rows = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    return let(xyz, lambda t: rgb(*(from_linear(_weighted(_three(t), r)) for r in rows), a))


def _oklab(lab: Column, alpha: Column) -> Column:
    rows = ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))
    out = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
    cubes = let(lab, lambda t: F.transform(_triple(*(t[0] + t[1] * p + t[2] * q for p, q in rows)), lambda v: v * v * v))
    return let(cubes, lambda t: rgb(*(from_linear(_weighted(_three(t), r)) for r in out), alpha))


def _lab(lab: Column, alpha: Column) -> Column:
    def inverse(t: Column) -> Column:
        return let(t, lambda x: F.when(x * x * x > 0.008856, x * x * x).otherwise((x - 16 / 116) / 7.787))

    def d50(t: Column) -> Column:
        return let((t[0] + 16) / 116, lambda fy: _triple(inverse(t[1] / 500 + fy) * 0.96422, inverse(fy), inverse(fy - t[2] / 200) * 0.82521))

    bradford = ((0.9555766, -0.0230393, 0.0631636), (-0.0282895, 1.0099416, 0.0210077), (0.0122982, -0.0204830, 1.3299098))
    xyz = let(let(lab, d50), lambda t: _triple(*(_weighted(_three(t), r) for r in bradford)))
    return _xyz_to_rgb(xyz, alpha)


def _hsl(hsl: Column, alpha: Column) -> Column:
    def made(t: Column) -> Column:
        """t: p (hue in sixths), c (chroma), lightness."""
        p, c = t[0], t[1]
        x, m, zero = c * (1 - F.abs(F.pmod(p, F.lit(2.0)) - 1)), t[2] - c / 2, F.lit(0.0)

        def channel(order: tuple[Column, ...]) -> Column:
            out = F.when(p < 1, order[0])
            for i in range(1, 5):
                out = out.when(p < i + 1, order[i])
            return (out.otherwise(order[5]) + m) * 255

        return rgb(channel((c, x, zero, zero, x, c)), channel((x, c, c, x, zero, zero)), channel((zero, zero, x, c, c, x)), alpha)

    def parts(t: Column) -> Column:
        lit = _clamp(t[2] / 100, 1.0)
        return _triple(F.pmod(F.pmod(t[0], F.lit(360.0)) + 360, F.lit(360.0)) / 60, (1 - F.abs(lit * 2 - 1)) * _clamp(t[1] / 100, 1.0), lit)

    return let(let(hsl, parts), made)


def _function(name: Column, p: list[Column], slash: Column) -> Column:
    """The colour of a function's name, channels and text after the slash."""
    given = F.coalesce(slash, F.lit("")) != ""
    alpha = F.when(given, _alpha(slash)).when(p[3].isNotNull(), _alpha(p[3])).otherwise(1.0)
    own_alpha = F.when(given, _alpha(slash)).otherwise(1.0)

    def channel(x: Column) -> Column:
        return F.when(x == "none", 0.0).when(x.endswith("%"), _clamp(_leading(x) / 100 * 255, 255.0)).otherwise(F.least(F.lit(255.0), _leading(x)))

    def known(values: tuple[Column, ...], then: Callable[[Column], Column]) -> Column:
        return let(_triple(*values), lambda t: F.when(t[0].isNotNull() & t[1].isNotNull() & t[2].isNotNull(), then(t)))

    def polar(t: Column) -> Column:
        radians = t[2] * math.pi / 180
        return _triple(t[0], t[1] * F.cos(radians), t[1] * F.sin(radians))

    def hwb(t: Column) -> Column:
        white, black = t[1] / 100, t[2] / 100
        gray = white / (white + black) * 255
        pure = _hsl(_triple(t[0], F.lit(100.0), F.lit(50.0)), alpha)
        mixed = let(pure, lambda c: rgb(*(c[k] * (1 - white - black) + white * 255 for k in "rgb"), alpha))
        return F.when(white + black >= 1, rgb(gray, gray, gray, alpha)).otherwise(mixed)

    def spaces(t: Column) -> Column:
        space = F.lower(p[0])
        rows = ((0.4865709, 0.2656677, 0.1982173), (0.2289746, 0.6917385, 0.0792869), (0.0, 0.0451134, 1.0439444))
        xyz = let(F.transform(t, lambda x: to_linear(x * 255)), lambda v: _triple(*(_weighted(_three(v), r) for r in rows)))
        return F.when(space == "srgb", rgb(*(x * 255 for x in _three(t)), own_alpha)).when(space == "display-p3", _xyz_to_rgb(xyz, own_alpha))

    return (
        F.when(name.isin("rgb", "rgba"), known(tuple(map(channel, p[:3])), lambda t: rgb(*_three(t), alpha)))
        .when(name.isin("hsl", "hsla"), known((_hue(p[0]), _scaled(p[1], 100), _scaled(p[2], 100)), lambda t: _hsl(t, alpha)))
        .when(name == "oklch", known((_scaled(p[0], 1), _plain(p[1]), _hue(p[2])), lambda t: _oklab(polar(t), alpha)))
        .when(name == "oklab", known((_scaled(p[0], 1), _plain(p[1]), _plain(p[2])), lambda t: _oklab(t, alpha)))
        .when(name == "lab", known((_scaled(p[0], 100), _plain(p[1]), _plain(p[2])), lambda t: _lab(t, alpha)))
        .when(name == "lch", known((_scaled(p[0], 100), _plain(p[1]), _hue(p[2])), lambda t: _lab(polar(t), alpha)))
        .when(name == "hwb", known((_hue(p[0]), _scaled(p[1], 100), _scaled(p[2], 100)), hwb))
        .when(name == "color", known(tuple(_scaled(x, 1) for x in p[1:]), spaces))
    )


def parse_color(c: Column) -> Column:
    """The colour a literal stands for, or null."""

    def parts(t: Column) -> Column:
        """Name, text after the slash, channels."""
        inner = trim(F.regexp_extract(t, r"^([a-zA-Z]+)\s*\(([\s\S]*)\)$", 2))
        main, slash = trim(F.split(inner, "/", 2)[0]), trim(F.get(F.split(inner, "/", 2), F.lit(1)))
        channels = F.when(main.contains(","), F.split(main, ",")).otherwise(F.split(main, r"\s+"))
        own = F.filter(F.transform(channels, trim), lambda x: x != "")
        name = F.lower(F.regexp_extract(t, r"^([a-zA-Z]+)\s*\(([\s\S]*)\)$", 1))
        return F.struct(F.when((inner != "") & ~inner.rlike(r"^(?i)from\b"), name).alias("name"), slash.alias("slash"), own.alias("p"))

    def function(x: Column) -> Column:
        return _function(x["name"], [F.get(x["p"], F.lit(i)) for i in range(4)], x["slash"])

    return let(trim(c), lambda t: F.when(t.startswith("#"), parse_hex(t)).otherwise(let(parts(t), function)))


def lab_of(color: Column) -> Column:
    """L, a, b (D65) of a colour."""
    weights = (((0.4124564, 0.3575761, 0.1804375), 0.95047), ((0.2126729, 0.7151522, 0.0721750), 1.0), ((0.0193339, 0.1191920, 0.9503041), 1.08883))

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16 / 116)

    linear = let(color, lambda c: F.transform(_triple(c["r"], c["g"], c["b"]), to_linear))
    xyz = let(linear, lambda t: F.transform(_triple(*(_weighted(_three(t), w) / white for w, white in weights)), f))
    return let(xyz, lambda t: F.struct((t[1] * 116 - 16).alias("l"), ((t[0] - t[1]) * 500).alias("a"), ((t[1] - t[2]) * 200).alias("b")))


def delta_e76(one: Column, two: Column) -> Column:
    """Distance of two Lab structs."""
    return F.sqrt(F.pow(one["l"] - two["l"], F.lit(2)) + F.pow(one["a"] - two["a"], F.lit(2)) + F.pow(one["b"] - two["b"], F.lit(2)))


def luminance(color: Column) -> Column:
    return let(color, lambda c: to_linear(c["r"]) * 0.2126 + to_linear(c["g"]) * 0.7152 + to_linear(c["b"]) * 0.0722)


def over(source: Column, backdrop: Column) -> Column:
    """Source-over compositing."""
    inverse = 1 - source["a"]
    a = source["a"] + backdrop["a"] * inverse
    mixed = [(source[k] * source["a"] + backdrop[k] * backdrop["a"] * inverse) / F.nullif(a, F.lit(0.0)) for k in "rgb"]
    return F.when(a <= 0, rgb(*(F.lit(0.0),) * 4)).otherwise(rgb(*mixed, a))


def contrast(foreground: Column, background: Column) -> Column:
    """WCAG ratio; a translucent background lies on white, a translucent foreground on the background."""

    def below(b: Column) -> Column:
        return F.when(b["a"] < 1, over(b, rgb(*(F.lit(255.0),) * 3, F.lit(1.0)))).otherwise(b)

    def ratio(f: Column, b: Column) -> Column:
        above = F.when(f["a"] < 1, over(f, b)).otherwise(f)
        return let(F.array(luminance(above), luminance(b)), lambda t: (F.array_max(t) + 0.05) / (F.array_min(t) + 0.05))

    return let(foreground, lambda f: let(let(background, below), lambda b: F.when(f.isNotNull() & b.isNotNull(), ratio(f, b))))


def _byte(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(_clamp(round_half_up(c), 255.0).cast("long")), 2, "0"))


def to_hex(color: Column) -> Column:
    return let(color, lambda c: F.concat(F.lit("#"), *(_byte(c[k]) for k in "rgb")))


def color_key(c: Column) -> Column:
    """#rrggbb, with @alpha where it is translucent; null if it is no colour."""
    return let(parse_color(c), lambda x: F.when(x.isNotNull(), F.when(x["a"] < 1, F.concat(to_hex(x), F.lit("@"), js_number(x["a"]))).otherwise(to_hex(x))))


def to_hsl(color: Column) -> Column:
    def made(t: Column) -> Column:
        r, g, b = _three(t)
        most, least = F.array_max(t), F.array_min(t)
        lit, d = (most + least) / 2, most - least
        s = F.when(lit > 0.5, d / (2 - most - least)).otherwise(d / (most + least))
        h = F.when(most == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
        zero = F.lit(0.0)
        return F.when(most == least, F.struct(zero.alias("h"), zero.alias("s"), (lit * 100).alias("l"))).otherwise(F.struct((h * 60).alias("h"), (s * 100).alias("s"), (lit * 100).alias("l")))

    return let(let(color, lambda c: _triple(c["r"] / 255, c["g"] / 255, c["b"] / 255)), made)


def hue_name(h: Column) -> Column:
    # The largest hue of each name.
    out = F.when(h <= 15, "red")
    for most, name in ((45, "orange"), (70, "yellow"), (160, "green"), (190, "teal"), (250, "blue"), (290, "purple"), (345, "pink")):
        out = out.when(h <= most, name)
    return out.otherwise("red")


def lightness_step(lit: Column) -> Column:
    """50 for the lightest to 950 for the darkest."""
    out = F.when(lit > 95, 50)
    for i in range(9):
        out = out.when(lit > 90 - 10 * i, 100 * (i + 1))
    return out.otherwise(950)


def generic_color_name(c: Column) -> Column:
    """A name by hue and lightness."""

    def named(x: Column) -> Column:
        return let(to_hsl(x), lambda t: F.concat(F.lit("color-"), F.when(t["s"] < 8, "gray").otherwise(hue_name(t["h"])), F.lit("-"), lightness_step(t["l"]).cast("string")))

    return let(parse_color(c), lambda x: F.when(x.isNull(), "color-unknown").otherwise(named(x)))
