"""Colours and lengths of style sheets as columns: parsing, contrast, suggestions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour names that are understood.
NAMES = {
    "black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "cyan": "00ffff", "aqua": "00ffff", "magenta": "ff00ff", "fuchsia": "ff00ff", "gray": "808080", "grey": "808080",
    "silver": "c0c0c0", "maroon": "800000", "olive": "808000", "lime": "00ff00", "teal": "008080", "navy": "000080", "purple": "800080", "orange": "ffa500",
}


def _hex(s: Column) -> Column:
    return F.conv(s, 16, 10).cast("double")


def _channel(hexes: Column, i: int) -> Column:
    short = F.length(hexes) < 6
    return F.when(short, _hex(F.repeat(F.substring(hexes, i + 1, 1), 2))).otherwise(_hex(F.substring(hexes, 2 * i + 1, 2)))


def _hue(p: Column, q: Column, t: Column) -> Column:
    t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
    return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _from_hex(hexes: Column) -> Column:
    n = F.length(hexes)
    alpha = F.when(n == 4, _hex(F.repeat(F.substring(hexes, 4, 1), 2)) / 255).when(n == 8, _hex(F.substring(hexes, 7, 2)) / 255).otherwise(F.lit(1.0))
    return F.when(n.isin(3, 4, 6, 8), F.struct(_channel(hexes, 0).alias("r"), _channel(hexes, 1).alias("g"), _channel(hexes, 2).alias("b"), alpha.alias("a")))


def _from_hsl(hsl: Column) -> Column:
    """Of struct(h, s, l, a), all between 0 and 1."""

    def channels(x: Column) -> Column:
        p, q = x["p"], x["q"]
        part = lambda shift: let(x["h"] + shift, lambda t: F.round(_hue(p, q, t) * 255))
        return F.struct(part(1 / 3).alias("r"), part(0.0).alias("g"), part(-1 / 3).alias("b"), x["a"].alias("a"))

    q = F.when(hsl["l"] < 0.5, hsl["l"] * (1 + hsl["s"])).otherwise(hsl["l"] + hsl["s"] - hsl["l"] * hsl["s"])
    return let(F.struct(hsl["h"].alias("h"), hsl["l"].alias("l"), hsl["a"].alias("a"), q.alias("q")), lambda y: let(F.struct(y["h"].alias("h"), y["a"].alias("a"), y["q"].alias("q"), (2 * y["l"] - y["q"]).alias("p")), channels))


def _from_function(v: Column) -> Column:
    def channels(parts: Column) -> Column:
        number = lambda i: F.regexp_extract(F.get(parts, F.lit(i)), r"^(-?[0-9]*\.?[0-9]+)", 1).try_cast("double")
        percent = lambda i: F.get(parts, F.lit(i)).endswith("%")
        byte = lambda i: F.when(percent(i), number(i) * 2.55).otherwise(number(i))
        a = F.coalesce(F.when(percent(3), number(3) / 100).otherwise(number(3)), F.lit(1.0))
        rgb = F.struct(byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"), a.alias("a"))
        hsl = F.struct(((number(0) % 360) / 360).alias("h"), (number(1) / 100).alias("s"), (number(2) / 100).alias("l"), a.alias("a"))
        return F.when(F.size(parts) >= 3, F.when(v.startswith("rgb"), rgb).when(v.startswith("hsl"), let(hsl, _from_hsl)))

    return let(F.filter(F.split(F.regexp_extract(v, r"^(?:rgb|hsl)a?\(([^)]*)\)$", 1), r"[\s,/]+"), lambda x: x != ""), channels)


def parse_color(value: Column) -> Column:
    """struct(r, g, b, a) of #rgb, #rgba, #rrggbb, #rrggbbaa, rgb(a), hsl(a) and names; null for the rest."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])

    def parsed(v: Column) -> Column:
        hexes = F.coalesce(F.element_at(names, v), F.regexp_extract(v, r"^#([0-9a-f]{3,8})$", 1))
        return F.coalesce(let(hexes, _from_hex), _from_function(v))

    return let(F.lower(F.trim(value)), parsed)


def on_white(c: Column) -> Column:
    """The colour as it looks on white."""

    def mixed(x: Column) -> Column:
        mix = lambda n: F.floor(x[n] * x["a"] + 255 * (1 - x["a"]) + 0.5).cast("double")
        return F.when(x["a"] >= 1, x).when(x["a"].isNotNull(), F.struct(mix("r").alias("r"), mix("g").alias("g"), mix("b").alias("b"), F.lit(1.0).alias("a")))

    return let(c, mixed)


def luminance(c: Column) -> Column:
    def linear(x: Column) -> Column:
        return let(x / 255, lambda y: F.when(y <= 0.03928, y / 12.92).otherwise(F.pow((y + 0.055) / 1.055, F.lit(2.4))))

    return let(c, lambda x: 0.2126 * linear(x["r"]) + 0.7152 * linear(x["g"]) + 0.0722 * linear(x["b"]))


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colours, two decimals, halves upwards; null if either is null."""
    pair = F.struct(luminance(on_white(a)).alias("x"), luminance(on_white(b)).alias("y"))
    return let(pair, lambda p: F.floor((F.greatest(p["x"], p["y"]) + 0.05) / (F.least(p["x"], p["y"]) + 0.05) * 100 + 0.5) / 100 + F.lit(0) * p["x"] * p["y"])


def wcag_level(ratio: Column) -> Column:
    return F.when(ratio >= 7, "AAA").when(ratio >= 4.5, "AA").when(ratio >= 3, "AA large").when(ratio.isNotNull(), "fail")


def to_hex(c: Column) -> Column:
    part = lambda x: F.lower(F.lpad(F.hex(F.least(F.greatest(F.floor(c[x] + 0.5), F.lit(0)), F.lit(255)).cast("long")), 2, "0"))
    return F.when(c.isNotNull(), F.concat(F.lit("#"), part("r"), part("g"), part("b")))


def suggest(fg: Column, bg: Column, wanted: float) -> Column:
    """The first of 20 steps of 12 towards black or white that reaches the contrast, as #rrggbb; null if none does."""

    def first(x: Column) -> Column:
        move = lambda k: F.struct(*[F.least(F.greatest(x["f"][n] + x["sign"] * k, F.lit(0.0)), F.lit(255.0)).alias(n) for n in "rgb"], F.lit(1.0).alias("a"))
        steps = F.transform(F.sequence(F.lit(1), F.lit(20)), move)
        return let(F.get(F.filter(steps, lambda c: contrast(c, x["b"]) >= wanted), F.lit(0)), to_hex)

    both = F.struct(fg.alias("f"), bg.alias("b"), F.when(luminance(bg) > 0.5, F.lit(-12.0)).otherwise(F.lit(12.0)).alias("sign"))
    return let(both, first)


def to_pixels(value: Column) -> Column:
    """Pixels of px, rem, em, pt and % lengths and of 0; null for the rest."""
    v = F.lower(F.trim(value))
    n = F.regexp_extract(v, r"^(-?[0-9]*\.?[0-9]+)(px|rem|em|pt|%)?$", 1).try_cast("double")
    unit = F.regexp_extract(v, r"^(-?[0-9]*\.?[0-9]+)(px|rem|em|pt|%)?$", 2)
    return F.when(unit == "px", n).when(unit.isin("rem", "em"), n * 16).when(unit == "pt", n * 4 / 3).when(unit == "%", n * 0.16).when((unit == "") & n.isNotNull(), n)
