"""Colour arithmetic as column expressions over #rrggbb strings, and a parser for other notations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel(hex_: Column, k: int) -> Column:
    """Channel k (0 red, 1 green, 2 blue) of #rrggbb, 0-255; null for anything else."""
    return F.when(hex_.rlike("^#[0-9a-fA-F]{6}$"), F.conv(F.substring(hex_, 2 + 2 * k, 2), 16, 10).cast("int"))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of channels from 0 to 255; null if one is null. One number's hex digits: a format string costs several times as much a row."""
    whole = ((F.lit(256) + r.cast("int")) * 256 + g.cast("int")) * 256 + b.cast("int")
    return F.concat(F.lit("#"), F.lower(F.substring(F.hex(whole), 2, 6)))


def linear(c: Column) -> Column:
    """One sRGB channel (0-255) in linear light."""
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def luminance(hex_: Column) -> Column:
    r, g, b = (linear(channel(hex_, k)) for k in range(3))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(one: Column, two: Column) -> Column:
    """WCAG contrast of two relative luminances."""
    return (F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05)


def saturation(hex_: Column) -> Column:
    """(max - min) / max of the channels, 0 for black."""
    cs = [channel(hex_, k) for k in range(3)]
    high, low = F.greatest(*cs), F.least(*cs)
    return F.when(high == 0, 0.0).otherwise((high - low) / high)


def chroma(hex_: Column) -> Column:
    """Saturation in HSL; 0 for greys and for what is nearly black or white."""
    r, g, b = (channel(hex_, k) / 255.0 for k in range(3))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light = (high + low) / 2
    return F.when((high == low) | (light < 0.08) | (light > 0.92), 0.0).when(light > 0.5, (high - low) / (2 - high - low)).otherwise((high - low) / (high + low))


def hue(hex_: Column) -> Column:
    """Hue in HSL, 0 to 360; -1 for greys."""
    r, g, b = (channel(hex_, k) / 255.0 for k in range(3))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    return F.when(d == 0, -1.0).when(high == r, F.pmod((g - b) / d, F.lit(6.0)) * 60).when(high == g, ((b - r) / d + 2) * 60).otherwise(((r - g) / d + 4) * 60)


def hue_distance(one: Column, two: Column) -> Column:
    """The shorter way between two hues, 0 to 180."""
    gap = F.pmod(F.abs(one - two), F.lit(360.0))
    return F.when(gap > 180, 360 - gap).otherwise(gap)


def let(value: Column, then) -> Column:
    """then(value), with the value computed once: without it, a value used often is copied as often into the plan."""
    return F.get(F.transform(F.array(value), then), 0)


def lab(hex_: Column) -> Column:
    """struct<l, a, b> in CIELAB under D65."""

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise((903.3 * t + 16.0) / 116.0)

    def from_linear(c: Column) -> Column:
        r, g, b = c["r"], c["g"], c["b"]
        x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047
        y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
        z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883
        return let(F.struct(f(x).alias("x"), f(y).alias("y"), f(z).alias("z")), lambda t: F.struct((116 * t["y"] - 16).alias("l"), (500 * (t["x"] - t["y"])).alias("a"), (200 * (t["y"] - t["z"])).alias("b")))

    return let(F.struct(*(linear(channel(hex_, k)).alias(n) for k, n in enumerate("rgb"))), from_linear)


def oklab(hex_: Column) -> Column:
    """struct<l, a, b> in OKLab."""
    r, g, b = (linear(channel(hex_, k)) for k in range(3))
    m = [F.pow(c, F.lit(1 / 3)) for c in (0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b, 0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b, 0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b)]
    return F.struct((0.2104542553 * m[0] + 0.7936177850 * m[1] - 0.0040720468 * m[2]).alias("l"), (1.9779984951 * m[0] - 2.4285922050 * m[1] + 0.4505937099 * m[2]).alias("a"), (0.0259040371 * m[0] + 0.7827717662 * m[1] - 0.8086757660 * m[2]).alias("b"))


def delta_e(one: Column, two: Column) -> Column:
    """CIE76 distance of two Lab structs."""
    return F.sqrt(F.pow(one["l"] - two["l"], 2) + F.pow(one["a"] - two["a"], 2) + F.pow(one["b"] - two["b"], 2))


def ciede2000(one: Column, two: Column) -> Column:
    """CIEDE2000 distance of two Lab structs."""
    far = 6103515625.0  # 25 ** 7
    made = lambda **c: F.struct(*(x.alias(n) for n, x in c.items()))

    def seventh(x: Column) -> Column:
        return F.sqrt(x / (x + far))

    def chromas(v: Column) -> Column:
        mean = (F.hypot(v["p"]["a"], v["p"]["b"]) + F.hypot(v["q"]["a"], v["q"]["b"])) / 2
        return let(1 + 0.5 * (1 - seventh(F.pow(mean, 7))), lambda g: let(made(a1=g * v["p"]["a"], a2=g * v["q"]["a"]), lambda a: polar(v, a)))

    def hue(a: Column, b: Column) -> Column:
        h = F.degrees(F.atan2(b, a))
        return F.when((a == 0) & (b == 0), 0.0).when(h < 0, h + 360).otherwise(h)

    def polar(v: Column, a: Column) -> Column:
        b1, b2 = v["p"]["b"], v["q"]["b"]
        found = made(l1=v["p"]["l"], l2=v["q"]["l"], c1=F.hypot(a["a1"], b1), c2=F.hypot(a["a2"], b2), h1=hue(a["a1"], b1), h2=hue(a["a2"], b2))
        return let(found, turned)

    def turned(x: Column) -> Column:
        grey, gap, total = x["c1"] * x["c2"] == 0, x["h2"] - x["h1"], x["h1"] + x["h2"]
        dh = F.when(grey, 0.0).when(F.abs(gap) <= 180, gap).when(gap > 180, gap - 360).otherwise(gap + 360)
        mean = F.when(grey, total).when(F.abs(gap) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
        return let(made(dl=x["l2"] - x["l1"], dc=x["c2"] - x["c1"], dk=2 * F.sqrt(x["c1"] * x["c2"]) * F.sin(F.radians(dh) / 2), h=mean, low=F.pow((x["l1"] + x["l2"]) / 2 - 50, 2), c=(x["c1"] + x["c2"]) / 2), weighed)

    def weighed(x: Column) -> Column:
        cos = lambda k, d: F.cos(F.radians(k * x["h"] + d))
        t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
        turn = -F.sin(F.radians(60 * F.exp(-F.pow((x["h"] - 275) / 25, 2)))) * 2 * seventh(F.pow(x["c"], 7))
        parts = made(dl=x["dl"] / (1 + 0.015 * x["low"] / F.sqrt(20 + x["low"])), dc=x["dc"] / (1 + 0.045 * x["c"]), dk=x["dk"] / (1 + 0.015 * x["c"] * t), turn=turn)
        return let(parts, lambda d: F.sqrt(F.greatest(F.lit(0.0), d["dl"] * d["dl"] + d["dc"] * d["dc"] + d["dk"] * d["dk"] + d["turn"] * d["dc"] * d["dk"])))

    return let(made(p=one, q=two), chromas)


def role(hex_: Column, confidence: Column) -> Column:
    """surface, neutral, accent or supporting."""
    lum = luminance(hex_)
    return F.when(lum.isNull(), "unknown").when((lum > 0.9) | (lum < 0.005), "surface").when(saturation(hex_) < 0.12, "neutral").when(confidence.isin("high", "medium"), "accent").otherwise("supporting")


def on_color(hex_: Column) -> Column:
    """White or black, whichever has more contrast (white on ties)."""
    lum = luminance(hex_)
    return F.when(contrast(lum, F.lit(1.0)) >= contrast(lum, F.lit(0.0)), "#ffffff").otherwise("#000000")


def capped(confidence: Column, count: Column) -> Column:
    """Confidence limited by usage: high needs 3 uses, medium 2."""
    return F.when((confidence == "high") & (count < 3), F.when(count >= 2, "medium").otherwise("low")).when((confidence == "medium") & (count < 2), "low").otherwise(confidence)


NUMBER = r"([+-]?(?:[0-9]*[.])?[0-9]+%?)"


def parse_css(text: Column) -> Column:
    """struct<r, g, b, a> of hex (3, 4, 6, 8 digits), rgb()/rgba() and transparent; null for other notations."""
    t = F.lower(F.trim(text))
    digits = F.regexp_extract(t, "^#([0-9a-f]{3,8})$", 1)
    wide = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).when(F.length(digits).isin(6, 8), digits)
    pair = lambda k: F.conv(F.substring(wide, 2 * k + 1, 2), 16, 10).cast("int")
    rgb = r"^rgba?\(\s*" + NUMBER + r"\s*[ ,]\s*" + NUMBER + r"\s*[ ,]\s*" + NUMBER + r"\s*(?:[,/]\s*" + NUMBER + r"\s*)?\)$"
    raw = lambda k: F.regexp_extract(t, rgb, k)
    part = lambda k: F.least(F.lit(255), F.greatest(F.lit(0), F.when(raw(k).endswith("%"), F.regexp_replace(raw(k), "%", "").try_cast("double") * 255 / 100).otherwise(raw(k).try_cast("double")))).cast("double")
    whole = lambda k: F.floor(part(k) + 0.5).cast("int")
    alpha = F.when(raw(4) == "", 1.0).when(raw(4).endswith("%"), F.regexp_replace(raw(4), "%", "").try_cast("double") / 100).otherwise(raw(4).try_cast("double"))
    made = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, "rgba", strict=True)))
    return F.when(wide.isNotNull() & (wide != ""), made(pair(0), pair(1), pair(2), F.when(F.length(wide) == 8, F.floor(pair(3) / 255.0 * 1000 + 0.5) / 1000).otherwise(1.0))).when(t.rlike(rgb), made(whole(1), whole(2), whole(3), alpha)).when(t == "transparent", made(F.lit(0), F.lit(0), F.lit(0), F.lit(0.0)))


#: Rows of the matrices from OKLab to linear sRGB.
OKLAB_TO_LMS = ((1, 0.3963377774, 0.2158037573), (1, -0.1055613458, -0.0638541728), (1, -0.0894841775, -1.2914855480))
LMS_TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def as_hsl(hex_: Column) -> Column:
    """hsl() notation, four digits."""
    r, g, b = (channel(hex_, k) / 255.0 for k in range(3))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    hue = F.when(d == 0, 0.0).when(high == r, F.pmod((g - b) / d, F.lit(6.0))).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    l = (high + low) / 2
    s = F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * l - 1)))
    return F.format_string("hsl(%.4f %.4f%% %.4f%%)", hue, s * 100, l * 100)


def as_hwb(hex_: Column) -> Column:
    """hwb() notation, four digits."""
    cs = [channel(hex_, k) / 255.0 for k in range(3)]
    return F.format_string("hwb(%s %.4f%% %.4f%%)", F.regexp_extract(as_hsl(hex_), r"\(([0-9.]+)", 1), F.least(*cs) * 100, (1 - F.greatest(*cs)) * 100)


def as_oklch(hex_: Column) -> Column:
    """oklch() notation, six digits; grey has the hue 0."""
    p = oklab(hex_)
    c = F.hypot(p["a"], p["b"])
    hue = F.when(c < 1e-6, 0.0).otherwise(F.pmod(F.degrees(F.atan2(p["b"], p["a"])), F.lit(360.0)))
    return F.format_string("oklch(%.6f %.6f %.4f)", p["l"], c, hue)


def as_oklab(hex_: Column) -> Column:
    """oklab() notation, six digits."""
    p = oklab(hex_)
    return F.format_string("oklab(%.6f %.6f %.6f)", p["l"], p["a"], p["b"])


def parsed(rows: DataFrame, column: str, into: str = "rgba") -> DataFrame:
    """The rows with ``into``: each distinct notation is parsed once and joined back by its string."""
    from chromaspan.functions.css import css_color

    once = rows.select(column).distinct().withColumn(into, css_color(F.col(column)))
    return rows.join(once, column, "left")
