"""What elements say about colours: visibility, context, calls to action, ancestors, and the colours they paint.

elements: page_id, el_id (in document order), ancestors (array of el_id, root first), tag, class, id, role, display,
visibility, opacity, width, height, bg, fg, border (computed colour values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaspan.functions import color
from chromaspan.functions.color import let
from chromaspan.functions.css import css_color
from chromaspan.lineage import cut

#: Weights of words in an element's context, and the largest that is taken over from ancestors.
CONTEXT_SCORES = {
    "logo": 5, "brand": 5, "primary": 4, "cta": 4, "hero": 3, "button": 3, "card": 2, "section": 2, "feature": 2, "panel": 2,
    "input": 2, "badge": 2, "chip": 2, "footer": 2, "link": 2, "header": 2, "nav": 1,
}
LIFT, HOPS, CTA_SCORE = 2, 4, 25
#: Words and utility classes of status colours.
STATUS = r"\b(error|danger|destructive|invalid|warning|success|alert|notice|sale|discount|toast|notification)\b|(?:text|bg|border|ring|fill|stroke|from|to|via|divide|outline|decoration|accent|caret)-(?:red|rose|orange|amber|yellow)-[0-9]"
#: Custom properties that are no brand colours, by beginning, by part, by word and by framework default.
OTHER_PREFIXES = ("--wp--preset", "--el-", "--p-", "--chakra-", "--mantine-", "--ant-", "--bs-", "--swiper-", "--rsbs-", "--toastify-")
OTHER_PARTS = (
    "--system-", "--default-", "--tw-ring-offset", "--tw-shadow", "--tw-blur", "--tw-brightness", "--tw-contrast", "--tw-grayscale",
    "--tw-hue-rotate", "--tw-invert", "--tw-saturate", "--tw-sepia", "--tw-drop-shadow", "--tw-translate-", "--tw-rotate", "--tw-skew-",
    "--tw-scale-", "--tw-gradient-from-position", "--tw-gradient-via-position", "--tw-gradient-to-position", "--tw-divide-", "--tw-space-",
)
OTHER_WORDS = "competitor|fuel|error|danger|destructive|invalid|warning|success|info|alert|notice|disabled|placeholder|skeleton|shimmer|scrim|overlay|backdrop|tooltip"
DEFAULT_PALETTE = r"^--(?:tw-)?colors?-(?:(?:slate|gray|grey|zinc|neutral|stone|red|orange|amber|yellow|lime|green|emerald|teal|cyan|sky|blue|indigo|violet|purple|fuchsia|pink|rose)-(?:50|[0-9]00|950)|transparent|current|black|white|inherit)$"
#: Colours within a value, and words that look like one.
COLORS = r"(?i)((?:oklab|oklch|lab|lch|hwb|color)\([^)]+\)|#[0-9a-f]{3,8}|rgba?\([^)]+\)|hsla?\([^)]+\)|[a-z]+)"
NO_COLORS = ("transparent", "rgba(0, 0, 0, 0)", "rgba(0,0,0,0)", "oklab", "oklch", "lch", "lab", "color", "display", "hsl", "rgb", "rgba", "hsla", "hwb", "srgb", "inherit", "initial", "unset", "none", "auto", "normal")


def visible(rows: DataFrame) -> DataFrame:
    """Elements that are displayed and have an area."""
    return rows.where("coalesce(display, '') <> 'none' and coalesce(visibility, '') <> 'hidden' and coalesce(opacity, 1) <> 0 and width > 0 and height > 0")


def context(class_: Column, id_: Column, tag: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(class_, F.lit("")), F.coalesce(id_, F.lit("")), tag))


def word_score(text: Column, most: int = 5) -> Column:
    """The largest weight of a word in a context; words that weigh more than ``most`` do not count."""
    return F.greatest(F.lit(0), *(F.when(F.contains(text, F.lit(k)), w) for k, w in CONTEXT_SCORES.items() if w <= most))


def is_status(text: Column) -> Column:
    return text.rlike(STATUS)


def parsed(value: Column) -> Column:
    """struct<r, g, b, a> of a colour value in any known notation."""
    return css_color(value)


def is_cta(text: Column, bg: Column) -> Column:
    """A call to action: a button by its context, with a mostly opaque background other than white, black and the default grey."""
    plain = lambda p: (p["r"] == p["g"]) & (p["g"] == p["b"]) & p["r"].isin(0, 239, 255) & (p["a"] == 1)
    return text.rlike("button|btn|cta") & F.coalesce(let(parsed(bg), lambda p: (p["a"] >= 0.7) & ~plain(p)), F.lit(False))


def transparent(value: Column) -> Column:
    """Whether a colour value paints nothing; a missing one does not."""
    t = F.lower(F.trim(value))
    zero = lambda x: F.coalesce(F.regexp_extract(x, r"^\s*([+-]?[0-9]*[.]?[0-9]+)", 1).try_cast("double") == 0, F.lit(False))
    body = F.regexp_extract(t, r"^rgba?\((.*)\)$", 1)
    by_slash, by_comma = F.split(body, "/"), F.split(body, ",")
    in_function = F.when(F.size(by_slash) == 2, zero(F.get(by_slash, 1))).otherwise((F.size(by_comma) == 4) & zero(F.coalesce(F.get(by_comma, 3), F.lit(""))))
    return F.when(value.isNull() | (value == "") | (t == "transparent"), True).when(t.rlike("^#([0-9a-f]{4}|[0-9a-f]{8})$"), F.when(F.length(t) == 5, t.endswith("0")).otherwise(t.endswith("00"))).when(t.rlike(r"^rgba?\(.*\)$"), in_function).otherwise(False)


def brand_property(name: Column, host: Column) -> Column:
    """Whether a custom property's name can be a brand colour's."""
    other = F.lit(False)
    for p in OTHER_PREFIXES:
        other = other | name.startswith(p)
    for p in OTHER_PARTS:
        other = other | F.contains(name, F.lit(p))
    consent = F.contains(name, F.lit("--cc-")) & ~host.rlike("cookie|consent")
    return name.startswith("--") & ~other & ~consent & ~name.rlike(OTHER_WORDS) & ~name.rlike(DEFAULT_PALETTE) & name.rlike("color|bg|text|brand")


def color_value(value: Column) -> Column:
    """Whether a custom property's value is a colour that paints."""
    v = F.trim(value)
    begins = v.rlike(r"(?i)^(#|rgb|hsl|hwb|var\(--.*color|color\(|oklab\(|oklch\(|lab\(|lch\()")
    worked_out = v.rlike(r"color\.adjust\(|rgba\(0, 0, 0, 0\)|rgba\(0,0,0,0\)|lighten\(|darken\(|saturate\(")
    inner = F.when(v.rlike(r"calc\(|clamp\(|var\("), v.rlike(r"(?i)#[0-9a-f]{3,6}|rgba?\(|hsla?\(")).when(v.rlike(r"(?i)^(hwb|color|oklab|oklch|lab|lch)\("), css_color(v).isNotNull()).otherwise(v.rlike(r"(?i)^(#[0-9a-f]{3,8}|rgba?\(|hsla?\()"))
    return F.coalesce(begins & ~worked_out & inner, F.lit(False))


def with_ancestors(rows: DataFrame) -> DataFrame:
    """The elements with lift (the largest small weight among the HOPS nearest ancestors' class and id) and backdrop (the
    background of the nearest of the element and its ancestors below html that has an alpha of 0.1 or more)."""
    words = word_score(F.lower(F.concat_ws(" ", F.coalesce("class", F.lit("")), F.coalesce("id", F.lit("")))), LIFT)
    about = rows.select("page_id", F.col("el_id").alias("up"), words.alias("own_lift"), F.when((F.lower("tag") != "html") & (F.coalesce(parsed(F.col("bg"))["a"], F.lit(0.0)) >= 0.1), F.col("bg")).alias("own_bg"))
    steps = rows.select("page_id", "el_id", F.posexplode(F.reverse(F.concat("ancestors", F.array("el_id")))).alias("hop", "up"))
    near = steps.join(about, ["page_id", "up"]).groupBy("page_id", "el_id").agg(
        F.max(F.when(F.col("hop").between(1, HOPS), F.col("own_lift"))).alias("lift"), F.min_by("own_bg", F.when(F.col("own_bg").isNotNull(), F.col("hop"))).alias("backdrop"))
    return rows.join(near, ["page_id", "el_id"])


def scored(rows: DataFrame) -> DataFrame:
    """The elements (with lift) with context, score, is_status and is_cta."""
    out = rows.withColumn("context", context(F.col("class"), F.col("id"), F.col("tag")))
    tag = F.upper("tag")
    own = F.greatest(F.lit(1), word_score(F.col("context")), F.when(tag == "A", CONTEXT_SCORES["link"]), F.when((tag == "BUTTON") | (F.col("role") == "button"), CONTEXT_SCORES["button"]))
    lifted = let(own, lambda s: F.when(s <= LIFT, F.greatest(s, F.coalesce("lift", F.lit(0)))).otherwise(s))
    out = out.withColumn("is_status", is_status(F.col("context"))).withColumn("is_cta", is_cta(F.col("context"), F.col("bg")))
    return out.withColumn("score", F.when(F.col("is_cta"), F.greatest(lifted, F.lit(CTA_SCORE))).otherwise(lifted))


def shades(texts: DataFrame) -> DataFrame:
    """said, shades: the colours with an alpha of 0.3 or more that each distinct text (column said) paints, as array<struct<painted, hex>>."""
    found = F.filter(F.regexp_extract_all("said", F.lit(COLORS), F.lit(1)), lambda x: ~F.lower(x).isin(*NO_COLORS) & (F.length(x) > 2))
    each = texts.where("said is not null").distinct().select("said", F.explode(found).alias("painted")).withColumn("rgba", parsed(F.col("painted"))).where("rgba.a >= 0.3")
    return each.groupBy("said").agg(F.collect_list(F.struct("painted", color.to_hex(F.col("rgba.r"), F.col("rgba.g"), F.col("rgba.b")).alias("hex"))).alias("shades"))


def painted(rows: DataFrame) -> DataFrame:
    """A row per colour that an element paints with an alpha of 0.3 or more: hex and is_bg beside the element's columns.

    Each distinct text is taken apart once and joined back. The elements are read twice, so hand on a table rather than a long plan.
    """
    sides = ("bg", "fg", "border")
    known = cut(shades(rows.select(F.explode(F.array(*sides)).alias("said"))))
    out = rows
    for c in sides:
        out = out.join(known.select(F.col("said").alias(c), F.col("shades").alias(f"{c}_shades")), c, "left")
    none = F.array().cast("array<struct<painted: string, hex: string>>")
    out = out.select(*rows.columns, "bg_shades", F.explode(F.concat(*(F.coalesce(f"{c}_shades", none) for c in sides))).alias("shade"))
    return out.select(*rows.columns, "shade.hex", F.array_contains(F.coalesce(F.col("bg_shades.painted"), F.array().cast("array<string>")), F.col("shade.painted")).alias("is_bg"))


def color_statistics(rows: DataFrame, key: str) -> DataFrame:
    """key, hex, n, bg, score, status (uses in status contexts) of painted() rows."""
    return rows.groupBy(key, "hex").agg(F.count("*").alias("n"), F.count_if("is_bg").alias("bg"), F.sum("score").cast("long").alias("score"), F.count_if("is_status").alias("status"))


def cta_primary(rows: DataFrame, painted_rows: DataFrame, key: str) -> DataFrame:
    """key, hex, n: the background of at least two calls to action whose colour has the highest score (then the smaller hex)."""
    ctas = rows.where("is_cta").groupBy(key, "bg").agg(F.count("*").alias("n")).withColumn("rgba", parsed(F.col("bg")))
    ctas = ctas.groupBy(key, color.to_hex(F.col("rgba.r"), F.col("rgba.g"), F.col("rgba.b")).alias("hex")).agg(F.sum("n").alias("n")).where("n >= 2")
    best = ctas.join(color_statistics(painted_rows, key).select(key, "hex", "score"), [key, "hex"])
    return best.groupBy(key).agg(F.min_by(F.struct("hex", "n"), F.struct(-F.col("score"), "hex")).alias("x")).select(key, "x.hex", "x.n")


def page_roles(rows: DataFrame) -> DataFrame:
    """page_id, role, value: primary and secondary of the last element that says so, background and text of the body."""
    hexed = lambda p: color.to_hex(p["r"], p["g"], p["b"])
    out = rows.withColumn("b", parsed(F.col("bg"))).withColumn("f", parsed(F.col("fg")))
    out = out.withColumn("c", F.when(F.coalesce(F.col("b.a"), F.lit(0.0)) > 0, F.col("b")).otherwise(F.col("f")))
    light = (F.greatest("c.r", "c.g", "c.b") + F.least("c.r", "c.g", "c.b")) / 510.0
    first = F.when(F.contains("context", F.lit("primary")) & (F.col("c.a") >= 0.7) & (light <= 0.95), hexed(F.col("c")))
    second = F.when(F.contains("context", F.lit("secondary")) & (F.col("b.a") >= 0.1), hexed(F.col("b")))
    body = F.upper("tag") == "BODY"
    last = lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("el_id")))
    found = out.groupBy("page_id").agg(
        last(first).alias("primary"), last(second).alias("secondary"),
        F.coalesce(last(F.when(body & (F.col("b.a") >= 0.9), hexed(F.col("b")))), F.lit("#ffffff")).alias("background"), last(F.when(body & (F.col("f.a") >= 0.5), hexed(F.col("f")))).alias("text"))
    return found.unpivot("page_id", ["primary", "secondary", "background", "text"], "role", "value").where("value is not null")
