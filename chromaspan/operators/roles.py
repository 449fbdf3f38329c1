"""Roles of colours: a site's primary and accent, the named roles of its tokens, and tokens that refer to them.

Each works on one row a site that holds candidates thinned out by distance, whose number the colour space bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaspan.functions import color

from .merge import leaders

#: The points of a confidence, the named roles in their order, names of spacings and of rounded corners.
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
ROLES = ("primary", "secondary", "tertiary", "surface", "on-surface", "error")
SPACINGS = ("xs", "sm", "md", "lg", "xl", "xxl", "xxxl", "xxxxl")
CORNERS = ("sm", "md", "lg", "xl")


def primary_and_accent(palette: DataFrame, ctas: DataFrame, semantic: DataFrame) -> DataFrame:
    """site, primary, accent from palettes (site, ord, hex, n, confidence, is_token), backgrounds of calls to action (site, hex)
    and the colours that elements name as primary (site, hex). Null where nothing qualifies.

    The named colour, else the most used chromatic one (tokens 20 uses ahead), is the primary; a nearly grey one yields to a chromatic
    token or call to action. The accent is the most chromatic colour over 30 degrees of hue away.
    """
    rows = palette.join(ctas.select("site", "hex").distinct().withColumn("is_cta", F.lit(True)), ["site", "hex"], "left").withColumn("c", color.chroma(F.col("hex")))
    bonus = F.when(F.col("is_token"), 20).otherwise(0)
    used = F.col("n") + bonus
    sure = F.col("confidence") != "low"
    strong = (F.col("c") > 0.25) & (F.col("is_token") | F.coalesce("is_cta", F.lit(False)))
    best = lambda test, points: F.min_by(F.when(test, F.col("hex")), F.when(test, F.struct(-points, -F.col("c"), "ord", "hex")))
    gathered = rows.groupBy("site").agg(
        best(sure & (F.col("c") > 0.15), used).alias("chromatic"), best(strong, used + F.when(F.col("is_cta"), 20).otherwise(0)).alias("strong"),
        F.array_sort(F.collect_list(F.when(sure & (F.col("c") > 0.25), F.struct((-F.col("c")).alias("c"), "ord", "hex", color.hue(F.col("hex")).alias("hue"))))).alias("accents"))
    named = semantic.groupBy("site").agg(F.min("hex").alias("named"))
    first = gathered.join(named, "site", "left").withColumn("first", F.coalesce("named", "chromatic"))
    picked = first.withColumn("primary", F.when(color.chroma(F.col("first")) < 0.12, F.coalesce("strong", "first")).otherwise(F.col("first"))).withColumn("hue", color.hue(F.col("primary")))
    other = F.filter("accents", lambda a: (a["hex"] != F.col("primary")) & ((F.col("hue") < 0) | (color.hue_distance(a["hue"], F.col("hue")) > 30)))
    return picked.select("site", "primary", F.when(F.col("primary").isNotNull(), F.get(other, 0)["hex"]).alias("accent"))


def color_roles(candidates: DataFrame, semantic: DataFrame, threshold: float = 15.0) -> DataFrame:
    """site, ord, role, hex: primary, secondary, tertiary, surface, on-surface and error of each site.

    candidates: site, source (0 palette, 1 button, 2 link), ord, hex, confidence (of palettes); semantic: site, role, hex. Roles
    that elements name stay; the others go, in order, to colours not yet used: primary and secondary to the most saturated,
    surface to the lightest, on-surface to the darkest. Of colours nearer than the threshold only the first is a candidate; unsure
    palette colours are none where there are surer ones.
    """
    rows = candidates.where(F.col("hex").rlike("^#[0-9a-fA-F]{6}$")).withColumn("hex", F.lower("hex"))
    level = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair)), F.col("confidence")), F.lit(0))
    sure = rows.groupBy("site").agg(F.coalesce(F.bool_or((F.col("source") == 0) & F.col("confidence").isin("high", "medium")), F.lit(False)).alias("has_sure"))
    admitted = (F.col("source") > 0) | ~F.col("has_sure") | F.col("confidence").isin("high", "medium")
    once = rows.join(sure, "site").groupBy("site", "hex").agg(F.min(F.when(admitted, F.struct("source", "ord"))).alias("first"), F.coalesce(F.max_by(F.when(F.col("source") == 0, level), F.when(F.col("source") == 0, F.col("ord"))), F.lit(0)).alias("level"))
    r, g, b = (color.channel(F.col("hex"), k) / 255.0 for k in range(3))
    ranked = once.where("first is not null").withColumn("rank", (F.greatest(r, g, b) - F.least(r, g, b)) * 100 + F.col("level")).withColumn("lum", 0.2126 * r + 0.7152 * g + 0.0722 * b)
    kept = ranked.join(leaders(ranked, ["-rank", "first"], threshold).where("hex = leader").select("site", "hex"), ["site", "hex"])
    place = F.struct((-F.col("rank")).alias("rank"), "first")
    lists = kept.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "hex"))).alias("by_rank"), F.array_sort(F.collect_list(F.struct("lum", place.alias("at"), "hex"))).alias("by_lum"))
    named = semantic.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("role", F.lower("hex").alias("hex")))).alias("named"))
    out = lists.join(named, "site", "full").withColumns({"named": F.coalesce("named", F.create_map().cast("map<string,string>")), **{c: F.transform(F.coalesce(F.col(c), F.array()), lambda x: x["hex"]) for c in ("by_rank", "by_lum")}}).withColumn("used", F.map_values("named"))
    for role, pool in (("primary", F.col("by_rank")), ("secondary", F.col("by_rank")), ("surface", F.reverse("by_lum")), ("on-surface", F.col("by_lum"))):
        own = F.try_element_at("named", F.lit(role))
        out = out.withColumn(role, F.coalesce(own, F.get(F.array_except(pool, F.col("used")), 0))).withColumn("used", F.concat("used", F.array(F.col(role))))
    said = lambda *names: [F.try_element_at("named", F.lit(n)) for n in names]
    final = {"primary": F.col("primary"), "secondary": F.col("secondary"), "tertiary": F.coalesce(*said("tertiary", "accent")), "surface": F.coalesce("surface", *said("background")), "on-surface": F.coalesce("on-surface", *said("text")), "error": said("error")[0]}
    each = F.array(*(F.struct(F.lit(k + 1).cast("long").alias("ord"), F.lit(role).alias("role"), final[role].alias("hex")) for k, role in enumerate(ROLES)))
    return out.select("site", F.explode(each).alias("x")).select("site", "x.*").where("hex is not null")


def named_sizes(values: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """site, ord, name, px: a site's smallest distinct sizes (site, px), ascending, under as many names."""
    sizes = values.groupBy("site").agg(F.slice(F.array_sort(F.collect_set("px")), 1, len(names)).alias("sizes"))
    return sizes.select("site", F.posexplode("sizes").alias("at", "px")).select("site", (F.col("at") + 1).cast("long").alias("ord"), F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1).alias("name"), "px")


def rounded_names(radii: DataFrame) -> DataFrame:
    """site, name, px: none for 0, full for 9999, and the four smallest others."""
    ends = radii.where("px in (0, 9999)").select("site", F.when(F.col("px") == 0, "none").otherwise("full").alias("name"), "px").distinct()
    return named_sizes(radii.where("px not in (0, 9999)"), CORNERS).select("site", "name", "px").union(ends)


def _refer(rows: DataFrame, column: str, tokens: DataFrame, value: str, group: str, into: str, plain: Column) -> DataFrame:
    """``into``: {group.name} of the site's token with the column's value, else the value itself."""
    known = tokens.select("site", F.col(value).alias(column), F.concat(F.lit("{" + group + "."), "name", F.lit("}")).alias("_ref"))
    return rows.join(known, ["site", column], "left").withColumn(into, F.coalesce("_ref", plain)).drop("_ref")


def component_tokens(components: DataFrame, roles: DataFrame, rounded: DataFrame) -> DataFrame:
    """site, name, background, color, rounded, padding: each site's first button with a background and first input, by reference
    to colour roles and corners where they have the value. components: site, kind (button, input), ord, background, foreground (hex), radius, padding (pixels)."""
    first = components.where("kind = 'input' or background is not null").groupBy("site", "kind").agg(F.min(F.struct("ord", F.lower("background").alias("background"), F.lower("foreground").alias("foreground"), "radius", "padding")).alias("x")).select("site", "kind", "x.*")
    once = roles.groupBy("site", "hex").agg(F.min_by("role", "ord").alias("name"))
    out = _refer(first, "background", once, "hex", "colors", "background_token", F.col("background"))
    out = _refer(out, "foreground", once, "hex", "colors", "color_token", F.col("foreground"))
    out = _refer(out, "radius", rounded, "px", "rounded", "rounded_token", F.concat(F.col("radius").cast("string"), F.lit("px")))
    return out.select("site", F.concat("kind", F.lit("-observed")).alias("name"), F.col("background_token").alias("background"), F.col("color_token").alias("color"), F.col("rounded_token").alias("rounded"), F.concat(F.col("padding").cast("string"), F.lit("px")).alias("padding"))
