"""Contrast, duplication, hierarchy and grid findings; theme tokens and aliases; report counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaspan.functions import color, text
from chromaspan.lineage import cut

from .extract import top


def near_identical(palette: DataFrame, limit: float = 1.0) -> DataFrame:
    """site, one, two: distinct colours of a site less than ``limit`` apart by CIEDE2000."""
    once = palette.select("site", "hex").distinct().withColumn("lab", color.lab(F.col("hex")))
    a, b = once.alias("a"), once.alias("b")
    pairs = a.join(b, (F.col("a.site") == F.col("b.site")) & (F.col("a.hex") < F.col("b.hex")))
    return pairs.select(F.col("a.site").alias("site"), F.col("a.hex").alias("one"), F.col("b.hex").alias("two"), color.ciede2000(F.col("a.lab"), F.col("b.lab")).alias("delta")).where(F.col("delta") < limit)


def palette_contrast(palette: DataFrame, most: int = 10) -> DataFrame:
    """site, fg, bg, ratio (x100), aa, aa_large, aaa: all pairs of a site's first colours, the lighter one first."""
    first = top(palette, ["site"], [F.desc("n"), "hex"], most).select("site", "hex", color.luminance(F.col("hex")).alias("lum"))
    a, b = first.alias("a"), first.alias("b")
    pairs = a.join(b, (F.col("a.site") == F.col("b.site")) & ((F.col("a.lum") > F.col("b.lum")) | ((F.col("a.lum") == F.col("b.lum")) & (F.col("a.hex") < F.col("b.hex")))))
    ratio = color.contrast(F.col("a.lum"), F.col("b.lum"))
    return pairs.select(F.col("a.site").alias("site"), F.col("a.hex").alias("fg"), F.col("b.hex").alias("bg"), text.scaled(ratio, 100).alias("ratio"), (ratio >= 4.5).alias("aa"), (ratio >= 3).alias("aa_large"), (ratio >= 7).alias("aaa"))


def hierarchy_collisions(styles: DataFrame) -> DataFrame:
    """site, size, weight, roles: headings that look like another heading or like text."""
    is_head = lambda r: r.rlike("(?i)heading|display|title|^h[1-6]$")
    roles = F.array_sort(F.collect_set("context"))
    out = styles.groupBy("site", "size", "weight").agg(roles.alias("roles"))
    heads, said = F.size(F.filter("roles", is_head)), F.exists("roles", lambda r: r.rlike("(?i)body|text|paragraph|^p$"))
    return out.where((F.size("roles") >= 2) & ((heads >= 2) | ((heads >= 1) & said))).select("site", "size", "weight", F.array_join(F.slice("roles", 1, 4), ",").alias("roles"))


def off_grid(spacing: DataFrame, scale: DataFrame) -> DataFrame:
    """site, px: common spacings that break the site's grid."""
    base = F.when(F.col("scale") == "base-8", 8).when(F.col("scale") == "base-4", 4)
    return spacing.join(scale, "site").where((F.col("px") >= base) & (F.col("px") % base != 0)).select("site", "px")


def finding_scores(sites: DataFrame, duplicates: DataFrame, collisions: DataFrame, grid: DataFrame, primary: DataFrame) -> DataFrame:
    """site, consistency, contrast: 100 less 6 for every warning, not under 0."""
    n = lambda df, name: df.groupBy("site").agg(F.count("*").alias(name))
    weak = primary.where(color.contrast(color.luminance(F.col("hex")), F.lit(1.0)) < 4.5)
    out = sites.join(n(duplicates, "d"), "site", "left").join(n(collisions, "h"), "site", "left").join(n(grid, "g"), "site", "left").join(n(weak, "w"), "site", "left")
    c = lambda name: F.coalesce(name, F.lit(0))
    return out.select("site", F.greatest(F.lit(0), 100 - 6 * (c("d") + c("h") + F.when(c("g") > 0, 1).otherwise(0))).alias("consistency"), F.greatest(F.lit(0), 100 - 6 * c("w")).alias("contrast"))


def theme_tokens(palette: DataFrame, spacing: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """site, section, ord, name, value: what a theme file lists. Colours by role with unique names; spacings used
    at least a fifth as often as the most used, at most 8, ascending."""
    from pyspark.sql import Window

    colors = top(palette, ["site"], [F.desc("n"), "hex"], 24)
    nth = F.row_number().over(Window.partitionBy("site", "role").orderBy("rank"))
    name = F.when(nth == 1, F.col("role")).otherwise(F.concat_ws("-", "role", nth.cast("string")))
    shown = colors.select("site", F.lit("color").alias("section"), F.col("rank").alias("ord"), name.alias("name"), F.col("hex").alias("value"))
    most = F.max("n").over(Window.partitionBy("site"))
    used = top(spacing.drop("rank").withColumn("most", most).where("n >= 0.2 * most and px > 0"), ["site"], [F.desc("n"), "px"], 8)
    at = F.row_number().over(Window.partitionBy("site").orderBy("px")).cast("long")
    return shown.union(used.select("site", F.lit("spacing").alias("section"), at.alias("ord"), at.cast("string").alias("name"), F.concat(F.col("px").cast("string"), F.lit("px")).alias("value")))


def resolve_aliases(tokens: DataFrame) -> DataFrame:
    """doc_id, path, value, state: aliases {a.b} followed to their value; state ok, missing or cycle.

    Each round joins the table with itself by (doc_id, path), which doubles how far a pointer reaches. A chain is
    shorter than its document, so what still points on after that many steps is on its way round a cycle.
    """
    target = lambda c: F.regexp_extract(c, r"^\{([^{}]+)\}$", 1)
    most = tokens.groupBy("doc_id").count().agg(F.max("count").alias("n")).first()["n"] or 0
    at = tokens.select("doc_id", "path", "value", F.lit("ok").alias("state"))
    for _ in range(max(1, int(most).bit_length())):
        at = cut(at)  # or plans would double as well
        known = at.select("doc_id", F.col("path").alias("to"), F.col("value").alias("next"))
        at = at.withColumn("to", target(F.col("value"))).join(known, ["doc_id", "to"], "left")
        points = (F.col("to") != "") & (F.col("state") == "ok")
        state = F.when(points & F.col("next").isNull(), "missing").when(points & (F.col("to") == F.col("path")), "cycle").otherwise(F.col("state"))
        at = at.select("doc_id", "path", F.when(points & F.col("next").isNotNull() & (F.col("to") != F.col("path")), F.col("next")).otherwise(F.col("value")).alias("value"), state.alias("state"))
    return at.withColumn("state", F.when((F.col("state") == "ok") & (target(F.col("value")) != ""), "cycle").otherwise(F.col("state")))


def report_counts(tokens: DataFrame) -> DataFrame:
    """site, type, n: tokens per site and type with totals (null)."""
    return tokens.rollup("site", "type").agg(F.count("*").alias("n"))
