"""Names of tokens: those that authors gave to values, and unique ones within a site's list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaspan.functions import color

from .merge import leaders

#: The most colours of a theme, and the distance under which a colour is one already listed.
MOST_COLORS, SAME = 24, 15.0


def authored_names(variables: DataFrame) -> DataFrame:
    """site, hex, name: the first custom property (site, ord, name, hex) with a colour, without dashes and words for colour."""
    cleaned = F.regexp_replace(F.regexp_replace("name", "^--", ""), "^(colors?|c)-", "")
    return variables.withColumn("name", cleaned).where("name <> '' and hex is not null").groupBy("site", F.lower("hex").alias("hex")).agg(F.min_by("name", F.struct("ord", "name")).alias("name"))


def unique_names(rows: DataFrame) -> DataFrame:
    """The rows (site, ord, name and others; bounded lists) with names made unique in their order: -2, -3 and so on, whichever is free.

    A free suffix depends on all names given before, suffixed ones too, so it is a fold over a site's list.
    """
    rest = [c for c in rows.columns if c not in ("site", "ord", "name")]
    listed = rows.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "name", *rest))).alias("rows"))

    def step(used, row):
        free = F.filter(F.sequence(F.lit(2), F.size(used) + 2), lambda k: ~F.array_contains(used, F.concat(row["name"], F.lit("-"), k.cast("string"))))
        return F.array_append(used, F.when(F.array_contains(used, row["name"]), F.concat(row["name"], F.lit("-"), F.get(free, 0).cast("string"))).otherwise(row["name"]))

    names = F.aggregate("rows", F.array().cast("array<string>"), step)
    each = listed.select("site", F.explode(F.zip_with("rows", names, lambda r, n: F.struct(r.alias("r"), n.alias("name")))).alias("x"))
    return each.select("site", "x.r.ord", "x.name", *(F.col(f"x.r.{c}").alias(c) for c in rest))


def theme_name(c: Column) -> Column:
    """A part of a declared name: never empty and never with a digit in front."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "token").when(slug.rlike("^[0-9]"), F.concat(F.lit("n"), slug)).otherwise(slug)


def theme_colors(semantic: DataFrame, palette: DataFrame, variables: DataFrame, most: int = MOST_COLORS, same: float = SAME) -> DataFrame:
    """site, ord, name, hex, source: a theme's colours. Named roles (site, ord, role, hex) first, then surer palette colours (site, ord,
    hex, confidence, and is_variant) under the author's name for them or as brand-1, brand-2; near ones are listed once."""
    authored = authored_names(variables)
    roles = semantic.select("site", F.lit(0).alias("source"), F.col("ord").cast("long").alias("ord"), F.lower("hex").alias("hex"), F.col("role").alias("said"))
    surer = palette.where("confidence in ('high', 'medium') and not is_variant").select("site", F.lit(1).alias("source"), F.col("ord").cast("long").alias("ord"), F.lower("hex").alias("hex"), F.lit(None).cast("string").alias("said"))
    once = roles.union(surer).where(color.channel(F.col("hex"), 0).isNotNull()).groupBy("site", "hex").agg(F.min(F.struct("source", "ord", "said")).alias("first"))
    shown = once.join(leaders(once, ["first"], same).where("hex = leader").select("site", "hex"), ["site", "hex"]).join(authored, ["site", "hex"], "left")
    place = F.row_number().over(Window.partitionBy("site").orderBy("first", "hex")).cast("long")
    own = F.coalesce("first.said", F.when(F.col("first.source") == 1, F.col("name")))
    shown = shown.withColumn("ord", place).where(F.col("ord") <= most).withColumn("own", own)
    nth = F.count(F.when(F.col("own").isNull(), 1)).over(Window.partitionBy("site").orderBy("ord"))
    source = F.when(F.col("first.said").isNotNull(), "semantic").when(F.col("name").isNotNull(), "css variable").otherwise("palette")
    named = shown.select("site", "ord", F.concat(F.lit("--color-"), theme_name(F.coalesce("own", F.concat(F.lit("brand-"), nth.cast("string"))))).alias("name"), "hex", source.alias("source"))
    return unique_names(named)
