"""Element observations to tokens: histograms, colour statistics, type styles. One group-by each, no collecting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaspan.functions import color, text


def top(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def spacing_histogram(obs: DataFrame, most: int = 20) -> DataFrame:
    """site, px, n, rank: the most used positive spacings, ties by size."""
    return top(obs.where("px > 0").groupBy("site", "px").agg(F.count("*").alias("n")), ["site"], [F.desc("n"), "px"], most)


def spacing_scale(histogram: DataFrame) -> DataFrame:
    """site, scale: base-8 if a common value is a multiple of 8, else base-4, else custom."""
    return histogram.groupBy("site").agg(F.when(F.bool_or(F.col("px") % 8 == 0), "base-8").when(F.bool_or(F.col("px") % 4 == 0), "base-4").otherwise("custom").alias("scale"))


def radius_histogram(obs: DataFrame, contexts: int = 5) -> DataFrame:
    """site, radius, n, confidence, elements: which elements have a radius, at most ``contexts`` named."""
    per = obs.groupBy("site", "radius", "tag").agg(F.count("*").alias("k"))
    out = per.groupBy("site", "radius").agg(F.sum("k").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("tag")), 1, contexts), ",").alias("elements"))
    return out.withColumn("confidence", F.when(F.col("n") > 10, "high").when(F.col("n") > 3, "medium").otherwise("low"))


def border_combinations(obs: DataFrame) -> DataFrame:
    """site, width, style, hex, n, confidence: width, style and colour together."""
    out = obs.withColumn("style", F.when(F.col("width") > 2, "dashed").otherwise("solid")).groupBy("site", "width", "style", "hex").agg(F.count("*").alias("n"))
    return out.withColumn("confidence", F.when(F.col("n") > 10, "high").when(F.col("n") > 3, "medium").otherwise("low"))


def shadow_histogram(obs: DataFrame) -> DataFrame:
    """site, shadow, n, confidence, blur: zero-alpha layers dropped, white space made one, blur the largest third length."""
    raw = F.concat(F.lit("0px "), F.col("width").cast("string"), F.lit("px  "), F.col("radius").cast("string"), F.lit("px "), F.col("hex"), F.lit(", 0 0 9px rgba(0, 0, 0, 0)"))
    return shadows(obs.groupBy("site", "width", "radius", "hex").agg(F.count("*").alias("n")).withColumn("shadow", raw))


def shadows(rows: DataFrame) -> DataFrame:
    """rows: site, shadow and, optionally, n (uses). Each distinct text of a site is taken apart once."""
    rows = rows.groupBy("site", "shadow").agg(F.sum("n" if "n" in rows.columns else F.lit(1)).cast("long").alias("n"))
    layers = F.transform(F.split("shadow", r",(?![^(]*\))"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    kept = F.filter(layers, lambda x: ~F.lower(x).rlike(r"transparent|rgba\([^)]*,\s*0(\.0+)?\s*\)|/\s*0(\.0+)?\s*\)"))
    # bound to the count: a filter on the key alone would be worked out below the aggregate, for every element
    clean = rows.withColumn("shadow", F.when(F.col("n") > 0, F.array_join(kept, ", "))).where("shadow <> ''")
    blur = F.array_max(F.transform(F.split("shadow", r",(?![^(]*\))"), lambda x: F.coalesce(text.leading_number(F.regexp_extract(x, r"(?:-?[0-9.]+(?:px)?\s+){2}(-?[0-9.]+)", 1)), F.lit(0.0))))
    out = clean.groupBy("site", "shadow").agg(F.sum("n").alias("n"))
    return out.withColumn("confidence", F.when(F.col("n") > 5, "high").when(F.col("n") > 2, "medium").otherwise("low")).withColumn("blur", blur.cast("long"))


def color_statistics(obs: DataFrame) -> DataFrame:
    """site, hex, n, bg, score, is_token, share: usage of each colour, and its share of the site's."""
    out = obs.groupBy("site", "hex").agg(F.count("*").alias("n"), F.count_if("is_bg").alias("bg"), F.sum("score").alias("score"), F.bool_or("is_token").alias("is_token"))
    return out.withColumn("share", text.scaled(F.col("n") / F.sum("n").over(Window.partitionBy("site")), 1_000_000))


def palette(stats: DataFrame) -> DataFrame:
    """Admitted colours with capped confidence and role: enough use or score, and no structural noise."""
    total = F.sum("n").over(Window.partitionBy("site"))
    sat = color.saturation(F.col("hex"))
    noise = ~F.col("is_token") & (((F.col("n") * 100 > 40 * F.col("total")) & (F.col("score") < 1.2 * F.col("n")) & (sat <= 0.2)) | ((F.col("bg") == 0) & (F.col("score") < 1.5 * F.col("n")) & (sat > 0.3)))
    enough = F.col("is_token") | (F.col("score") >= 10) | (F.col("score") >= 3 * F.col("n")) | (F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("total") * 0.01)))
    confidence = F.when(F.col("is_token"), F.when(F.col("score") > 5, "high").otherwise("medium")).when(F.col("score") > 20, "high").when(F.col("score") > 5, "medium").otherwise("low")
    kept = stats.withColumn("total", total).where(enough & ~noise).withColumn("confidence", color.capped(confidence, F.col("n")))
    return kept.select("site", "hex", "n", "score", "confidence", color.role(F.col("hex"), F.col("confidence")).alias("role"), color.on_color(F.col("hex")).alias("on_color"))


def primary_colors(stats: DataFrame) -> DataFrame:
    """site, hex, n: the most used chromatic colour, tokens 20 ahead; ties by hex."""
    chromatic = stats.where(color.saturation(F.col("hex")) > 0.3).withColumn("points", F.col("n") + F.when(F.col("is_token"), 20).otherwise(0))
    return top(chromatic, ["site"], [F.desc("points"), "hex"], 1).select("site", "hex", "n", "points")


def type_styles(rows: DataFrame) -> DataFrame:
    """site, context, family, size, weight, n, first: distinct styles; first is the element that showed it first.

    Of the elements' columns class and role are optional.
    """
    said = lambda c: F.col(c) if c in rows.columns else F.lit("")
    styled = rows.withColumn("context", text.type_context(F.col("tag"), F.col("size"), said("class"), said("role")))
    return styled.groupBy("site", "context", "family", "size", "weight").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def body_family(rows: DataFrame) -> DataFrame:
    """site, family, weight: the family with most text of 11 to 24 px, the first seen on ties."""
    own = rows.where("size between 11 and 24 and tag = 'P'").groupBy("site", "family").agg(F.sum("size").alias("weight"), F.min("ord").alias("first"))
    return top(own, ["site"], [F.desc("weight"), "first"], 1).select("site", "family", "weight")


def family_floor(rows: DataFrame, least: int = 3, share: float = 0.02) -> DataFrame:
    """site, family, n, kept: families of enough use; where none has it, all are kept."""
    site = Window.partitionBy("site")
    out = rows.groupBy("site", "family").agg(F.count("*").alias("n"))
    good = (F.col("n") >= least) & (F.col("n") >= share * F.sum("n").over(site))
    out = out.withColumn("good", good)
    return out.select("site", "family", "n", (F.col("good") | ~F.max("good").over(site)).alias("kept"))


def motion(events: DataFrame, most: int = 8) -> DataFrame:
    """context, easing, n, ms: how often each easing is used in a context, and the shortest duration; top ``most``."""
    out = events.groupBy("context", "easing").agg(F.count("*").alias("n"), F.min("ms").alias("ms"))
    return top(out, ["context"], [F.desc("n"), "easing"], most)
