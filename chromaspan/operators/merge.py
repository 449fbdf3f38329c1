"""Tokens of several pages to tokens of a site: keyed unions where the first page wins, sums, and colour clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """One row per key: the value of the first row in order that has one."""
    return rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(value))


def typography(styles: DataFrame) -> DataFrame:
    """site, family, size, weight, n: n counts the rows of pages, not their elements; context of the first."""
    return styles.groupBy("site", "family", "size", "weight").agg(F.count("*").alias("n"), F.min_by("context", F.struct("page_ord", "context")).alias("context"))


def spacing(rows: DataFrame) -> DataFrame:
    """site, px, n, pages."""
    return rows.groupBy("site", "px").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


def radii(rows: DataFrame) -> DataFrame:
    """site, radius, n, confidence: bucketed anew by the sum; below, the first page's stays."""
    out = rows.groupBy("site", "radius").agg(F.sum("n").alias("n"), F.min_by("confidence", "page_id").alias("own"))
    return out.select("site", "radius", "n", F.when(F.col("n") > 10, "high").when(F.col("n") > 3, "medium").otherwise(F.col("own")).alias("confidence"))


def breakpoints(rows: DataFrame) -> DataFrame:
    """site, breakpoints: all distinct ones, descending, joined by commas."""
    return rows.groupBy("site").agg(F.array_join(F.reverse(F.array_sort(F.collect_set("px"))), ",").alias("breakpoints"))


def contrast_pairs(rows: DataFrame, most: int = 50) -> DataFrame:
    """site, one, two, n: unordered pairs of colours, the most frequent."""
    from .extract import top

    pair = F.array_sort(F.array("fg", "bg"))
    out = rows.groupBy("site", pair[0].alias("one"), pair[1].alias("two")).agg(F.sum("n").alias("n"))
    return top(out, ["site"], [F.desc("n"), "one", "two"], most)


def leaders(colors: DataFrame, order: list, threshold: float = 15.0) -> DataFrame:
    """site, hex, leader: each colour of a site (site, hex and the columns of ``order``, one row a colour) goes to the first
    leader nearer than the threshold, in order; a colour without one leads. A fold over the site's distinct colours."""
    from chromaspan.functions import color

    item = F.struct(*(F.expr(c).alias(f"o{k}") for k, c in enumerate(order)), "hex", color.lab(F.col("hex")).alias("lab"))
    gathered = colors.groupBy("site").agg(F.array_sort(F.collect_list(item)).alias("colors"))
    none = F.array().cast("array<struct<hex: string, lab: struct<l: double, a: double, b: double>>>")

    def step(acc, c):
        near = F.get(F.filter(acc["led"], lambda x: color.delta_e(x["lab"], c["lab"]) < threshold), 0)
        own = F.struct(c["hex"].alias("hex"), c["lab"].alias("lab"))
        return color.let(near, lambda n: F.struct(F.when(n.isNull(), F.array_append(acc["led"], own)).otherwise(acc["led"]).alias("led"), F.array_append(acc["out"], F.struct(c["hex"].alias("hex"), F.coalesce(n["hex"], c["hex"]).alias("leader"))).alias("out")))

    start = F.struct(none.alias("led"), F.array().cast("array<struct<hex: string, leader: string>>").alias("out"))
    return gathered.select("site", F.explode(F.aggregate("colors", start, step)["out"]).alias("x")).select("site", "x.hex", "x.leader")


def leader_clusters(colors: DataFrame, threshold: float = 15.0) -> DataFrame:
    """site, hex, n, leader, shown: colours (site, hex, n, ord and optionally is_token) around leaders in descending use.

    shown is the colour that stands for the cluster: a token if it has one, else the most used.
    """
    token = F.max("is_token") if "is_token" in colors.columns else F.lit(False)
    once = colors.groupBy("site", "hex").agg(F.sum("n").alias("n"), F.min("ord").alias("ord"), token.alias("is_token"))
    named = once.join(leaders(once, ["-n", "ord"], threshold), ["site", "hex"])
    best = named.groupBy("site", "leader").agg(F.min_by("hex", F.struct(~F.col("is_token"), -F.col("n"), "ord", "hex")).alias("shown"))
    return named.join(best, ["site", "leader"]).select("site", "hex", "n", "leader", "shown")


def palettes(colors: DataFrame, threshold: float = 15.0) -> DataFrame:
    """site, hex, n, members, pages, confidence: palettes of pages (site, page_id, ord, hex, n, confidence) merged.

    Entries are pooled by page and order, the first of a cluster leads, the most used one stands for it with its
    confidence, lifted for colours of several pages.
    """
    first = colors.groupBy("site", "hex").agg(F.min(F.struct("page_id", "ord")).alias("first"))
    each = colors.join(leaders(first, ["first"], threshold), ["site", "hex"])
    out = each.groupBy("site", "leader").agg(F.sum("n").alias("n"), F.count("*").alias("members"), F.count_distinct("page_id").alias("pages"), F.min_by(F.struct("hex", "confidence"), F.struct(-F.col("n"), "page_id", "ord", "hex")).alias("best"))
    once = F.when((F.col("pages") > 1) & (F.col("best.confidence") == "low"), "medium").otherwise(F.col("best.confidence"))
    return out.select("site", "best.hex", "n", "members", "pages", F.when((F.col("pages") > 2) & (once == "medium"), "high").otherwise(once).alias("confidence"))


def font_sources(rows: DataFrame) -> DataFrame:
    """site, kind, names: what pages (site, page_ord, kind, ord, name) name as font sources, united in order; urls sorted."""
    first = rows.groupBy("site", "kind", "name").agg(F.min(F.struct("page_ord", "ord")).alias("first"))
    listed = first.groupBy("site", "kind").agg(F.array_sort(F.collect_list(F.struct("first", "name"))).alias("all"))
    names = F.transform("all", lambda x: x["name"])
    return listed.select("site", "kind", F.when(F.col("kind") == "urls", F.array_sort(names)).otherwise(names).alias("names"))


def by_name(rows: DataFrame, value: str) -> DataFrame:
    """site, name and the value of the first page (site, page_ord, ord, name) that has the name: icon sets, frameworks."""
    return rows.groupBy("site", "name").agg(F.min_by(value, F.struct("page_ord", "ord")).alias(value))
