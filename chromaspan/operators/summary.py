"""Cores of reports: gathered colours and fonts, family and section views, liveness, cohorts, residual variables, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaspan.functions import color
from chromaspan.functions.color import let

#: Limits of hue names, in degrees, from red on; and lightnesses of greys.
HUES = ((15, "Red"), (45, "Orange"), (70, "Yellow"), (160, "Green"), (200, "Teal"), (255, "Blue"), (290, "Purple"), (345, "Pink"), (361, "Red"))
GREYS = ((0.92, "White"), (0.6, "Light Gray"), (0.32, "Gray"), (0.1, "Dark Gray"))
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def hue_name(hex_: Column) -> Column:
    """A descriptive name by hue and lightness."""

    def named(x: Column) -> Column:
        r, g, b = x["r"] / 255.0, x["g"] / 255.0, x["b"] / 255.0
        high, low = F.greatest(r, g, b), F.least(r, g, b)

        def of(v: Column) -> Column:
            turn = F.when(v["high"] == v["r"], F.pmod((v["g"] - v["b"]) / v["d"], F.lit(6.0))).when(v["high"] == v["g"], (v["b"] - v["r"]) / v["d"] + 2).otherwise((v["r"] - v["g"]) / v["d"] + 4) * 60
            grey = F.coalesce(*(F.when(v["l"] > least, name) for least, name in GREYS), F.lit("Black"))
            return F.when((v["high"] == 0) | (v["d"] / v["high"] < 0.10), grey).otherwise(let(turn, lambda h: F.coalesce(*(F.when(h < most, name) for most, name in HUES))))

        return let(F.struct(r.alias("r"), g.alias("g"), b.alias("b"), high.alias("high"), (high - low).alias("d"), ((high + low) / 2).alias("l")), of)

    rgb = F.struct(*(color.channel(hex_, k).alias(n) for k, n in enumerate("rgb")))
    return F.when(color.channel(hex_, 0).isNull(), "Color").otherwise(let(rgb, named))


def gathered_colors(rows: DataFrame) -> DataFrame:
    """site, hex, label, confidence, source, at: the first of each hex over the sources (rows: site, source, rank of the
    source, ord, label, hex, confidence), numbered in that order."""
    once = rows.groupBy("site", F.lower("hex").alias("hex")).agg(F.min(F.struct("rank", "ord", "label", "confidence", "source")).alias("x"))
    at = F.row_number().over(Window.partitionBy("site").orderBy("x.rank", "x.ord", "hex")).cast("long")
    return once.select("site", "hex", "x.label", "x.confidence", "x.source", at.alias("at"))


def color_labels(rows: DataFrame) -> DataFrame:
    """site, hex, labels, source, confidence: one row a hex; distinct labels in order, the first source, the best confidence."""
    level = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))
    out = rows.groupBy("site", F.lower("hex").alias("hex")).agg(
        F.array_sort(F.collect_set(F.when(F.col("label") != "", F.struct("rank", "ord", "label")))).alias("labels"), F.min_by("source", "rank").alias("source"),
        F.max_by("confidence", F.try_element_at(level, F.col("confidence"))).alias("confidence"))
    return out.select("site", "hex", F.array_join(F.array_distinct(F.transform("labels", lambda x: x["label"])), ", ").alias("labels"), "source", "confidence")


def gathered_fonts(styles: DataFrame) -> DataFrame:
    """site, family, weights, sizes: distinct weights ascending, and how many styles have a size."""
    out = styles.where("coalesce(family, '') <> ''").groupBy("site", "family").agg(F.array_sort(F.collect_set("weight")).alias("weights"), F.count("size").alias("sizes"))
    return out.withColumn("weights", F.array_join(F.col("weights").cast("array<string>"), ","))


def family_summary(styles: DataFrame) -> DataFrame:
    """site, family, sizes, weights: sizes descending with the context that shows each first, and weights other than 400."""
    sizes = styles.where("coalesce(family, '') <> '' and size > 0").groupBy("site", "family", "size").agg(F.min_by("context", "first").alias("context"))
    said = F.concat(F.col("size").cast("string"), F.lit("px ("), "context", F.lit(")"))
    listed = sizes.groupBy("site", "family").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("k"), said.alias("said")))).alias("all"))
    weights = styles.where("weight <> 400").groupBy("site", "family").agg(F.array_join(F.array_sort(F.collect_set("weight")).cast("array<string>"), ", ").alias("weights"))
    return listed.join(weights, ["site", "family"], "left").select("site", "family", F.array_join(F.transform("all", lambda x: x["said"]), ", ").alias("sizes"), F.coalesce("weights", F.lit("")).alias("weights"))


def section_view(rows: DataFrame, value: str, most: int, by_confidence: bool = False) -> DataFrame:
    """site, rank, value: a section's sure entries (n, confidence), by use, or first by confidence; the first ``most``."""
    level = F.when(F.col("confidence") == "high", 0).otherwise(1)
    order = ([level] if by_confidence else []) + [F.desc("n"), value]
    ranked = rows.where("confidence in ('high', 'medium')").withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most).select("site", "rank", F.col(value).cast("string").alias("value"))


def liveness(runs: DataFrame, allowed: float = 0.25) -> DataFrame:
    """run, sites, failed, ok from (run, site, code, colors, styles, degraded): a site fails by its exit code, or if it gave
    nothing and nothing is said to be degraded; a run fails if more than the allowed share of its sites do."""
    bad = (F.col("code") != 0) | ((F.col("colors") == 0) & (F.col("styles") == 0) & (F.col("degraded") == 0))
    out = runs.groupBy("run").agg(F.count("*").alias("sites"), F.count_if(bad).alias("failed"))
    return out.withColumn("ok", F.col("failed") / F.col("sites") <= allowed)


def cohort(values: DataFrame) -> DataFrame:
    """one, two, category, common, either: how many values two sites share, for every two that share any, by an equi-join on
    (category, value)."""
    own = values.select("site", "category", "value").distinct()
    size = own.groupBy("site", "category").agg(F.count("*").alias("n"))
    a, b = own.select(F.col("site").alias("one"), "category", "value"), own.select(F.col("site").alias("two"), "category", "value")
    pairs = a.join(b, ["category", "value"]).where("one < two").groupBy("one", "two", "category").agg(F.count("*").alias("common"))
    out = pairs.join(size.select(F.col("site").alias("one"), "category", F.col("n").alias("n1")), ["one", "category"]).join(size.select(F.col("site").alias("two"), "category", F.col("n").alias("n2")), ["two", "category"])
    return out.select("one", "two", "category", "common", (F.col("n1") + F.col("n2") - F.col("common")).alias("either"))


def residual_variables(variables: DataFrame, palette: DataFrame, threshold: float = 15.0) -> DataFrame:
    """site, hex, name: variables (site, name, ord, hex) whose colour is neither in the site's palette (site, hex) nor nearer
    than the threshold to one of it; the first name of each colour."""
    first = variables.groupBy("site", "hex").agg(F.min_by("name", F.struct("ord", "name")).alias("name")).withColumn("lab", color.lab(F.col("hex")))
    there = palette.groupBy("site").agg(F.collect_list(color.lab(F.col("hex"))).alias("there"))
    far = first.join(there, "site", "left").where(~F.exists(F.coalesce("there", F.array()), lambda p: color.delta_e(p, F.col("lab")) < threshold))
    return far.select("site", "hex", "name")


def declared(palette: DataFrame, variables: DataFrame) -> DataFrame:
    """The palette with declared: whether a variable of the site has the colour."""
    names = variables.select("site", "hex").distinct().withColumn("declared", F.lit(True))
    return palette.join(names, ["site", "hex"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


def approved_baselines(baselines: DataFrame, approvals: DataFrame) -> DataFrame:
    """baselines (site, base_id, local) after approvals (site, snapshot_id): only local ones are replaced."""
    new = approvals.groupBy("site").agg(F.max("snapshot_id").alias("snapshot_id"))
    return baselines.join(new, "site", "left").select("site", F.when(F.col("local"), F.coalesce("snapshot_id", "base_id")).otherwise(F.col("base_id")).alias("base_id"), "local")


def hue_order(hex_: Column) -> Column:
    """A sort key: by hue to a thousandth of a degree, greys last by lightness."""
    rgb = [color.channel(hex_, k) for k in range(3)]
    high = F.greatest(*rgb)
    d = F.nullif(high - F.least(*rgb), F.lit(0))
    turn = F.when(high == rgb[0], F.pmod((rgb[1] - rgb[2]) / d, F.lit(6.0))).when(high == rgb[1], (rgb[2] - rgb[0]) / d + 2).otherwise((rgb[0] - rgb[1]) / d + 4) * 60
    grey = d.isNull() | (d < 0.1 * high)
    return F.struct(grey.alias("grey"), F.floor(F.when(grey, (high + F.least(*rgb)) / 510.0).otherwise(turn) * 1000 + 0.5).alias("at"), hex_.alias("hex"))
