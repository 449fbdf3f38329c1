"""Snapshots as JSON to canonical records and to rows of tokens.

Members that come in several shapes are read as text and brought to one: weights and spacings to numbers, fonts given
as true or false to no names, inputs and badges given by kind to the plain list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaspan.functions import text

SCHEMA = """url string, extractedAt string, meta struct<snapshotId: string, degraded: array<string>, errors: array<struct<stage: string, reason: string>>>,
colors struct<semantic: map<string, string>, palette: array<struct<color: string, normalized: string, count: long, confidence: string>>, cssVariables: map<string, string>>,
typography struct<styles: array<struct<context: string, family: string, fontFamily: string, size: string, fontSize: string, weight: string, count: long>>, sources: struct<adobeFonts: string>>,
spacing struct<scaleType: string, commonValues: array<struct<px: string, display: string, count: long>>>, borderRadius struct<values: array<struct<value: string, count: long, confidence: string>>>,
shadows array<struct<shadow: string, count: long, confidence: string>>, components struct<inputs: string, badges: string>"""


def normalized(documents: DataFrame) -> DataFrame:
    """(doc_id, json) to the columns of SCHEMA in canonical form; members that are not in it, such as those that only a crawl
    needs, are dropped. A document that cannot be read has nulls."""
    rows = documents.select("doc_id", F.from_json("json", SCHEMA).alias("s")).select("doc_id", "s.*")
    style = lambda x: F.struct(
        x["context"].alias("context"), F.coalesce(x["family"], x["fontFamily"]).alias("family"), F.coalesce(x["size"], x["fontSize"]).alias("size"), text.leading_number(x["weight"]).cast("int").alias("weight"), x["count"].alias("count"))
    px = lambda x: text.leading_number(x["px"])
    shown = lambda x: F.coalesce(x["display"], F.concat(text.trimmed_number(px(x).cast("string")), F.lit("px")), x["px"])
    space = lambda x: F.struct(px(x).alias("px"), shown(x).alias("display"), x["count"].alias("count"))
    plain = lambda c, kind: F.when(F.ltrim(c).startswith("{"), F.coalesce(F.get_json_object(c, f"$.{kind}"), F.lit("[]"))).otherwise(c)
    role = lambda k, v: F.when(F.ltrim(v).startswith("{"), F.get_json_object(v, "$.color")).otherwise(v)
    return rows.select(
        "doc_id", "url", "extractedAt", "meta", F.transform_values("colors.semantic", role).alias("semantic"), F.col("colors.palette").alias("palette"),
        F.transform_values("colors.cssVariables", lambda k, v: F.when(F.ltrim(v).startswith("{"), F.get_json_object(v, "$.value")).otherwise(v)).alias("variables"),
        F.transform("typography.styles", style).alias("styles"), F.when(F.col("typography.sources.adobeFonts").isin("true", "false"), "[]").otherwise(F.col("typography.sources.adobeFonts")).alias("adobe_fonts"),
        F.col("spacing.scaleType").alias("scale"), F.transform("spacing.commonValues", space).alias("spacing"), F.col("borderRadius.values").alias("radii"), "shadows",
        plain(F.col("components.inputs"), "text").alias("inputs"), plain(F.col("components.badges"), "all").alias("badges"))


def tokens(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, category, ord, key, value, num, confidence, count of normalized() rows: what drift compares."""
    none, sure = F.lit(None).cast("string"), F.lit("high")

    def each(items, category, key, value, num, confidence, count):
        made = lambda x, i: F.struct(F.lit(category).alias("category"), i.cast("long").alias("ord"), key(x).alias("key"), value(x).alias("value"), num(x).cast("double").alias("num"), confidence(x).alias("confidence"), F.coalesce(count(x), F.lit(1)).cast("long").alias("count"))
        return F.coalesce(F.transform(items, made), F.array().cast("array<struct<category: string, ord: bigint, key: string, value: string, num: double, confidence: string, count: bigint>>"))

    no, many = (lambda x: none), (lambda x: x["count"])
    parts = F.concat(
        each(F.map_entries("semantic"), "semantic", lambda x: x["key"], lambda x: x["value"], no, lambda x: sure, no),
        each(F.col("palette"), "color", no, lambda x: F.coalesce(x["normalized"], x["color"]), no, lambda x: x["confidence"], many),
        each(F.col("styles"), "typography", lambda x: x["context"], lambda x: F.concat_ws("/", x["family"], x["weight"].cast("string"), x["size"]), lambda x: text.leading_number(x["size"]), lambda x: sure, many),
        each(F.col("spacing"), "spacing", no, lambda x: x["display"], lambda x: x["px"], lambda x: sure, many),
        each(F.col("radii"), "radius", no, lambda x: x["value"], lambda x: text.leading_number(x["value"]), lambda x: x["confidence"], many),
        each(F.col("shadows"), "shadow", no, lambda x: x["shadow"], no, lambda x: x["confidence"], many))
    return snapshots.select(F.coalesce("meta.snapshotId", F.concat_ws("@", "url", "extractedAt"), F.col("doc_id").cast("string")).alias("snapshot_id"), F.explode(parts).alias("x")).select("snapshot_id", "x.*")
