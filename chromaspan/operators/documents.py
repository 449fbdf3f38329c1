"""Token documents: nested JSON to rows, counts, inherited groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaspan.lineage import cut

def flatten(documents: DataFrame) -> DataFrame:
    """doc_id, path, type, value of (doc_id, json): a row per token (an object with $value or $ref), with the type of the
    nearest group above where it has none of its own; a document that cannot be read has one row with type 'invalid JSON'.

    One step a level of nesting, until no group is left.
    """
    level = documents.select("doc_id", F.lit("").alias("path"), F.lit(None).cast("string").alias("type"), F.col("json").alias("value"), F.from_json("json", "map<string, string>", {"mode": "PERMISSIVE"}).alias("own"))
    wrong = F.col("own").isNull() | (F.size("own") == 0) & ~F.trim("value").rlike(r"^\{\s*\}$")
    found = level.where(wrong).select("doc_id", "path", F.lit("invalid JSON").alias("type"), "value")
    level = level.where(~wrong)
    while not level.isEmpty():
        level = level.withColumn("type", F.coalesce(F.try_element_at("own", F.lit("$type")), "type"))
        told = F.coalesce(F.try_element_at("own", F.lit("$value")), F.try_element_at("own", F.lit("$ref")))
        is_token = F.exists(F.map_keys("own"), lambda k: k.isin("$value", "$ref"))
        found = found.union(level.where(is_token).select("doc_id", "path", "type", told.alias("value")))
        inner = level.where(~is_token).select("doc_id", F.col("path").alias("up"), "type", F.explode("own").alias("name", "value"))
        inner = inner.where("(name not like '$%' or name = '$root') and ltrim(value) like '{%'")
        level = cut(inner.select("doc_id", F.concat_ws(".", F.nullif("up", F.lit("")), "name").alias("path"), "type", "value", F.from_json("value", "map<string, string>").alias("own")))
    return found


def token_counts(tokens: DataFrame) -> DataFrame:
    """doc_id, n: tokens of each document."""
    return tokens.where("coalesce(type, '') <> 'invalid JSON'").groupBy("doc_id").agg(F.count("*").alias("n"))


def extended_groups(groups: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, path, name, value, state: the tokens (doc_id, path of the group, name, value) that each group (doc_id, path,
    extends: '{path}' or null) has, its own before those of the groups it extends. state: ok, or missing or cycle for a
    group whose chain ends in no group or in itself. Pointers are followed by doubling.
    """
    up = F.regexp_extract("extends", r"^\{([^{}]+)\}$", 1)
    step = groups.select("doc_id", "path", F.when(up != "", up).alias("to"))
    exists = groups.select("doc_id", F.col("path").alias("to"), F.lit(True).alias("there"))
    step = step.join(exists, ["doc_id", "to"], "left").select("doc_id", "path", "to", F.coalesce("there", F.lit(False)).alias("there"))
    reach = step.where("there").select("doc_id", "path", "to", F.lit(1).alias("far"))
    most = groups.groupBy("doc_id").count().agg(F.max("count").alias("n")).first()["n"] or 0
    for _ in range(int(most).bit_length()):
        reach = cut(reach)
        further = reach.select("doc_id", F.col("path").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        longer = reach.join(further, ["doc_id", "to"]).select("doc_id", "path", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"))
        reach = reach.union(longer).groupBy("doc_id", "path", "to").agg(F.min("far").alias("far"))
    reach = cut(reach)
    looped = reach.where("path = to").select("doc_id", F.col("to").alias("end"), F.lit("cycle").alias("bad"))
    lost = step.where("to is not null and not there").select("doc_id", F.col("path").alias("end"), F.lit("missing").alias("bad"))
    ends = reach.select("doc_id", "path", F.col("to").alias("end")).union(groups.select("doc_id", "path", F.col("path").alias("end"))).distinct()
    state = ends.join(looped.union(lost).distinct(), ["doc_id", "end"]).groupBy("doc_id", "path").agg(F.min("bad").alias("bad"))
    all_ = groups.select("doc_id", "path", F.col("path").alias("to"), F.lit(0).alias("far")).union(reach.where("path <> to"))
    own = tokens.select("doc_id", F.col("path").alias("to"), "name", "value")
    held = all_.join(own, ["doc_id", "to"]).groupBy("doc_id", "path", "name").agg(F.min_by("value", F.struct("far", "to")).alias("value"))
    return held.join(state, ["doc_id", "path"], "left").select("doc_id", "path", "name", "value", F.coalesce("bad", F.lit("ok")).alias("state"))
