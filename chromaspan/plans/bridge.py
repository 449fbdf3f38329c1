"""Observations derived from the driver's tables, in Spark and in DuckDB's SQL by the same arithmetic.

lineitem gives element observations: the supplier is the site, the order the page, the line the element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaspan.functions import color


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, page_id, ord, tag, px, radius, hex, is_bg, is_token, score, width, capture: a row per element."""
    c = F.col("l_partkey") % 97
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("site"),
        F.col("l_orderkey").alias("page_id"),
        F.col("l_linenumber").cast("long").alias("ord"),
        F.element_at(F.array(*map(F.lit, ("H1", "P", "A", "BUTTON", "DIV"))), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("tag"),
        F.col("l_quantity").cast("long").alias("px"),
        (F.col("l_linenumber") * 2).cast("long").alias("radius"),
        color.to_hex(c * 37 % 256, c * 59 % 256, c * 83 % 256).alias("hex"),
        (F.col("l_linestatus") == "O").alias("is_bg"),
        (c % 11 == 0).alias("is_token"),
        F.col("l_linenumber").cast("long").alias("score"),
        (F.col("l_partkey") % 3 + 1).alias("width"),
        F.date_format(F.col("l_shipdate"), "yyyy-MM").alias("capture"),
    )


OBS = """obs AS (SELECT l_suppkey % 20 AS site, l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS ord,
  ['H1', 'P', 'A', 'BUTTON', 'DIV'][l_linenumber % 5 + 1] AS tag, CAST(l_quantity AS BIGINT) AS px, CAST(l_linenumber * 2 AS BIGINT) AS radius,
  printf('#%02x%02x%02x', (l_partkey % 97) * 37 % 256, (l_partkey % 97) * 59 % 256, (l_partkey % 97) * 83 % 256) AS hex,
  l_linestatus = 'O' AS is_bg, (l_partkey % 97) % 11 = 0 AS is_token, CAST(l_linenumber AS BIGINT) AS score, l_partkey % 3 + 1 AS width,
  strftime(l_shipdate, '%Y-%m') AS capture FROM lineitem)"""


def type_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, ord, family, size, weight, tag: a row per text element."""
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("site"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("family"), F.col("p_size").cast("long").alias("size"), ((F.col("p_partkey") % 9 + 1) * 100).alias("weight"), F.element_at(F.array(*map(F.lit, ("H1", "H2", "P", "A", "LABEL"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("tag"))


TYPE = """typ AS (SELECT p_partkey % 10 AS site, p_partkey AS ord, p_brand AS family, CAST(p_size AS BIGINT) AS size,
  (p_partkey % 9 + 1) * 100 AS weight, ['H1', 'H2', 'P', 'A', 'LABEL'][p_partkey % 5 + 1] AS tag FROM part)"""
CONTEXT = """CASE WHEN tag = 'A' THEN 'link' WHEN tag = 'H1' AND size >= 56 THEN 'display' WHEN tag LIKE 'H_' THEN 'heading-' || substr(tag, 2, 1)
  WHEN size >= 56 THEN 'display' WHEN size <= 12 THEN 'caption' WHEN size > 24 THEN 'text' WHEN tag = 'LABEL' THEN 'ui' ELSE 'body' END"""
