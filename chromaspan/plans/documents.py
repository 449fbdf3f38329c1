"""Queries on token documents and snapshots, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaspan.operators import documents as D
from chromaspan.operators import nodes, validation
from chromaspan.sources import snapshots

from .bridge import OBS, observations, table
from .registry import query

DOCS = f"""{OBS}, dv AS (SELECT site, px, hex, count(*) AS n, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, px, hex) AS k FROM obs GROUP BY site, px, hex QUALIFY k <= 40),
flat AS (SELECT site AS doc_id, 'brand.c' || k AS path, 'color' AS type, hex AS value FROM dv WHERE k % 3 = 0 UNION ALL SELECT site, 'space.s' || k, 'dimension', px || 'px' FROM dv WHERE k % 3 = 1 UNION ALL SELECT site, 'brand.deep.er.d' || k, CASE WHEN k % 2 = 0 THEN 'number' ELSE 'color' END, CASE WHEN k % 2 = 0 THEN px::VARCHAR ELSE '{{brand.c3}}' END FROM dv WHERE k % 3 = 2
UNION ALL SELECT -1, '', 'invalid JSON', '{{"a": '),
"""


def token_documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, json: a nested document for each site, and one that cannot be read."""
    from pyspark.sql import Window

    used = observations(spark, sf).groupBy("site", "px", "hex").agg(F.count("*").alias("n"))
    used = used.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "px", "hex"))).where("k <= 40")
    name = lambda c: F.concat(F.lit(c), F.col("k").cast("string"))
    entry = lambda k, c, *body: F.when(F.col("k") % 3 == k, F.struct(name(c).alias("key"), F.struct(*body).alias("value")))
    group = lambda col: F.map_from_entries(F.collect_list(col))
    deep_type = F.when(F.col("k") % 2 == 0, "number").alias("$type")
    out = used.groupBy("site").agg(
        group(entry(0, "c", F.col("hex").alias("$value"))).alias("c"), group(entry(1, "s", F.concat(F.col("px").cast("string"), F.lit("px")).alias("$value"), F.lit("x").alias("$description"))).alias("s"),
        group(entry(2, "d", deep_type, F.when(F.col("k") % 2 == 0, F.col("px").cast("string")).otherwise("{brand.c3}").alias("$value"))).alias("d"))
    inner = F.concat(F.lit('{"$type":"color","$extensions":{"x":{"$value":1}},"deep":{"er":'), F.to_json("d"), F.lit("},"), F.expr("substring(to_json(c), 2)"))
    whole = F.concat(F.lit('{"$schema":"s","brand":'), inner, F.lit(',"space":{"$type":"dimension",'), F.expr("substring(to_json(s), 2)"), F.lit("}"))
    docs = out.select(F.col("site").alias("doc_id"), whole.alias("json"))
    return docs.union(docs.limit(1).select(F.lit(-1).cast("long"), F.lit('{"a": ')))


@query(f"WITH {DOCS.rstrip().rstrip(',')} SELECT * FROM flat")
def flattened_documents(spark, sf):
    return D.flatten(token_documents(spark, sf))


@query(f"WITH {DOCS.rstrip().rstrip(',')} SELECT doc_id, count(*) AS n FROM flat WHERE type <> 'invalid JSON' GROUP BY doc_id")
def document_token_counts(spark, sf):
    return D.token_counts(D.flatten(token_documents(spark, sf)))


#: A document a supplier: tokens g.t<px> whose type and value follow from px, right and wrong ones.
RULES = """d AS (SELECT DISTINCT l_suppkey AS doc_id, CAST(l_quantity AS BIGINT) AS px FROM lineitem), has AS (SELECT d.*, EXISTS (SELECT 1 FROM d e WHERE e.doc_id = d.doc_id AND e.px = d.px - 3) AS three, EXISTS (SELECT 1 FROM d e WHERE e.doc_id = d.doc_id AND e.px = d.px - 5) AS five FROM d),
bad AS (SELECT doc_id, '.components[0]' AS below, px, 'component range' AS rule FROM d WHERE px % 6 = 0 AND px > 40 UNION ALL SELECT doc_id, '.unit', px, 'length' FROM d WHERE px % 6 = 1 AND px % 5 = 0 UNION ALL SELECT doc_id, '', px, 'bare dimension' FROM d WHERE px % 6 = 2 AND px % 4 = 2
UNION ALL SELECT doc_id, '', px, 'missing reference' FROM has WHERE px % 6 = 3 AND NOT three UNION ALL SELECT doc_id, '[0]', px, 'cubicBezier range' FROM d WHERE px % 6 = 4 AND px > 40 UNION ALL SELECT doc_id, '', px, 'missing spread' FROM d WHERE px % 6 = 5 AND px % 4 = 1
UNION ALL SELECT doc_id, '.color', px, 'missing pointer' FROM has WHERE px % 6 = 5 AND NOT five UNION ALL SELECT doc_id, '.color.components[0]', px, 'component range' FROM has WHERE px % 6 = 5 AND five AND px > 45
UNION ALL SELECT doc_id, '.components[0]', px, 'component range' FROM has WHERE px % 6 = 3 AND three AND px > 43),
broken AS (SELECT doc_id, 'g.t' || px || below AS path, rule, 'error' AS severity FROM bad)"""


def ruled_documents(spark, sf) -> DataFrame:
    k = F.col("px")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    length = '{"value":1,"unit":"px"}'
    bodies = [
        said('{"$type":"color","$value":{"colorSpace":"srgb","components":[', k / 40.0, ',0.5,"none"]}}'),
        said('{"$type":"dimension","$value":{"value":', k, ',"unit":"', F.when(k % 5 == 0, "em").otherwise("rem"), '"}}'),
        F.when(k % 4 == 2, said('{"$type":"dimension","$value":"', k, 'px"}')).otherwise(said('{"$type":"dimension","$value":{"value":', k, ',"unit":"px"}}')),
        said('{"$value":"{g.t', k - 3, '}"}'), said('{"$type":"cubicBezier","$value":[', k / 40.0, ",0,0,1]}"),
        said('{"$type":"shadow","$value":{"color":{"$ref":"#/g/t', k - 5, f'/$value"}},"offsetX":{length},"offsetY":{length},"blur":{length}', F.when(k % 4 == 1, "").otherwise(f',"spread":{length}'), "}}"),
    ]
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").cast("long").alias("px")).distinct()
    return nodes.assemble(rows.select("doc_id", F.array(F.lit("g"), said("t", k)).alias("path"), k.alias("ord"), F.element_at(F.array(*bodies), (k % 6 + 1).cast("int")).alias("json")))


@query(f"WITH {RULES} SELECT * FROM broken")
def token_violations(spark, sf):
    return validation.violations(ruled_documents(spark, sf))


@query(f"WITH {RULES} SELECT * FROM broken WHERE rule IN ('missing spread', 'cubicBezier range', 'component range')")
def structured_violations(spark, sf):
    return validation.violations(ruled_documents(spark, sf)).where(F.col("rule").isin("missing spread", "cubicBezier range", "component range"))


@query(f"""WITH {RULES} SELECT doc_id, CASE WHEN rule IN ('missing pointer', 'missing reference') THEN 'reference' ELSE 'value' END AS category, count(*) AS n,
coalesce(list_sort(list(DISTINCT CASE rule WHEN 'component range' THEN 'keep to the colour space''s range' WHEN 'length' THEN 'use px or rem' WHEN 'bare dimension' THEN 'give value and unit' WHEN 'missing reference' THEN 'name a token that exists' WHEN 'missing pointer' THEN 'point to a member that exists' END) FILTER (rule NOT IN ('missing spread', 'cubicBezier range'))), [])::VARCHAR AS advice
FROM broken GROUP BY 1, 2""")
def error_categories(spark, sf):
    found = validation.categories(validation.violations(ruled_documents(spark, sf)))
    return found.withColumn("advice", F.concat(F.lit("["), F.array_join(F.transform("advice", lambda a: F.when(a.contains("'"), F.concat(F.lit("'"), F.replace(a, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(a)), ", "), F.lit("]")))


#: A document a supplier whose token n<px> points to the one before it, but every 21st.
@query("""WITH d AS (SELECT DISTINCT l_suppkey AS doc_id, CAST(l_quantity AS BIGINT) AS px FROM lineitem), b AS (SELECT d.*, (SELECT max(m) FROM range(d.px - d.px % 21, d.px) r(m) WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.doc_id = d.doc_id AND e.px = m)) AS gap FROM d WHERE px % 21 <> 0)
SELECT doc_id, '/n' || px AS at, '/n' || coalesce(gap, px - px % 21) AS to_, CASE WHEN gap IS NOT NULL THEN 'missing pointer' END AS bad FROM b""")
def resolved_pointers(spark, sf):
    k = F.col("px")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").cast("long").alias("px")).distinct()
    body = F.when(k % 21 == 0, F.concat(F.lit('{"$type":"number","$value":'), k.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"$ref":"#/n'), (k - 1).cast("string"), F.lit('"}')))
    docs = nodes.assemble(rows.select("doc_id", F.array(F.concat(F.lit("n"), k.cast("string"))).alias("path"), k.alias("ord"), body.alias("json")))
    buckets = nodes.buckets_of(docs)
    return validation.pointers(nodes.nodes(docs, buckets), buckets).select("doc_id", "at", F.col("to").alias("to_"), "bad")


#: Each site's groups extend the group before them; the first of ten extends none, group 7 of every site extends itself over 8.
GROUPS = f"""{OBS}, gr AS (SELECT DISTINCT site AS doc_id, px % 20 AS k FROM obs), up AS (SELECT doc_id, k, CASE WHEN k % 10 = 7 THEN k + 1 WHEN k = 3 THEN 99 WHEN k % 10 = 0 THEN NULL ELSE k - 1 END AS up FROM gr),
tk AS (SELECT DISTINCT site AS doc_id, px % 20 AS k, 'n' || ord AS name, (px % 20) || '-' || ord AS value FROM obs WHERE ord <= 2 AND px % 20 % 3 <> 1)"""


@query(f"""WITH RECURSIVE {GROUPS}, chain AS (SELECT doc_id, k, k AS pos, 0 AS far FROM gr UNION ALL SELECT c.doc_id, c.k, u.up, far + 1 FROM chain c JOIN up u ON u.doc_id = c.doc_id AND u.k = c.pos AND u.up IS NOT NULL WHERE far < 25),
bad AS (SELECT doc_id, k, CASE WHEN max(far) = 25 THEN 'cycle' WHEN bool_or(NOT EXISTS (SELECT 1 FROM gr g WHERE g.doc_id = chain.doc_id AND g.k = chain.pos)) THEN 'missing' ELSE 'ok' END AS state FROM chain GROUP BY ALL),
fst AS (SELECT doc_id, k, pos, min(far) AS far FROM chain GROUP BY ALL)
SELECT f.doc_id, 'g' || f.k AS path, name, arg_min(value, far) AS value, any_value(state) AS state FROM fst f JOIN tk ON tk.doc_id = f.doc_id AND tk.k = f.pos JOIN bad b ON b.doc_id = f.doc_id AND b.k = f.k GROUP BY f.doc_id, f.k, name""")
def extended_groups(spark, sf):
    obs = observations(spark, sf)
    k = F.col("px") % 20
    named = lambda c: F.concat(F.lit("g"), c.cast("string"))
    groups = obs.select(F.col("site").alias("doc_id"), k.alias("k")).distinct()
    up = F.when(F.col("k") % 10 == 7, F.col("k") + 1).when(F.col("k") == 3, 99).when(F.col("k") % 10 != 0, F.col("k") - 1)
    groups = groups.select("doc_id", named(F.col("k")).alias("path"), F.concat(F.lit("{g"), up.cast("string"), F.lit("}")).alias("extends"))
    own = obs.where("ord <= 2 and px % 20 % 3 <> 1").select(F.col("site").alias("doc_id"), named(k).alias("path"), F.concat(F.lit("n"), F.col("ord").cast("string")).alias("name"), F.concat_ws("-", k.cast("string"), F.col("ord").cast("string")).alias("value")).distinct()
    return D.extended_groups(groups, own)


SNAP = """sn AS (SELECT o_orderkey AS k, o_custkey AS c, 's' || o_orderkey AS snapshot_id FROM orders)"""


def snapshot_documents(spark, sf) -> DataFrame:
    """doc_id, json: snapshots whose members come in their several shapes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    hexed = F.format_string("#%06x", (c % 4096).cast("int"))
    weight = F.when(k % 2 == 0, said('"', k % 9 * 100 + 100, '"')).otherwise((k % 9 * 100 + 100).cast("string"))
    px = F.when(k % 3 == 0, said('"', c % 40, 'px"')).otherwise((c % 40).cast("string"))
    primary = F.when(k % 2 == 0, said('"', hexed, '"')).otherwise(said('{"color":"', hexed, '"}'))
    inputs = F.when(k % 2 == 0, '[{"a":1}]').otherwise('{"text":[{"a":2}],"radio":[]}')
    display = F.when(k % 5 == 0, ',"display":"shown"').otherwise("")
    json = said(
        '{"url":"http://a.com","_crawl":{"x":1},"meta":{"snapshotId":"s', k, '"},"colors":{"semantic":{"primary":', primary, '},"palette":[{"color":"', hexed, '","count":', c % 7, ',"confidence":"high"}]},"typography":{"styles":[{"context":"body","family":"F","size":"',
        c % 20, 'px","weight":', weight, ',"count":2}],"sources":{"adobeFonts":', (k % 2 == 0), '}},"spacing":{"commonValues":[{"px":', px, display, ',"count":3}]},"components":{"inputs":', inputs, "}}")
    return table(spark, sf, "orders").select(k.alias("doc_id"), json.alias("json"))


@query(f"""WITH {SNAP} SELECT k AS doc_id, '#' || lpad(to_hex(c % 4096), 6, '0') AS primary_, k % 9 * 100 + 100 AS weight, c % 40 AS px, CASE WHEN k % 5 = 0 THEN 'shown' ELSE (c % 40) || 'px' END AS display, '[]' AS adobe_fonts, CASE WHEN k % 2 = 0 THEN '[{{"a":1}}]' ELSE '[{{"a":2}}]' END AS inputs FROM sn""".replace("to_hex(c % 4096)", "lower(printf('%x', c % 4096))"))
def normalized_snapshots(spark, sf):
    s = snapshots.normalized(snapshot_documents(spark, sf))
    return s.select("doc_id", F.col("semantic")["primary"].alias("primary_"), F.get("styles", 0)["weight"].cast("long").alias("weight"), F.get("spacing", 0)["px"].cast("long").alias("px"), F.get("spacing", 0)["display"].alias("display"), "adobe_fonts", "inputs")


@query(f"""WITH {SNAP}, h AS (SELECT *, '#' || lpad(lower(printf('%x', c % 4096)), 6, '0') AS hex FROM sn)
SELECT snapshot_id, 'semantic' AS category, 0::BIGINT AS ord, 'primary' AS key, hex AS value, NULL::DOUBLE AS num, 1::BIGINT AS count FROM h UNION ALL SELECT snapshot_id, 'color', 0, NULL, hex, NULL, c % 7 FROM h
UNION ALL SELECT snapshot_id, 'typography', 0, 'body', 'F/' || (k % 9 * 100 + 100) || '/' || c % 20 || 'px', c % 20, 2 FROM h UNION ALL SELECT snapshot_id, 'spacing', 0, NULL, CASE WHEN k % 5 = 0 THEN 'shown' ELSE (c % 40) || 'px' END, c % 40, 3 FROM h""")
def snapshot_tokens(spark, sf):
    return snapshots.tokens(snapshots.normalized(snapshot_documents(spark, sf))).drop("confidence")
