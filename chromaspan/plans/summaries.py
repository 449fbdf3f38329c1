"""Queries of reports, merges and snapshots, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaspan.functions import text
from chromaspan.operators import extract, merge, summary
from chromaspan.sources import pages as page_ops

from .bridge import CONTEXT, OBS, TYPE, observations, table, type_observations
from .registry import query

STYLES = f"{TYPE}, styles AS (SELECT site, {CONTEXT} AS context, family, size, weight, count(*) AS n, min(ord) AS first FROM typ GROUP BY ALL)"


def _styles(spark, sf) -> DataFrame:
    return extract.type_styles(type_observations(spark, sf))


@query(f"WITH {STYLES} SELECT site, family, array_to_string(list_sort(list_distinct(list(weight))), ',') AS weights, count(size) AS sizes FROM styles GROUP BY ALL")
def gathered_fonts(spark, sf):
    return summary.gathered_fonts(_styles(spark, sf))


@query(f"""WITH {STYLES}, z AS (SELECT site, family, size, arg_min(context, first) AS context FROM styles GROUP BY ALL), w AS (SELECT site, family, array_to_string(list_sort(list_distinct(list(weight) FILTER (weight <> 400))), ', ') AS weights FROM styles GROUP BY ALL)
SELECT site, family, string_agg(size || 'px (' || context || ')', ', ' ORDER BY size DESC) AS sizes, coalesce(any_value(weights), '') AS weights FROM z JOIN w USING (site, family) GROUP BY ALL""")
def family_summary(spark, sf):
    return summary.family_summary(_styles(spark, sf))


@query(f"""WITH {STYLES} SELECT site, context, weight, CASE WHEN context LIKE 'display%' THEN 'Display' WHEN context LIKE 'heading%' THEN 'Headings' WHEN context IN ('body', 'text') THEN 'Body' WHEN context = 'link' THEN 'Links' WHEN context = 'ui' THEN 'UI' ELSE 'Caption' END AS grp,
CASE WHEN weight <= 300 THEN 'light' WHEN weight <= 400 THEN 'regular' WHEN weight <= 500 THEN 'medium' WHEN weight <= 600 THEN 'semi-bold' WHEN weight <= 700 THEN 'bold' ELSE 'extra-bold' END AS weight_name,
CASE WHEN context LIKE 'heading-_' THEN 'Heading ' || substr(context, 9) WHEN context = 'ui' THEN 'Ui' ELSE upper(substr(context, 1, 1)) || substr(context, 2) END AS title, count(*) AS n FROM styles GROUP BY ALL""")
def type_groups(spark, sf):
    s = _styles(spark, sf)
    return s.groupBy("site", "context", "weight", text.type_group(F.col("context")).alias("grp"), text.weight_name(F.col("weight")).alias("weight_name"), text.title_case(F.col("context")).alias("title")).agg(F.count("*").alias("n"))


RGB = "CAST('0x' || substr(hex, 2, 2) AS INT) / 255.0::DOUBLE AS r, CAST('0x' || substr(hex, 4, 2) AS INT) / 255.0::DOUBLE AS g, CAST('0x' || substr(hex, 6, 2) AS INT) / 255.0::DOUBLE AS b"
HUE = f"""{OBS}, hx AS (SELECT DISTINCT hex, {RGB} FROM obs), hs AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d, (greatest(r, g, b) + least(r, g, b)) / 2 AS l FROM hx),
ht AS (SELECT *, hi = 0 OR d / hi < 0.10::DOUBLE AS grey, CASE WHEN hi = 0 OR d / hi < 0.10::DOUBLE THEN NULL WHEN hi = r THEN CASE WHEN g < b THEN (g - b) / d + 6 ELSE (g - b) / d END WHEN hi = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60 AS h FROM hs)"""


@query(f"""WITH {HUE} SELECT hex, CASE WHEN grey THEN CASE WHEN l > 0.92 THEN 'White' WHEN l > 0.6 THEN 'Light Gray' WHEN l > 0.32 THEN 'Gray' WHEN l > 0.1 THEN 'Dark Gray' ELSE 'Black' END
WHEN h < 15 OR h >= 345 THEN 'Red' WHEN h < 45 THEN 'Orange' WHEN h < 70 THEN 'Yellow' WHEN h < 160 THEN 'Green' WHEN h < 200 THEN 'Teal' WHEN h < 255 THEN 'Blue' WHEN h < 290 THEN 'Purple' ELSE 'Pink' END AS name FROM ht""")
def hue_names(spark, sf):
    return observations(spark, sf).select("hex").distinct().withColumn("name", summary.hue_name(F.col("hex")))


@query(f"""WITH {HUE}, u AS (SELECT DISTINCT site, hex FROM obs) SELECT site, hex, row_number() OVER (PARTITION BY site ORDER BY d = 0 OR d < 0.1::DOUBLE * hi, floor(CASE WHEN d = 0 OR d < 0.1::DOUBLE * hi THEN l ELSE h END * 1000 + 0.5), hex) AS rank FROM u JOIN ht USING (hex)""")
def hue_sorted_colors(spark, sf):
    once = observations(spark, sf).select("site", "hex").distinct()
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(summary.hue_order(F.col("hex")))).cast("long"))


SOURCES = f"""{OBS}, hn AS (SELECT site, hex, count(*) AS n, bool_or(is_token) AS tok, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, hex) AS ord FROM obs GROUP BY site, hex),
src AS (SELECT site, 'semantic' AS source, 1 AS rank, ord, CASE WHEN ord = 1 THEN 'primary' ELSE 'secondary' END AS label, hex, 'high' AS confidence FROM hn WHERE ord <= 2
UNION ALL SELECT site, 'palette', 2, ord, '', hex, CASE WHEN n > 40 THEN 'high' WHEN n > 20 THEN 'medium' ELSE 'low' END FROM hn WHERE ord % 2 = 1 UNION ALL SELECT site, 'css-var', 3, ord, '--c' || ord, hex, 'high' FROM hn WHERE tok)"""


def _sources(spark, sf) -> DataFrame:
    used = observations(spark, sf).groupBy("site", "hex").agg(F.count("*").alias("n"), F.max("is_token").alias("tok"))
    used = used.withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "hex")).cast("long"))
    each = lambda source, rank, label, confidence: F.struct(F.lit(source).alias("source"), F.lit(rank).alias("rank"), label.alias("label"), confidence.alias("confidence"))
    high = F.lit("high")
    found = F.array_compact(F.array(
        F.when(F.col("ord") <= 2, each("semantic", 1, F.when(F.col("ord") == 1, "primary").otherwise("secondary"), high)),
        F.when(F.col("ord") % 2 == 1, each("palette", 2, F.lit(""), F.when(F.col("n") > 40, "high").when(F.col("n") > 20, "medium").otherwise("low"))),
        F.when(F.col("tok"), each("css-var", 3, F.concat(F.lit("--c"), F.col("ord").cast("string")), high)),
    ))
    return used.select("site", "hex", "ord", F.explode(found).alias("x")).select("site", "hex", "ord", "x.*")


@query(f"WITH {SOURCES}, f AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY site, hex ORDER BY rank, ord) = 1) SELECT site, hex, label, confidence, source, row_number() OVER (PARTITION BY site ORDER BY rank, ord, hex) AS at FROM f")
def gathered_colors(spark, sf):
    return summary.gathered_colors(_sources(spark, sf))


@query(f"""WITH {SOURCES} SELECT site, hex, coalesce(string_agg(label, ', ' ORDER BY rank, ord) FILTER (label <> ''), '') AS labels, arg_min(source, rank) AS source, arg_max(confidence, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS confidence FROM src GROUP BY site, hex""")
def color_labels(spark, sf):
    return summary.color_labels(_sources(spark, sf))


@query(f"WITH {OBS}, r AS (SELECT site, radius, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) > 3) SELECT site, row_number() OVER (PARTITION BY site ORDER BY n DESC, radius) AS rank, radius::VARCHAR AS value FROM r QUALIFY rank <= 12")
def radius_section(spark, sf):
    return summary.section_view(extract.radius_histogram(observations(spark, sf)), "radius", 12)


@query(f"""WITH {OBS}, s AS (SELECT site, '0px ' || width || 'px ' || radius || 'px ' || hex AS shadow, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) > 2)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY n <= 5, n DESC, shadow) AS rank, shadow AS value FROM s QUALIFY rank <= 8""")
def shadow_section(spark, sf):
    return summary.section_view(extract.shadow_histogram(observations(spark, sf)), "shadow", 8, by_confidence=True)


@query("""SELECT o_custkey % 50 AS run, count(*) AS sites, count(*) FILTER (o_orderkey % 7 = 0 OR (o_orderkey % 5 = 0 AND o_custkey % 3 = 0 AND o_orderkey % 2 = 0)) AS failed,
count(*) FILTER (o_orderkey % 7 = 0 OR (o_orderkey % 5 = 0 AND o_custkey % 3 = 0 AND o_orderkey % 2 = 0)) / count(*) <= 0.25 AS ok FROM orders GROUP BY ALL""")
def liveness_runs(spark, sf):
    o = table(spark, sf, "orders")
    return summary.liveness(o.select((F.col("o_custkey") % 50).alias("run"), F.col("o_orderkey").alias("site"), (F.col("o_orderkey") % 7 == 0).cast("int").alias("code"), (F.col("o_orderkey") % 5).alias("colors"), (F.col("o_custkey") % 3).alias("styles"), (F.col("o_orderkey") % 2).alias("degraded")))


COHORT = f"""{OBS}, v AS (SELECT DISTINCT site, 'color' AS category, hex || '-' || px % 5 AS value FROM obs UNION SELECT DISTINCT site, 'spacing', (px * 7 + site)::VARCHAR FROM obs),
z AS (SELECT site, category, count(*) AS n FROM v GROUP BY ALL)"""


@query(f"""WITH {COHORT}, p AS (SELECT a.site AS one, b.site AS two, a.category, count(*) AS common FROM v a JOIN v b ON a.category = b.category AND a.value = b.value AND a.site < b.site GROUP BY ALL)
SELECT one, two, p.category, common, x.n + y.n - common AS either FROM p JOIN z x ON x.site = one AND x.category = p.category JOIN z y ON y.site = two AND y.category = p.category""")
def cohort_shared_tokens(spark, sf):
    obs = observations(spark, sf)
    colors = obs.select("site", F.lit("color").alias("category"), F.concat_ws("-", "hex", (F.col("px") % 5).cast("string")).alias("value"))
    spaces = obs.select("site", F.lit("spacing").alias("category"), (F.col("px") * 7 + F.col("site")).cast("string").alias("value"))
    return summary.cohort(colors.union(spaces))


@query(f"""WITH {OBS}, c AS (SELECT DISTINCT site, site || '@' || capture AS snapshot_id, capture FROM obs), b AS (SELECT site, min(snapshot_id) AS base_id, site % 3 <> 0 AS local FROM c GROUP BY site), a AS (SELECT site, max(snapshot_id) AS snapshot_id FROM c WHERE site % 2 = 0 GROUP BY site)
SELECT b.site, CASE WHEN local THEN coalesce(snapshot_id, base_id) ELSE base_id END AS base_id, local FROM b LEFT JOIN a USING (site)""")
def approved_baselines(spark, sf):
    c = observations(spark, sf).select("site", F.concat_ws("@", "site", "capture").alias("snapshot_id")).distinct()
    base = c.groupBy("site").agg(F.min("snapshot_id").alias("base_id")).withColumn("local", F.col("site") % 3 != 0)
    return summary.approved_baselines(base, c.where("site % 2 = 0"))


@query("""SELECT s_suppkey AS host, CASE WHEN s_suppkey % 3 > 0 THEN '#' || lpad((s_suppkey % 1000)::VARCHAR, 6, '0') END AS theme_color, NULL::VARCHAR AS background_color, CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 THEN left(s_name, 8) END AS short_name FROM supplier""")
def manifest_fields(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    body = F.to_json(F.struct(F.when(k % 3 > 0, F.concat(F.lit("#"), F.lpad((k % 1000).cast("string"), 6, "0"))).otherwise("").alias("theme_color"), F.col("s_name").alias("name"), F.when(k % 5 > 0, F.left("s_name", F.lit(8))).alias("short_name"), F.array(F.lit(1)).alias("icons")))
    broken = F.when(k % 7 == 0, F.concat(F.lit('{"theme_color":"'), F.when(k % 3 > 0, F.concat(F.lit("#"), F.lpad((k % 1000).cast("string"), 6, "0"))).otherwise(""), F.lit('","name":"","short_name":""}'))).otherwise(body)
    return page_ops.manifest_fields(s.select(k.alias("host"), broken.alias("body")))


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN '--dark-mode' END, CASE WHEN o_orderkey % 3 = 0 THEN '--mobile' END, CASE WHEN o_custkey % 4 > 0 THEN '--crawl ' || o_custkey % 4 END, CASE WHEN o_orderkey % 5 = 0 THEN '--no-sandbox' END, CASE WHEN o_custkey % 2 = 0 THEN '/a' END, CASE WHEN o_custkey % 4 > 1 THEN '(' || o_custkey % 4 || ' pages merged)' END], lambda x: x IS NOT NULL), ' ') AS said FROM orders""")
def run_summaries(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    flags = {"dark-mode": ("flag", k % 2 == 0), "mobile": ("flag", k % 3 == 0), "crawl": ("value", F.when(c > 0, c.cast("string"))), "no-sandbox": ("flag", k % 5 == 0)}
    said = text.run_summary(flags, F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("/a"))), c)
    return table(spark, sf, "orders").select(k.alias("id"), F.array_join(said, " ").alias("said"))


LENGTHS = ("16px", "1.50rem", "0", "12", "2em (x)", "50%", "normal", "-0.5px", "96px (6.00rem)", "bold")
PADS = ("4px 8px", "4px auto", "0 1.0rem 2px 3em", "8px")


@query(f"""WITH v AS (SELECT DISTINCT l_partkey % 10 AS k, l_suppkey % 4 AS p FROM lineitem) SELECT k, p, ['16px', '1.5rem', '0px', '12px', '2em', NULL, NULL, '-0.5px', '96px', NULL][k + 1] AS length, ['16px', '1.5rem', '0', '12', '2em', NULL, NULL, '-0.5px', '96px', NULL][k + 1] AS line_height,
['16px', '1.5rem', NULL, '12px', '2em', NULL, NULL, '-0.5px', '96px', NULL][k + 1] AS tracking, ['16px', '1.5rem', '0px', '12px', '2em', '9999px', NULL, '-0.5px', '96px', NULL][k + 1] AS radius, [NULL, NULL, NULL, NULL, NULL, NULL, '400', NULL, NULL, '700'][k + 1] AS weight, ['4px 8px', NULL, '0px 1rem 2px 3em', '8px'][p + 1] AS padding FROM v""")
def normalized_values(spark, sf):
    from .semantics import _pick

    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 10).alias("k"), (F.col("l_suppkey") % 4).alias("p")).distinct()
    v, pad = _pick(LENGTHS, F.col("k")), _pick(PADS, F.col("p"))
    return rows.select("k", "p", text.length_value(v).alias("length"), text.line_height_value(v).alias("line_height"), text.tracking_value(v).alias("tracking"), text.radius_value(v).alias("radius"), text.weight_value(v).alias("weight"), text.padding_value(pad).alias("padding"))


@query("""SELECT page_id, '2.3.0' AS schema_version, CASE WHEN page_id % 2 = 0 THEN '0.22.0' END AS tool_version, '2025.10' AS spec_version, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www[.]', '') AS domain, 'at ' || page_id AS extracted_at FROM pages""")
def capture_provenance(spark, sf):
    p = text.provenance("2.3.0", "2025.10", F.when(F.col("page_id") % 2 == 0, "0.22.0"), F.col("url"), F.concat(F.lit("at "), F.col("page_id").cast("string")))
    return table(spark, sf, "pages").select("page_id", p.alias("p")).select("page_id", "p.*")


FONTS = f"{OBS}, pf AS (SELECT DISTINCT site, page_id AS page_ord, ord, CASE ord % 3 WHEN 0 THEN 'urls' WHEN 1 THEN 'googleFonts' ELSE 'selfHosted' END AS kind, 'font ' || px % 12 AS name FROM obs)"


@query(f"""WITH {FONTS}, f AS (SELECT site, kind, name, min(struct_pack(a := page_ord, b := ord)) AS first FROM pf GROUP BY ALL)
SELECT site, kind, CASE WHEN kind = 'urls' THEN string_agg(name, ',' ORDER BY name) ELSE string_agg(name, ',' ORDER BY first, name) END AS names FROM f GROUP BY site, kind""")
def merged_font_sources(spark, sf):
    o = observations(spark, sf)
    rows = o.select("site", F.col("page_id").alias("page_ord"), "ord", F.when(F.col("ord") % 3 == 0, "urls").when(F.col("ord") % 3 == 1, "googleFonts").otherwise("selfHosted").alias("kind"), F.concat(F.lit("font "), (F.col("px") % 12).cast("string")).alias("name"))
    return merge.font_sources(rows).withColumn("names", F.array_join("names", ","))


@query(f"WITH {OBS} SELECT site, 'set ' || px % 7 AS name, arg_min(page_id, struct_pack(a := page_id, b := ord)) AS evidence FROM obs GROUP BY ALL")
def merged_by_name(spark, sf):
    rows = observations(spark, sf).select("site", F.col("page_id").alias("page_ord"), "ord", F.concat(F.lit("set "), (F.col("px") % 7).cast("string")).alias("name"), F.col("page_id").alias("evidence"))
    return merge.by_name(rows, "evidence")
