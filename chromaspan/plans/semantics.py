"""Queries on what elements say about colours, and their SQL. Elements come from lineitem: an order is a page of nested elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaspan.functions import text
from chromaspan.lineage import cut
from chromaspan.operators import elements as E

from .bridge import table
from .registry import query

CLASSES = ("btn Primary", "card", "nav-link", "site-footer", "hero title", "alert error", "plain", "cta", "badge chip", "bg-red-500", "secondary panel", "x")
NAMES = ("--color-brand", "--bs-color", "--tw-shadow-color", "--cc-bg", "--colors-red-500", "--color-error", "--my-text", "--radius", "--colors-white", "--brand-50")
VALUES = ("#12ab9f", "rgb(1, 2, 3)", "rgba(0, 0, 0, 0)", "hsl(10 20% 30%)", "var(--x-color)", "12px", "calc(1px + #fff000)", "lab(50 10 10)", "lighten(#fff, 2%)", "var(--a-color, #00ff00)", "#0000", "rgba(1,2,3,0.0)", "rgb(1 2 3 / 0)", "#abcdef00", "transparent", "")
SAID = ("net::ERR_ABORTED", "Timeout 30000ms exceeded", "connect ECONNREFUSED", "read econnreset", "getaddrinfo ENOTFOUND", "dns failed", "ERR_NAME_NOT_RESOLVED", "etimedout", "boom", "timed out")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def elements(spark: SparkSession, sf: str) -> DataFrame:
    k, u, n = F.col("l_partkey") % 97, F.col("l_suppkey") % 53, F.col("l_linenumber").cast("long")
    rgb = lambda a, b, c: (a.cast("string"), F.lit(", "), b.cast("string"), F.lit(", "), c.cast("string"))
    back, front = (k * 37 % 256, k * 59 % 256, k * 83 % 256), (u * 91 % 256, u * 17 % 256, u * 5 % 256)
    kind = (F.col("l_orderkey") + n) % 6
    bg = F.when(kind == 0, "rgba(0, 0, 0, 0)").when(kind == 1, F.concat(F.lit("rgb("), *rgb(*back), F.lit(")"))).when(kind == 2, F.concat(F.lit("rgba("), *rgb(*back), F.lit(", 0.5)"))).when(kind == 3, "transparent").when(kind == 4, "rgb(255, 255, 255)").otherwise(F.format_string("#%02X%02x%02x", *(c.cast("int") for c in back)))
    fg = F.when(n % 7 == 0, F.concat(F.lit("rgba("), *rgb(*front), F.lit(", 0.2)"))).otherwise(F.concat(F.lit("rgb("), *rgb(*front), F.lit(")")))
    border = F.when(k % 4 == 0, F.concat(F.lit("rgb("), *rgb(*front), F.lit(") none "), F.format_string("#%02x%02x%02x", *(c.cast("int") for c in back)))).otherwise("none")
    once = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")))
    return once.select(
        (F.col("l_suppkey") % 20).alias("site"), F.col("l_orderkey").alias("page_id"), n.alias("el_id"), F.when(n > 1, F.sequence(F.lit(1).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")).alias("ancestors"),
        F.when(n == 1, "BODY").otherwise(_pick(("A", "BUTTON", "DIV", "SPAN"), F.col("l_partkey") % 4)).alias("tag"), _pick(CLASSES, F.col("l_partkey") % 12).alias("class"),
        F.when(F.col("l_suppkey") % 9 == 0, "Logo-1").alias("id"), F.when(F.col("l_suppkey") % 7 == 0, "button").alias("role"), F.when(F.col("l_partkey") % 13 == 0, "none").otherwise("block").alias("display"),
        F.lit("visible").alias("visibility"), (F.col("l_suppkey") % 11 != 0).cast("double").alias("opacity"), F.col("l_quantity").cast("double").alias("width"), (F.col("l_partkey") % 17).cast("double").alias("height"), bg.alias("bg"), fg.alias("fg"), border.alias("border"))


_BEST = lambda t, most=5: "greatest(0, " + ", ".join(f"CASE WHEN contains({t}, '{k}') THEN {w} END" for k, w in E.CONTEXT_SCORES.items() if w <= most) + ")"
EL = f"""e0 AS (SELECT l_suppkey % 20 AS site, l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS el, CASE WHEN l_linenumber = 1 THEN 'BODY' ELSE ['A', 'BUTTON', 'DIV', 'SPAN'][l_partkey % 4 + 1] END AS tag,
 lower({_list(CLASSES)}[l_partkey % 12 + 1] || CASE WHEN l_suppkey % 9 = 0 THEN ' Logo-1' ELSE ' ' END) AS words, l_suppkey % 7 = 0 AS rb, l_partkey % 97 AS k, l_suppkey % 53 AS u, (l_orderkey + l_linenumber) % 6 AS kind,
 l_partkey % 13 <> 0 AND l_suppkey % 11 <> 0 AND l_quantity > 0 AND l_partkey % 17 > 0 AS visible FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
e1 AS (SELECT *, words || ' ' || lower(tag) AS ctx, k * 37 % 256 AS r, k * 59 % 256 AS g, k * 83 % 256 AS b, CASE kind WHEN 0 THEN 0.0::DOUBLE WHEN 3 THEN 0 WHEN 2 THEN 0.5 ELSE 1 END AS a, u * 91 % 256 AS fr, u * 17 % 256 AS fg, u * 5 % 256 AS fb, CASE WHEN el % 7 = 0 THEN 0.2::DOUBLE ELSE 1 END AS fa FROM e0),
e2 AS (SELECT * EXCLUDE (r, g, b), CASE WHEN kind = 4 THEN 255 WHEN a = 0 THEN 0 ELSE r END AS r, CASE WHEN kind = 4 THEN 255 WHEN a = 0 THEN 0 ELSE g END AS g, CASE WHEN kind = 4 THEN 255 WHEN a = 0 THEN 0 ELSE b END AS b, printf('#%02x%02x%02x', r, g, b) AS back FROM e1),
vis AS (SELECT *, printf('#%02x%02x%02x', r, g, b) AS bhex, printf('#%02x%02x%02x', fr, fg, fb) AS fhex FROM e2 WHERE visible),
lift AS (SELECT e.page_id, e.el, max({_BEST('x.words', 2)}) AS lift FROM vis e JOIN vis x ON x.page_id = e.page_id AND x.el BETWEEN e.el - 4 AND e.el - 1 GROUP BY ALL),
drop0 AS (SELECT e.page_id, e.el, arg_max(x.bhex, x.el) AS backdrop FROM vis e JOIN vis x ON x.page_id = e.page_id AND x.el <= e.el AND x.a >= 0.1 GROUP BY ALL),
own AS (SELECT vis.*, lift, backdrop, greatest(1, {_BEST('ctx')}, CASE WHEN tag = 'A' THEN 2 END, CASE WHEN tag = 'BUTTON' OR rb THEN 3 END) AS own,
 regexp_matches(ctx, '{E.STATUS}') AS is_status, regexp_matches(ctx, 'button|btn|cta') AND a >= 0.7 AND NOT (r = g AND g = b AND r IN (0, 239, 255) AND a = 1) AS is_cta FROM vis LEFT JOIN lift USING (page_id, el) LEFT JOIN drop0 USING (page_id, el)),
el AS (SELECT *, CASE WHEN is_cta THEN 25 WHEN own <= 2 THEN greatest(own, coalesce(lift, 0)) ELSE own END AS score FROM own)"""
PAINT = f"""{EL}, paint AS (SELECT site, bhex AS hex, score, is_status, true AS is_bg FROM el WHERE a >= 0.3
UNION ALL SELECT site, fhex, score, is_status, a > 0 AND kind <> 5 AND fhex = bhex AND a = 1 FROM el WHERE fa >= 0.3
UNION ALL SELECT site, fhex, score, is_status, a > 0 AND kind <> 5 AND fhex = bhex AND a = 1 FROM el WHERE k % 4 = 0
UNION ALL SELECT site, back, score, is_status, kind = 5 AND NOT regexp_matches(substr(back, 2, 2), '[a-f]') FROM el WHERE k % 4 = 0),
stat AS (SELECT site, hex, count(*) AS n, count(*) FILTER (is_bg) AS bg, CAST(sum(score) AS BIGINT) AS score, count(*) FILTER (is_status) AS status FROM paint GROUP BY ALL)"""


def _scored(spark, sf):
    return E.scored(E.with_ancestors(E.visible(elements(spark, sf))))


@query(f"WITH {EL} SELECT page_id, el AS el_id, score, is_status, is_cta, backdrop FROM el")
def element_scores(spark, sf):
    from chromaspan.functions import color

    p = E.parsed(F.col("backdrop"))
    out = _scored(spark, sf).withColumn("rgba", p)
    return out.select("page_id", "el_id", "score", "is_status", "is_cta", F.when(F.col("rgba").isNotNull(), color.to_hex(F.col("rgba.r"), F.col("rgba.g"), F.col("rgba.b"))).alias("backdrop"))


def _looks(spark, sf):
    """What elements paint and what it counts, as a table."""
    return cut(_scored(spark, sf).select("site", "bg", "fg", "border", "score", "is_status", "is_cta"))


@query(f"WITH {PAINT} SELECT * FROM stat")
def painted_color_statistics(spark, sf):
    return E.color_statistics(E.painted(_looks(spark, sf)), "site")


@query(f"""WITH {PAINT}, cta AS (SELECT site, bhex AS hex, count(*) AS n FROM el WHERE is_cta GROUP BY ALL HAVING count(*) >= 2)
SELECT site, hex, cta.n AS n FROM cta JOIN stat USING (site, hex) QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, hex) = 1""")
def cta_primary_colors(spark, sf):
    rows = _looks(spark, sf)
    return E.cta_primary(rows, E.painted(rows), "site")


@query(f"""WITH {EL}, c AS (SELECT *, CASE WHEN a > 0 THEN bhex ELSE fhex END AS chex, CASE WHEN a > 0 THEN a ELSE fa END AS ca, CASE WHEN a > 0 THEN (greatest(r, g, b) + least(r, g, b)) / 510.0::DOUBLE ELSE (greatest(fr, fg, fb) + least(fr, fg, fb)) / 510.0::DOUBLE END AS light FROM el),
v AS (SELECT page_id, arg_max(chex, el) FILTER (contains(ctx, 'primary') AND ca >= 0.7 AND light <= 0.95) AS primary_, arg_max(bhex, el) FILTER (contains(ctx, 'secondary') AND a >= 0.1) AS secondary_, coalesce(arg_max(bhex, el) FILTER (tag = 'BODY' AND a >= 0.9), '#ffffff') AS background_, arg_max(fhex, el) FILTER (tag = 'BODY' AND fa >= 0.5) AS text_ FROM c GROUP BY page_id)
SELECT page_id, role, value FROM (SELECT page_id, 'primary' AS role, primary_ AS value FROM v UNION ALL SELECT page_id, 'secondary', secondary_ FROM v UNION ALL SELECT page_id, 'background', background_ FROM v UNION ALL SELECT page_id, 'text', text_ FROM v) WHERE value IS NOT NULL""")
def page_semantic_roles(spark, sf):
    return E.page_roles(_scored(spark, sf))


VARS = f"v AS (SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS ord, {_list(NAMES)}[l_partkey % 10 + 1] AS name, {_list(VALUES)}[l_suppkey % 16 + 1] AS value, CASE WHEN l_orderkey % 3 = 0 THEN 'cookies.example.com' ELSE 'a.example.com' END AS host FROM lineitem)"


def variables(spark, sf):
    """page_id, ord, name, value, host: declared custom properties."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("ord"), _pick(NAMES, F.col("l_partkey") % 10).alias("name"), _pick(VALUES, F.col("l_suppkey") % 16).alias("value"), F.when(F.col("l_orderkey") % 3 == 0, "cookies.example.com").otherwise("a.example.com").alias("host"))


@query(f"""WITH {VARS} SELECT page_id, ord, name, value FROM v WHERE (name IN ('--color-brand', '--my-text', '--brand-50') OR (name = '--cc-bg' AND contains(host, 'cookie')))
AND value IN ('#12ab9f', 'rgb(1, 2, 3)', 'hsl(10 20% 30%)', 'lab(50 10 10)', 'var(--a-color, #00ff00)', '#0000', 'rgba(1,2,3,0.0)', 'rgb(1 2 3 / 0)', '#abcdef00')""")
def brand_variables(spark, sf):
    return variables(spark, sf).where(E.brand_property(F.col("name"), F.col("host")) & E.color_value(F.col("value"))).drop("host")


@query(f"""WITH {VARS} SELECT value, count(*) AS n FROM v WHERE value IN ('', 'transparent', 'rgba(0, 0, 0, 0)', '#0000', 'rgba(1,2,3,0.0)', 'rgb(1 2 3 / 0)', '#abcdef00') GROUP BY value""")
def transparent_values(spark, sf):
    return variables(spark, sf).where(E.transparent(F.col("value"))).groupBy("value").agg(F.count("*").alias("n"))


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), c AS (SELECT s % 20 AS site, {_list(CLASSES)}[p % 12 + 1] AS c, CASE WHEN s % 7 = 0 THEN 'button' END AS role, CASE WHEN l_linenumber = 1 THEN 'body' ELSE ['a', 'button', 'div', 'span'][p % 4 + 1] END AS tag FROM o)
SELECT site, coalesce(role, CASE WHEN contains(c, 'btn') THEN 'button' WHEN contains(c, 'card') THEN 'card' WHEN contains(c, 'badge') THEN 'badge' ELSE tag END) AS corner, coalesce(role, CASE WHEN contains(c, 'btn') THEN 'button' WHEN contains(c, 'card') THEN 'card' ELSE tag END) AS border, count(*) AS n FROM c GROUP BY ALL""")
def element_contexts(spark, sf):
    """How many elements of a site are what, for their corners and for their borders."""
    own = lambda *kinds: text.element_context(F.col("tag"), F.col("class"), F.col("role"), *kinds)
    return elements(spark, sf).groupBy("site", own().alias("corner"), own(text.BORDER_CONTEXTS).alias("border")).agg(F.count("*").alias("n"))
