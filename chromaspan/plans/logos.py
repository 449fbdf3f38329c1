"""Queries on logos and what stands for a page, and their SQL. Marks come from lineitem: an order is a page, a line a picture in
its header, in a section or in a list inside that section."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaspan.operators import logos
from chromaspan.sources import hints

from .bridge import table
from .registry import query

SITES = ("acme", "globex", "initech", "")
ALTS = ("Acme logo", "Globex Widgets Logo", "logo-on-white.svg", "", "Initech", "A long text about the picture that nobody would write for a mark", "brand icon")
LINKS = ("/", "https://www.acme.com/", "/about", "/en-us", "https://globex.com", "")
FITS = ("contain", "scale-down", "cover", "fill")
TOKENS = ("0%", "100%", "left", "bottom", "12px", "150%", "-5%", "25%")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _list(values, index) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({index}) % {len(values)} + 1]"


def marks(spark, sf):
    once = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).cast("long").alias(c[2:]) for c in ("l_partkey", "l_suppkey", "l_quantity")))
    p, s, q, n = F.col("partkey"), F.col("suppkey"), F.col("quantity"), F.col("l_linenumber").cast("long")
    up = lambda k, tag: F.struct(F.lit(k).alias("id"), F.lit(tag).alias("tag"))
    place, site = s % 3, _pick(SITES, F.col("l_orderkey"))
    above = F.when(place == 0, F.array(up(0, "BODY"), up(1, "HEADER"))).when(place == 1, F.array(up(0, "BODY"), up(2, "SECTION"))).otherwise(F.array(up(0, "BODY"), up(2, "SECTION"), up(3, "UL")))
    return once.select(
        F.col("l_orderkey").alias("page_id"), n.alias("el_id"), F.when(p % 4 == 0, "svg").otherwise("img").alias("tag"), _pick(ALTS, p).alias("alt"), F.when(p % 5 == 0, "site-Logo").when(p % 5 == 1, "acme-x").otherwise("pic").alias("class"), F.when(s % 11 == 0, "logo1").alias("id"),
        F.concat(F.when(p % 6 == 0, "https://cdn.other.net/").when(p % 6 == 1, "https://img.acme.com/").otherwise("/i/"), _pick(SITES, p), F.lit(".png?v=acme")).alias("src"), F.when(p % 8 == 0, "Homepage").alias("aria"), _pick(LINKS, s).alias("link"), F.when(s % 13 == 0, "Go home").alias("link_aria"),
        F.when(place == 0, "header").when(q % 9 == 0, "footer").when(q % 9 == 1, "hero").alias("zone"), above.alias("ancestors"), (p % 900).cast("double").alias("x"), F.when(place == 0, q % 40).otherwise(q * 40).cast("double").alias("y"), (p % 211 + 3).cast("double").alias("width"), (s % 97 + 2).cast("double").alias("height"),
        F.when(p % 3 == 0, p % 1000).cast("double").alias("natural_width"), F.when(p % 3 == 0, s % 600).cast("double").alias("natural_height"), _pick(FITS, p + s).alias("fit"), _pick(TOKENS, p).alias("at_x"), _pick(TOKENS, s).alias("at_y"), F.lit(2000).alias("doc_height"), site.alias("site"), F.when(site == "", "https://plain.org").otherwise(F.concat(F.lit("https://www."), site, F.lit(".com"))).alias("origin"))


_SHARE = lambda c: f"CASE WHEN {c} IN ('0%', 'left', '-5%') THEN 0.0::DOUBLE WHEN {c} IN ('100%', 'bottom', '150%') THEN 1 WHEN {c} = '25%' THEN 0.25 ELSE 0.5 END"
_POINTS = lambda c: f"""(CASE {c} WHEN 'header' THEN 50 WHEN 'footer' THEN 20 WHEN 'hero' THEN 15 ELSE 0 END + CASE WHEN site <> '' AND (img AND file = site || '.png' OR contains(lower(alt), site) OR contains(class, site)) THEN 40 ELSE 0 END
 + CASE WHEN p % 5 = 0 OR s % 11 = 0 THEN 30 ELSE 0 END + CASE WHEN NOT img AND p % 8 = 0 THEN 40 ELSE 0 END + CASE WHEN link = '/' OR link IN ('https://' || dom, 'https://' || dom || '/', 'https://www.' || dom) THEN 30 ELSE 0 END
 + CASE WHEN y < 200 THEN 10 ELSE 0 END + CASE WHEN x < 400 THEN 10 ELSE 0 END - CASE WHEN y > 500 THEN 50 ELSE 0 END - CASE WHEN img AND (p % 6 = 0 OR p % 6 = 1 AND site <> 'acme') THEN 60 ELSE 0 END
 - CASE WHEN w < 20 OR h < 20 THEN 30 ELSE 0 END - CASE WHEN w > 800 OR h > 500 THEN 80 WHEN w > 600 OR h > 400 THEN 40 ELSE 0 END - CASE WHEN length(alt) > 50 THEN 40 ELSE 0 END + CASE WHEN w > h AND w < 400 AND w > 40 AND h > 10 AND h < 120 THEN 15 ELSE 0 END)"""  # noqa: E731


@query(f"""WITH l AS (SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS el_id, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
m AS (SELECT *, p % 4 <> 0 AS img, {_list(ALTS, 'p')} AS alt, CASE p % 5 WHEN 0 THEN 'site-logo' WHEN 1 THEN 'acme-x' ELSE 'pic' END AS class, {_list(SITES, 'p')} || '.png' AS file, {_list(LINKS, 's')} AS link, CASE WHEN s % 3 = 0 THEN 'header' WHEN q % 9 = 0 THEN 'footer' WHEN q % 9 = 1 THEN 'hero' END AS zone,
 (p % 900)::DOUBLE AS x, (CASE WHEN s % 3 = 0 THEN q % 40 ELSE q * 40 END)::DOUBLE AS y, (p % 211 + 3)::DOUBLE AS wide, (s % 97 + 2)::DOUBLE AS high, CASE WHEN p % 3 = 0 THEN (p % 1000)::DOUBLE END AS nw, CASE WHEN p % 3 = 0 THEN (s % 600)::DOUBLE END AS nh, {_list(FITS, 'p + s')} AS fit, {_list(TOKENS, 'p')} AS tx, {_list(TOKENS, 's')} AS ty, {_list(SITES, 'page_id')} AS site FROM l),
d AS (SELECT *, CASE WHEN site = '' THEN 'plain.org' ELSE site || '.com' END AS dom, CASE WHEN img AND nw > 0 THEN nw ELSE wide END AS w, CASE WHEN img AND nh > 0 THEN nh ELSE high END AS h, CASE WHEN y <= 500 THEN 'header' WHEN y > 800 THEN 'footer' ELSE 'body' END AS region,
 wide >= 24 AND high >= 8 AND s % 3 <> 0 AND y >= 180 AND count(*) FILTER (wide >= 24 AND high >= 8 AND s % 3 <> 0) OVER (PARTITION BY page_id) >= 3 AS wall, p % 5 = 0 OR s % 11 = 0 OR p % 7 IN (0, 1, 2, 6) AS named,
 link IN ('/', '/en-us') OR site = 'globex' AND link = 'https://www.globex.com' OR site = 'acme' AND link = 'https://www.acme.com/' AS home, CASE p % 7 WHEN 0 THEN 'acme' WHEN 1 THEN 'globexwidgets' WHEN 4 THEN 'initech' WHEN 5 THEN 'alongtext' END AS brand FROM m),
o AS (SELECT *, named OR NOT img AND p % 8 = 0 OR link IN ('/', 'https://www.acme.com/', 'https://globex.com') OR s % 13 = 0 AS qualifies FROM d WHERE home OR NOT wall AND (brand IS NULL OR site = '' OR contains(brand, site))),
z AS (SELECT *, CASE WHEN zone IS NOT NULL AND qualifies THEN struct_pack(score := CAST({_POINTS('zone')} AS BIGINT), context := zone) END AS a, CASE WHEN named AND greatest(wide, high) >= 24 AND (home OR y <= 500) THEN struct_pack(score := CAST({_POINTS('region')} + 20 AS BIGINT), context := region) END AS b FROM o),
f AS (SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR a > b THEN a ELSE b END AS best FROM z WHERE a IS NOT NULL OR b IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY best.score DESC, el_id) AS rank FROM f),
g AS (SELECT *, CASE WHEN fit IN ('contain', 'scale-down') AND nw > 0 AND nh > 0 THEN CASE WHEN fit = 'scale-down' THEN least(1, wide / nw, high / nh) ELSE least(wide / nw, high / nh) END END AS k FROM r WHERE rank <= 6)
SELECT page_id, el_id, best.context AS context, best.score AS score, rank, x + (wide - coalesce(nw * k, wide)) * {_SHARE('tx')} AS box_x, y + (high - coalesce(nh * k, high)) * {_SHARE('ty')} AS box_y, coalesce(nw * k, wide) AS box_width, coalesce(nh * k, high) AS box_height FROM g""")
def page_logos(spark, sf):
    out = logos.ranked(marks(spark, sf))
    return out.select("page_id", "el_id", "context", "score", "rank", *(F.col(f"box.{c}").alias(f"box_{c}") for c in ("x", "y", "width", "height")))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'data:image/svg+xml;utf8,' || page_id WHEN page_id % 5 = 1 THEN '/i/logo-' || page_id || '.PNG?x=1' WHEN page_id % 5 = 2 THEN '/_next/image?url=%2Fa%2Eb%2Fl%2Ewebp&w=' || page_id
WHEN page_id % 3 = 0 THEN '/touch.png' WHEN page_id % 3 = 1 THEN '/b.png' ELSE '/favicon.ico' END AS url FROM pages""")
def page_pictures(spark, sf):
    """Logos of three in five pages; the others show an icon: for touch, the largest, or the usual one."""
    k, said = F.col("page_id"), F.col("page_id").cast("string")
    pages = table(spark, sf, "pages").select("page_id", "html")
    url = F.when(k % 5 == 1, F.concat(F.lit("/i/logo-"), said, F.lit(".PNG?x=1"))).when(k % 5 == 2, F.concat(F.lit("/_next/image?url=%2Fa%2Eb%2Fl%2Ewebp&w="), said)).when(k % 5 == 3, "/about")
    found = pages.where(k % 5 != 4).select("page_id", url.alias("url"), F.when(k % 5 == 0, F.concat(F.lit("data:image/svg+xml;utf8,"), said)).alias("data_uri"))
    links = F.when(k % 3 == 0, '<head><link rel="icon" sizes="16x16" href="/a.png"><link rel="apple-touch-icon" href="/touch.png">').when(k % 3 == 1, '<head><meta property="og:image" content="/share.png"><link rel="icon" sizes="16x16" href="/a.png"><link rel="icon" sizes="192x192" href="/b.png">').otherwise('<head><meta property="og:image" content="/share.png">')
    return logos.best_picture(found, hints.icons(pages.withColumn("html", F.replace(F.col("html"), F.lit("<head>"), links))))
