"""Registered queries of components, fonts, gradients, motion, colour notations and heads of pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaspan.functions import color
from chromaspan.operators import components, effects, fonts
from chromaspan.sources import hints

from .bridge import OBS, observations, table
from .registry import query


def _pick(values: tuple, at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def interface_elements(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as interface elements: 50 pages a site, an element per line."""
    part, line, order = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey")
    q = F.col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("site"),
        (order % 50).alias("page_id"),
        (order * 10 + line).alias("ord"),
        _pick(("BUTTON", "A", "INPUT", "SPAN", "SELECT"), part).alias("tag"),
        _pick(("button", "tab", None, "status"), q).alias("role"),
        _pick(("checkbox", "radio", "email"), line).alias("type"),
        F.when(part % 4 == 0, "chip small").otherwise("box").alias("class"),
        (F.col("l_returnflag") == "R").alias("inside"),
        (q * 5).alias("width"),
        (part % 60 + 10).alias("height"),
        (F.col("l_suppkey") * 7 % 2000).alias("top"),
        F.when(F.col("l_linestatus") == "O", _pick(("#ff0000", "#ffc107", "#28a745", "#3b82f6", "#f8f8f8", "#336699"), part)).alias("bg"),
        F.when(part % 2 == 0, "#ffffff").otherwise("#111111").alias("fg"),
        (part % 3).alias("border_width"),
        F.lit("#333333").alias("border_color"),
        (line * 2).cast("long").alias("radius"),
        (line + 10).cast("long").alias("size"),
        F.lit(400).alias("weight"),
        F.col("l_returnflag").alias("text"),
    )


ELEMENTS = """el AS (SELECT l_suppkey % 20 AS site, l_orderkey % 50 AS page_id, l_orderkey * 10 + l_linenumber AS ord,
  ['BUTTON', 'A', 'INPUT', 'SPAN', 'SELECT'][l_partkey % 5 + 1] AS tag, coalesce(['button', 'tab', NULL, 'status'][CAST(l_quantity AS BIGINT) % 4 + 1], '') AS role,
  ['checkbox', 'radio', 'email'][l_linenumber % 3 + 1] AS type, l_partkey % 4 = 0 AS chip, l_returnflag = 'R' AS inside,
  CAST(l_quantity AS BIGINT) * 5 AS width, l_partkey % 60 + 10 AS height, l_suppkey * 7 % 2000 AS top,
  CASE WHEN l_linestatus = 'O' THEN ['#ff0000', '#ffc107', '#28a745', '#3b82f6', '#f8f8f8', '#336699'][l_partkey % 6 + 1] ELSE 'transparent' END AS bg,
  CASE WHEN l_partkey % 2 = 0 THEN '#ffffff' ELSE '#111111' END AS fg, l_partkey % 3 AS bw, (l_partkey % 3) || ' #333333' AS border,
  CAST(l_linenumber * 2 AS BIGINT) AS radius, CAST(l_linenumber + 10 AS BIGINT) AS size, l_returnflag AS text FROM lineitem)"""
BUTTONS = f"""{ELEMENTS}, cand AS (SELECT *, CASE WHEN tag = 'BUTTON' THEN 30 ELSE 0 END + CASE WHEN role = 'button' THEN 20 ELSE 0 END + CASE WHEN bg <> 'transparent' THEN 20 WHEN bw > 0 THEN 10 ELSE 0 END
  + CASE WHEN top < 900 THEN 15 ELSE 0 END + CASE WHEN top < 300 THEN 10 ELSE 0 END AS score FROM el
  WHERE (tag IN ('BUTTON', 'A') OR role = 'button') AND role <> 'tab' AND NOT inside AND (bg <> 'transparent' OR bw > 0) AND height BETWEEN 24 AND 100 AND width BETWEEN 40 AND 600),
one AS (SELECT *, row_number() OVER (PARTITION BY site, page_id, bg, fg, radius, border ORDER BY score DESC, ord, text, size) AS k FROM cand),
btn AS (SELECT site, page_id, bg, fg, radius, border, text, size, CASE WHEN score >= 40 THEN 'high' ELSE 'medium' END AS confidence, row_number() OVER (PARTITION BY site, page_id ORDER BY score DESC, ord, text, size, bg, fg, radius, border) AS rank FROM one WHERE k = 1 QUALIFY rank <= 8)"""


@query(f"WITH {BUTTONS} SELECT site, page_id, bg, fg, radius, border, text, size, confidence, rank FROM btn")
def button_looks(spark, sf):
    return components.buttons(interface_elements(spark, sf)).drop("weight")


@query(f"WITH {BUTTONS} SELECT site, bg, fg, radius, border, size, count(*) AS n, arg_min(confidence, struct_pack(a := page_id, b := rank)) AS confidence FROM btn GROUP BY ALL")
def merged_button_looks(spark, sf):
    found = components.buttons(interface_elements(spark, sf))
    return components.merged(found, ["bg", "fg", "radius", "border", "size"], ["page_id", "rank"], ["confidence"])


@query(f"""WITH {ELEMENTS}, i AS (SELECT *, CASE WHEN tag = 'SELECT' THEN 'select' WHEN type = 'email' THEN 'text' ELSE type END AS grp FROM el WHERE tag IN ('INPUT', 'SELECT')),
k AS (SELECT *, row_number() OVER (PARTITION BY site, page_id, grp, border, radius, bg ORDER BY ord, type) AS k FROM i),
r AS (SELECT site, page_id, grp, border, radius, bg, type AS specific, row_number() OVER (PARTITION BY site, page_id, grp ORDER BY ord, type, border, radius, bg) AS rank FROM k WHERE k = 1)
SELECT * FROM r WHERE rank <= CASE WHEN grp = 'text' THEN 5 ELSE 3 END""")
def input_looks(spark, sf):
    return components.inputs(interface_elements(spark, sf))


@query(f"""WITH {ELEMENTS}, b AS (SELECT *, CASE WHEN bg = 'transparent' THEN 'outline' WHEN bg = '#f8f8f8' THEN 'subtle' ELSE 'filled' END AS style FROM el
WHERE (chip OR role = 'status') AND width BETWEEN 1 AND 200 AND height <= 60 AND size <= 16 AND (bg <> 'transparent' OR bw > 0)),
k AS (SELECT *, row_number() OVER (PARTITION BY site, page_id, bg, fg, radius, style ORDER BY ord, radius > height / 3.0) AS k FROM b)
SELECT site, page_id, bg, fg, radius, style, CASE bg WHEN '#ff0000' THEN 'error' WHEN '#ffc107' THEN 'warning' WHEN '#28a745' THEN 'success' WHEN '#3b82f6' THEN 'info' ELSE 'neutral' END AS variant,
 radius > height / 3.0 AS rounded, 'high' AS confidence, row_number() OVER (PARTITION BY site, page_id ORDER BY ord, CASE bg WHEN '#ff0000' THEN 'error' WHEN '#ffc107' THEN 'warning' WHEN '#28a745' THEN 'success' WHEN '#3b82f6' THEN 'info' ELSE 'neutral' END, radius > height / 3.0, bg, fg, radius, style) AS rank FROM k WHERE k = 1""")
def badge_looks(spark, sf):
    return components.badges(interface_elements(spark, sf))


# ---- fonts: parts as font settings and addresses

def _settings(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    return p.select((F.col("p_partkey") % 10).alias("site"), F.concat(F.lit('"wght" '), size, F.lit('00, "slnt" -'), size, F.lit(".5")).alias("setting"))


@query("""WITH s AS (SELECT p_partkey % 10 AS site, CAST(p_size AS DOUBLE) AS size FROM part)
SELECT site, 'wght' AS axis, min(size * 100) AS low, max(size * 100) AS high, count(*) AS n FROM s GROUP BY site
UNION ALL SELECT site, 'slnt', min(-size - 0.5), max(-size - 0.5), count(*) FROM s GROUP BY site""")
def font_axes(spark, sf):
    return fonts.variable_axes(_settings(spark, sf))


@query("""WITH s AS (SELECT p_partkey % 10 AS site, p_size FROM part) SELECT DISTINCT site, 'ss' || p_size AS feature FROM s WHERE p_size % 3 <> 0 UNION SELECT DISTINCT site, 'kern' FROM s""")
def font_features(spark, sf):
    size = F.col("p_size").cast("string")
    said = F.concat(F.lit('"ss'), size, F.lit('" '), F.when(F.col("p_size") % 3 == 0, "off").otherwise("on"), F.lit(', "tnum" 0, "kern"'))
    return fonts.open_type_features(table(spark, sf, "part").select((F.col("p_partkey") % 10).alias("site"), said.alias("setting")))


@query("""SELECT DISTINCT p_partkey % 10 AS site, CASE p_partkey % 3 WHEN 0 THEN 'https://cdn.example.com/' || p_size || '.WOFF2?v=1' ELSE 'https://fonts.bunny.net/' || p_size END AS url FROM part WHERE p_partkey % 3 < 2""")
def font_urls(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    url = F.when(p % 3 == 0, F.concat(F.lit("https://cdn.example.com/"), size, F.lit(".WOFF2?v=1"))).when(p % 3 == 1, F.concat(F.lit("https://fonts.bunny.net/"), size)).otherwise(F.concat(F.lit("https://cdn.example.com/"), size, F.lit(".css")))
    return fonts.font_urls(table(spark, sf, "part").select((p % 10).alias("site"), url.alias("url")))


@query("SELECT p_partkey % 10 AS site, p_brand AS family, bool_or(p_size % 2 = 0) AS variable FROM part GROUP BY ALL")
def linked_font_families(spark, sf):
    url = F.concat(F.lit("https://fonts.googleapis.com/css2?family="), F.regexp_replace("p_brand", " ", "+"), F.when(F.col("p_size") % 2 == 0, ":wght@400").otherwise(""), F.lit("&display=swap"))
    return fonts.linked_families(table(spark, sf, "part").select((F.col("p_partkey") % 10).alias("site"), url.alias("url")))


# ---- gradients and motion

@query(f"""WITH {OBS}, g AS (SELECT site, 'linear-gradient(rgb(' || width || ', 0, 0), ' || hex || ')' AS gradient, 'linear' AS kind, 'rgb(' || width || ', 0, 0) ' || hex AS stops FROM obs
UNION ALL SELECT site, 'repeating-radial-gradient(' || hex || ', #fff 9px)', 'radial-repeating', hex || ' #fff' FROM obs),
c AS (SELECT site, gradient, kind, stops, count(*) AS n FROM g GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, gradient) AS rank FROM c QUALIFY rank <= 20""")
def gradient_histogram(spark, sf):
    w, h = F.col("width").cast("string"), F.col("hex")
    image = F.concat(F.lit("linear-gradient(rgb("), w, F.lit(", 0,  0), "), h, F.lit("), url(a.png), repeating-radial-gradient("), h, F.lit(",  #fff 9px)"))
    return effects.gradients(observations(spark, sf).select("site", image.alias("image")))


@query("""WITH s AS (SELECT event_id, user_id % 5 AS k, value FROM events)
SELECT event_id AS page_id, CAST(0 AS BIGINT) AS el, CASE k WHEN 0 THEN 'scale-up' WHEN 1 THEN 'scale-down' WHEN 2 THEN 'slide-y' WHEN 3 THEN 'fade-out' ELSE 'color-shift' END AS pattern FROM s""")
def state_deltas(spark, sf):
    e, k = table(spark, sf, "events"), F.col("user_id") % 5
    state = lambda t, o, bg: e.select(F.col("event_id").alias("page_id"), F.lit(0).cast("long").alias("el"), t.alias("transform"), o.alias("opacity"), bg.alias("bg"), F.lit("#000").alias("fg"))
    rest = state(F.lit("none"), F.lit(1.0), F.lit("#fff"))
    over = state(F.when(k == 0, "scale(1.1)").when(k == 1, "scale(0.9)").when(k == 2, "translateY(-2px)").otherwise("none"), F.when(k == 3, 0.5).otherwise(1.0), F.when(k == 4, "#eee").otherwise("#fff"))
    return effects.delta_pattern(rest, over)


# ---- colour notations

@query(f"WITH {OBS} SELECT DISTINCT site, hex, notation, hex AS again FROM obs, (SELECT unnest(['hsl', 'hwb', 'oklab', 'oklch']) AS notation)")
def color_notations(spark, sf):
    """Every colour of a site written in four notations and read again."""
    once = observations(spark, sf).select("site", "hex").distinct()
    forms = F.create_map(*(x for name, f in (("hsl", color.as_hsl), ("hwb", color.as_hwb), ("oklab", color.as_oklab), ("oklch", color.as_oklch)) for x in (F.lit(name), f(F.col("hex")))))
    read = color.parsed(once.select("site", "hex", F.explode(forms).alias("notation", "css")), "css")
    return read.select("site", "hex", "notation", color.to_hex(F.col("rgba.r"), F.col("rgba.g"), F.col("rgba.b")).alias("again"))


# ---- heads of pages: a part's brand and size as declared colours and icons

def _heads(spark, sf):
    size = F.col("p_size").cast("string")
    media = F.when(F.col("p_size") % 2 == 0, ' media="(prefers-color-scheme: dark)"').otherwise("")
    icon = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('<link rel="icon" sizes="32x32" href="/'), size, F.lit('.png">'))).otherwise("")
    html = F.concat(F.lit('<head><meta name="theme-color" content="'), F.col("p_brand"), F.lit('"'), media, F.lit('><link rel="mask" color="none"><link rel="mask-icon" color="c'), size, F.lit('">'), icon, F.lit('<meta property="og:image" content="/p.png"></head>'))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@query("""SELECT p_partkey AS page_id, CASE WHEN p_size % 2 = 0 THEN 'c' || p_size ELSE p_brand END AS theme_color, CASE WHEN p_size % 2 = 0 THEN p_brand END AS dark_theme_color, CAST(NULL AS VARCHAR) AS background_color FROM part""")
def theme_colors(spark, sf):
    return hints.theme(hints.platform_colors(hints.head_tags(_heads(spark, sf))))


@query("""SELECT p_partkey AS page_id, 'icon' AS kind, '/' || p_size || '.png' AS href, '32x32' AS sizes, CAST(1 AS BIGINT) AS rank FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, 'og:image', '/p.png', NULL, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END FROM part
UNION ALL SELECT p_partkey, 'favicon.ico', '/favicon.ico', NULL, 2 FROM part WHERE p_size % 3 <> 0""")
def declared_icons(spark, sf):
    return hints.icons(_heads(spark, sf))
