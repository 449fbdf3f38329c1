"""The registered queries of the design-token operators and their SQL on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaspan.functions import color, text
from chromaspan.lineage import cut
from chromaspan.operators import audit, brand, drift, exports, extract, inject, isolation, merge, naming, roles, summary
from chromaspan.operators import documents as documents_of
from chromaspan.sources import pages as page_ops
from chromaspan.streaming import captures

from . import documents, logos, marks, parts, semantics, summaries  # noqa: F401  (register their queries)
from .bridge import CONTEXT, OBS, TYPE, observations, table, type_observations
from .registry import ORACLES, QUERIES, query  # noqa: F401

# ---- histograms and statistics of a site's elements

SPACING = f"""{OBS}, sp AS (SELECT site, px, count(*) AS n FROM obs WHERE px > 0 GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, px) AS rank FROM sp), spacing AS (SELECT * FROM sr WHERE rank <= 20),
scale AS (SELECT site, CASE WHEN bool_or(px % 8 = 0) THEN 'base-8' WHEN bool_or(px % 4 = 0) THEN 'base-4' ELSE 'custom' END AS scale FROM spacing GROUP BY site)"""


@query(f"WITH {SPACING} SELECT site, px, n, rank FROM spacing")
def spacing_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return extract.spacing_histogram(observations(spark, sf))


@query(f"WITH {SPACING} SELECT site, scale FROM scale")
def spacing_scale(spark, sf):
    return extract.spacing_scale(extract.spacing_histogram(observations(spark, sf)))


RADIUS = f"""{OBS}, rad AS (SELECT site, radius, count(*) AS n, array_to_string(list_sort(list_distinct(list(tag)))[1:5], ',') AS elements,
CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 3 THEN 'medium' ELSE 'low' END AS confidence FROM obs GROUP BY site, radius)"""


@query(f"WITH {RADIUS} SELECT * FROM rad")
def radius_histogram(spark, sf):
    return extract.radius_histogram(observations(spark, sf))


@query(f"WITH {OBS} SELECT site, width, CASE WHEN width > 2 THEN 'dashed' ELSE 'solid' END AS style, hex, count(*) AS n, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 3 THEN 'medium' ELSE 'low' END AS confidence FROM obs GROUP BY site, width, hex")
def border_combinations(spark, sf):
    return extract.border_combinations(observations(spark, sf))


@query(f"""WITH {OBS}, s AS (SELECT site, '0px ' || width || 'px ' || radius || 'px ' || hex AS shadow, radius AS blur FROM obs)
SELECT site, shadow, count(*) AS n, CASE WHEN count(*) > 5 THEN 'high' WHEN count(*) > 2 THEN 'medium' ELSE 'low' END AS confidence, blur FROM s GROUP BY site, shadow, blur""")
def shadow_histogram(spark, sf):
    return extract.shadow_histogram(observations(spark, sf))


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


CH = """CAST('0x' || substr(hex, 2, 2) AS INT) AS r, CAST('0x' || substr(hex, 4, 2) AS INT) AS g, CAST('0x' || substr(hex, 6, 2) AS INT) AS b"""
LUM = f"(0.2126::DOUBLE * {_lin('r')} + 0.7152::DOUBLE * {_lin('g')} + 0.0722::DOUBLE * {_lin('b')})"
STATS = f"""{OBS}, st0 AS (SELECT site, hex, count(*) AS n, count(*) FILTER (is_bg) AS bg, CAST(sum(score) AS BIGINT) AS score, bool_or(is_token) AS is_token FROM obs GROUP BY site, hex),
st AS (SELECT *, CAST(floor(n / CAST(sum(n) OVER (PARTITION BY site) AS DOUBLE) * 1000000 + 0.5) AS BIGINT) AS share, CAST(sum(n) OVER (PARTITION BY site) AS BIGINT) AS total FROM st0),
ch AS (SELECT *, {CH} FROM st),
cs AS (SELECT *, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE END AS sat, {LUM} AS lum FROM ch)"""
PALETTE = f"""{STATS}, p0 AS (SELECT *, CASE WHEN is_token THEN CASE WHEN score > 5 THEN 'high' ELSE 'medium' END WHEN score > 20 THEN 'high' WHEN score > 5 THEN 'medium' ELSE 'low' END AS c0 FROM cs
WHERE (is_token OR score >= 10 OR score >= 3 * n OR n >= greatest(3, floor(total * 0.01::DOUBLE)))
  AND NOT (NOT is_token AND ((n * 100 > 40 * total AND score < 1.2::DOUBLE * n AND sat <= 0.2) OR (bg = 0 AND score < 1.5::DOUBLE * n AND sat > 0.3)))),
p1 AS (SELECT *, CASE WHEN c0 = 'high' AND n < 3 THEN CASE WHEN n >= 2 THEN 'medium' ELSE 'low' END WHEN c0 = 'medium' AND n < 2 THEN 'low' ELSE c0 END AS confidence FROM p0),
palette AS (SELECT site, hex, n, score, confidence, CASE WHEN lum > 0.9 OR lum < 0.005 THEN 'surface' WHEN sat < 0.12 THEN 'neutral' WHEN confidence IN ('high', 'medium') THEN 'accent' ELSE 'supporting' END AS role,
  CASE WHEN 1.05 / (lum + 0.05) >= (lum + 0.05) / 0.05 THEN '#ffffff' ELSE '#000000' END AS on_color, lum, r, g, b FROM p1)"""


@query(f"WITH {STATS} SELECT site, hex, n, bg, score, is_token, share FROM st")
def color_statistics(spark, sf):
    return extract.color_statistics(observations(spark, sf))


def _palette(spark, sf):
    return extract.palette(extract.color_statistics(observations(spark, sf)))


@query(f"WITH {PALETTE} SELECT site, hex, n, score, confidence, role, on_color FROM palette")
def palette_admission(spark, sf):
    return _palette(spark, sf)


@query(f"WITH {STATS} SELECT site, hex, n FROM st WHERE n >= 5")
def raw_colors(spark, sf):
    return extract.color_statistics(observations(spark, sf)).where("n >= 5").select("site", "hex", "n")


PRIMARY = "pr AS (SELECT site, hex, n, n + CASE WHEN is_token THEN 20 ELSE 0 END AS points FROM cs WHERE sat > 0.3 QUALIFY row_number() OVER (PARTITION BY site ORDER BY n + CASE WHEN is_token THEN 20 ELSE 0 END DESC, hex) = 1)"


@query(f"WITH {STATS}, {PRIMARY} SELECT * FROM pr")
def primary_colors(spark, sf):
    return extract.primary_colors(extract.color_statistics(observations(spark, sf)))


def _f(t: str) -> str:
    return f"(CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3) ELSE (903.3::DOUBLE * {t} + 16) / 116 END)"


_X = f"((0.4124564::DOUBLE * {_lin('r')} + 0.3575761::DOUBLE * {_lin('g')} + 0.1804375::DOUBLE * {_lin('b')}) / 0.95047::DOUBLE)"
_Y = f"(0.2126729::DOUBLE * {_lin('r')} + 0.7151522::DOUBLE * {_lin('g')} + 0.0721750::DOUBLE * {_lin('b')})"
_Z = f"((0.0193339::DOUBLE * {_lin('r')} + 0.1191920::DOUBLE * {_lin('g')} + 0.9503041::DOUBLE * {_lin('b')}) / 1.08883::DOUBLE)"
LAB = f"{OBS}, h AS (SELECT DISTINCT hex, {CH} FROM obs), lab AS (SELECT hex, {LUM} AS lum, 116 * {_f(_Y)} - 16 AS l, 500 * ({_f(_X)} - {_f(_Y)}) AS a, 200 * ({_f(_Y)} - {_f(_Z)}) AS bb FROM h)"


@query(f"WITH {LAB} SELECT hex, CAST(floor(lum * 100000 + 0.5) AS BIGINT) AS lum, CAST(floor(l * 1000 + 0.5) AS BIGINT) AS l, CAST(floor(a * 1000 + 0.5) AS BIGINT) AS a, CAST(floor(bb * 1000 + 0.5) AS BIGINT) AS b, CAST(floor(1.05::DOUBLE / (lum + 0.05) * 100 + 0.5) AS BIGINT) AS on_white FROM lab")
def color_math(spark, sf):
    once = observations(spark, sf).select("hex").distinct()
    lab, lum = color.lab(F.col("hex")), color.luminance(F.col("hex"))
    return once.select("hex", text.scaled(lum, 100000).alias("lum"), text.scaled(lab["l"]).alias("l"), text.scaled(lab["a"]).alias("a"), text.scaled(lab["b"]).alias("b"), text.scaled(color.contrast(lum, F.lit(1.0)), 100).alias("on_white"))


@query(f"WITH {LAB}, u AS (SELECT DISTINCT site, hex FROM obs) SELECT x.site, x.hex AS one, y.hex AS two, CAST(floor(sqrt(pow(p.l - q.l, 2) + pow(p.a - q.a, 2) + pow(p.bb - q.bb, 2)) * 1000 + 0.5) AS BIGINT) AS delta FROM u x JOIN u y ON x.site = y.site AND x.hex < y.hex JOIN lab p ON p.hex = x.hex JOIN lab q ON q.hex = y.hex WHERE sqrt(pow(p.l - q.l, 2) + pow(p.a - q.a, 2) + pow(p.bb - q.bb, 2)) < 15")
def near_colors(spark, sf):
    used = cut(observations(spark, sf).select("site", "hex").distinct())  # or the join's test on lab would be made for every element
    once = used.withColumn("lab", color.lab(F.col("hex")))
    a, b = once.alias("a"), once.alias("b")
    delta = color.delta_e(F.col("a.lab"), F.col("b.lab"))
    return a.join(b, (F.col("a.site") == F.col("b.site")) & (F.col("a.hex") < F.col("b.hex"))).where(delta < 15).select(F.col("a.site").alias("site"), F.col("a.hex").alias("one"), F.col("b.hex").alias("two"), text.scaled(delta).alias("delta"))


DE2000 = f"""{PALETTE}, {LAB.removeprefix(OBS + ', ')}, np0 AS (SELECT x.site, x.hex AS one, y.hex AS two, p.l AS l1, p.a AS a1, p.bb AS b1, q.l AS l2, q.a AS a2, q.bb AS b2, (sqrt(p.a * p.a + p.bb * p.bb) + sqrt(q.a * q.a + q.bb * q.bb)) / 2 AS m FROM palette x JOIN palette y ON x.site = y.site AND x.hex < y.hex JOIN lab p ON p.hex = x.hex JOIN lab q ON q.hex = y.hex),
np1 AS (SELECT *, 1 + 0.5::DOUBLE * (1 - sqrt(pow(m, 7) / (pow(m, 7) + 6103515625.0::DOUBLE))) AS g FROM np0),
np2 AS (SELECT *, sqrt(pow(g * a1, 2) + b1 * b1) AS c1, sqrt(pow(g * a2, 2) + b2 * b2) AS c2, CASE WHEN a1 = 0 AND b1 = 0 THEN 0 ELSE degrees(atan2(b1, g * a1)) END AS h1_, CASE WHEN a2 = 0 AND b2 = 0 THEN 0 ELSE degrees(atan2(b2, g * a2)) END AS h2_ FROM np1),
np3 AS (SELECT *, CASE WHEN h1_ < 0 THEN h1_ + 360 ELSE h1_ END AS h1, CASE WHEN h2_ < 0 THEN h2_ + 360 ELSE h2_ END AS h2 FROM np2),
np4 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS h, pow((l1 + l2) / 2 - 50, 2) AS low, (c1 + c2) / 2 AS c FROM np3),
np5 AS (SELECT *, 1 - 0.17::DOUBLE * cos(radians(h - 30)) + 0.24::DOUBLE * cos(radians(2 * h)) + 0.32::DOUBLE * cos(radians(3 * h + 6)) - 0.20::DOUBLE * cos(radians(4 * h - 63)) AS t, -sin(radians(60 * exp(-pow((h - 275) / 25, 2)))) * 2 * sqrt(pow(c, 7) / (pow(c, 7) + 6103515625.0::DOUBLE)) AS turn FROM np4),
np6 AS (SELECT site, one, two, (l2 - l1) / (1 + 0.015::DOUBLE * low / sqrt(20 + low)) AS dl, (c2 - c1) / (1 + 0.045::DOUBLE * c) AS dc, 2 * sqrt(c1 * c2) * sin(radians(dh) / 2) / (1 + 0.015::DOUBLE * c * t) AS dk, turn FROM np5),
near2000 AS (SELECT site, one, two, sqrt(greatest(0, dl * dl + dc * dc + dk * dk + turn * dc * dk)) AS delta FROM np6)"""


@query(f"WITH {DE2000} SELECT site, one, two, CAST(floor(delta * 1000 + 0.5) AS BIGINT) AS delta FROM near2000 WHERE delta < 6")
def near_identical_colors(spark, sf):
    return audit.near_identical(_palette(spark, sf), 6.0).withColumn("delta", text.scaled(F.col("delta")))


WCAG = f"""{PALETTE}, ten AS (SELECT * FROM palette QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, hex) <= 10),
wp AS (SELECT f.site, f.hex AS fg, k.hex AS bg, (f.lum + 0.05) / (k.lum + 0.05) AS ratio FROM ten f JOIN ten k ON f.site = k.site AND (f.lum > k.lum OR (f.lum = k.lum AND f.hex < k.hex)))"""


@query(f"WITH {WCAG} SELECT site, fg, bg, CAST(floor(ratio * 100 + 0.5) AS BIGINT) AS ratio, ratio >= 4.5 AS aa, ratio >= 3 AS aa_large, ratio >= 7 AS aaa FROM wp")
def palette_contrast(spark, sf):
    return audit.palette_contrast(_palette(spark, sf))


PAIRS = f"""{OBS}, fb AS (SELECT a.site, least(a.hex, b.hex) AS one, greatest(a.hex, b.hex) AS two, count(*) AS n FROM obs a JOIN obs b ON a.page_id = b.page_id AND a.site = b.site AND b.ord = a.ord + 1 GROUP BY ALL)"""


@query(f"WITH {PAIRS} SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, one, two) AS rank FROM fb QUALIFY rank <= 50")
def observed_contrast_pairs(spark, sf):
    obs = observations(spark, sf)
    below = obs.select("site", "page_id", (F.col("ord") - 1).alias("ord"), F.col("hex").alias("bg"))
    return merge.contrast_pairs(obs.join(below, ["site", "page_id", "ord"]).select("site", F.col("hex").alias("fg"), "bg", F.lit(1).cast("long").alias("n")))


def _leaders(order: str, rows: str) -> str:
    """Leader clusters as a recursion over the ordered colours of each site."""
    return f"""lc AS (SELECT site, c.hex, row_number() OVER (PARTITION BY site ORDER BY {order}) AS i, l, a, bb FROM {rows} c JOIN lab ON lab.hex = c.hex),
led AS (SELECT DISTINCT site, 0::BIGINT AS i, []::STRUCT(hex VARCHAR, l DOUBLE, a DOUBLE, bb DOUBLE)[] AS led, NULL::VARCHAR AS hex, NULL::VARCHAR AS leader FROM lc
UNION ALL SELECT site, i, CASE WHEN found IS NULL THEN list_append(led, own) ELSE led END, hex, coalesce(found, hex) FROM (SELECT r.site, c.i, r.led, struct_pack(hex := c.hex, l := c.l, a := c.a, bb := c.bb) AS own, c.hex, list_filter(r.led, lambda x: sqrt(pow(x.l - c.l, 2) + pow(x.a - c.a, 2) + pow(x.bb - c.bb, 2)) < 15)[1].hex AS found FROM led r JOIN lc c ON c.site = r.site AND c.i = r.i + 1))"""


@query(f"""WITH RECURSIVE {LAB}, u AS (SELECT site, hex, count(*) AS n, min(ord) AS ord, bool_or(is_token) AS tok FROM obs GROUP BY ALL), {_leaders('n DESC, c.ord, c.hex', 'u')}
SELECT led.site, led.hex, n, leader, first_value(led.hex) OVER (PARTITION BY led.site, leader ORDER BY NOT tok, n DESC, u.ord, led.hex) AS shown FROM led JOIN u ON u.site = led.site AND u.hex = led.hex WHERE i > 0""")
def leader_clusters(spark, sf):
    obs = observations(spark, sf)
    return merge.leader_clusters(obs.groupBy("site", "hex").agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.max("is_token").alias("is_token")))


@query(f"""WITH RECURSIVE {LAB}, pc AS (SELECT site, page_id, hex, count(*) AS n, min(ord) AS ord FROM obs GROUP BY ALL), u AS (SELECT site, hex, min(struct_pack(a := page_id, b := ord)) AS first FROM pc GROUP BY ALL), {_leaders('first, c.hex', 'u')},
j AS (SELECT pc.*, leader, CASE WHEN pc.n > 1 THEN 'medium' ELSE 'low' END AS c0 FROM pc JOIN led ON led.site = pc.site AND led.hex = pc.hex AND i > 0),
g AS (SELECT site, leader, CAST(sum(n) AS BIGINT) AS n, count(*) AS members, count(DISTINCT page_id) AS pages, arg_min(struct_pack(hex := hex, c := c0), struct_pack(a := -n, b := page_id, c := ord, d := hex)) AS best FROM j GROUP BY ALL)
SELECT site, best.hex AS hex, n, members, pages, CASE WHEN pages > 2 AND (best.c = 'medium' OR best.c = 'low') THEN 'high' WHEN pages > 1 AND best.c = 'low' THEN 'medium' ELSE best.c END AS confidence FROM g""")
def merged_palettes(spark, sf):
    rows = observations(spark, sf).groupBy("site", "page_id", "hex").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    return merge.palettes(rows.withColumn("confidence", F.when(F.col("n") > 1, "medium").otherwise("low")))


@query(f"WITH {LAB}, pal AS (SELECT DISTINCT site, hex FROM obs WHERE px = 1), vr AS (SELECT site, hex, arg_min('--v' || px, struct_pack(a := ord, b := '--v' || px)) AS name FROM obs WHERE px > 45 GROUP BY ALL) SELECT v.site, v.hex, name FROM vr v JOIN lab x ON x.hex = v.hex WHERE NOT EXISTS (SELECT 1 FROM pal p JOIN lab y ON y.hex = p.hex WHERE p.site = v.site AND sqrt(pow(x.l - y.l, 2) + pow(x.a - y.a, 2) + pow(x.bb - y.bb, 2)) < 15)")
def residual_variables(spark, sf):
    obs = observations(spark, sf)
    return summary.residual_variables(obs.where("px > 45").select("site", F.concat(F.lit("--v"), F.col("px").cast("string")).alias("name"), "ord", "hex"), obs.where("px = 1").select("site", "hex").distinct())


@query(f"WITH {PALETTE}, vr AS (SELECT DISTINCT site, hex FROM obs WHERE px > 45) SELECT site, hex, n, EXISTS (SELECT 1 FROM vr WHERE vr.site = palette.site AND vr.hex = palette.hex) AS declared FROM palette")
def palette_provenance(spark, sf):
    return summary.declared(_palette(spark, sf).select("site", "hex", "n"), observations(spark, sf).where("px > 45"))


# ---- type

STYLES = f"{TYPE}, styles AS (SELECT site, {CONTEXT} AS context, family, size, weight, count(*) AS n, min(ord) AS first FROM typ GROUP BY ALL)"


@query(f"WITH {STYLES} SELECT * FROM styles")
def type_styles(spark, sf):
    return extract.type_styles(type_observations(spark, sf))


@query(f"WITH {TYPE}, b AS (SELECT site, family, CAST(sum(size) AS BIGINT) AS weight, min(ord) AS first FROM typ WHERE size BETWEEN 11 AND 24 AND tag = 'P' GROUP BY ALL) SELECT site, family, weight FROM b QUALIFY row_number() OVER (PARTITION BY site ORDER BY weight DESC, first) = 1")
def body_family(spark, sf):
    return extract.body_family(type_observations(spark, sf))


@query(f"WITH {TYPE}, f AS (SELECT site, family, count(*) AS n FROM typ GROUP BY ALL), g AS (SELECT *, n >= 3 AND n >= 0.02::DOUBLE * sum(n) OVER (PARTITION BY site) AS good FROM f) SELECT site, family, n, good OR NOT max(good) OVER (PARTITION BY site) AS kept FROM g")
def family_floor(spark, sf):
    return extract.family_floor(type_observations(spark, sf))


@query(f"WITH {STYLES} SELECT site, family, size, weight, count(*) AS n, arg_min(context, struct_pack(a := first, b := context)) AS context FROM styles GROUP BY ALL")
def merged_typography(spark, sf):
    return merge.typography(extract.type_styles(type_observations(spark, sf)).withColumn("page_ord", F.col("first")))


@query(f"""WITH {STYLES}, k AS (SELECT site, size, weight, list_sort(list_distinct(list(context))) AS roles FROM styles GROUP BY ALL)
SELECT site, size, weight, array_to_string(roles[1:4], ',') AS roles FROM k WHERE len(roles) >= 2 AND (len(list_filter(roles, lambda x: regexp_matches(x, 'heading|display|title'))) >= 2
OR (len(list_filter(roles, lambda x: regexp_matches(x, 'heading|display|title'))) >= 1 AND len(list_filter(roles, lambda x: regexp_matches(x, 'body|text|paragraph'))) >= 1))""")
def hierarchy_collisions(spark, sf):
    return audit.hierarchy_collisions(extract.type_styles(type_observations(spark, sf)))


# ---- pages of a site merged

@query(f"WITH {OBS}, p AS (SELECT site, page_id, px, count(*) AS n FROM obs GROUP BY ALL) SELECT site, px, CAST(sum(n) AS BIGINT) AS n, count(*) AS pages FROM p GROUP BY ALL")
def merged_spacing(spark, sf):
    return merge.spacing(observations(spark, sf).groupBy("site", "page_id", "px").agg(F.count("*").alias("n")))


@query(f"WITH {OBS}, p AS (SELECT site, page_id, radius, count(*) AS n FROM obs GROUP BY ALL) SELECT site, radius, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n) > 10 THEN 'high' WHEN sum(n) > 3 THEN 'medium' ELSE 'low' END AS confidence FROM p GROUP BY ALL")
def merged_radii(spark, sf):
    return merge.radii(observations(spark, sf).groupBy("site", "page_id", "radius").agg(F.count("*").alias("n")).withColumn("confidence", F.lit("low")))


@query(f"WITH {OBS} SELECT site, array_to_string(list_reverse(list_sort(list_distinct(list(px * 16)))), ',') AS breakpoints FROM obs GROUP BY site")
def merged_breakpoints(spark, sf):
    return merge.breakpoints(observations(spark, sf).select("site", (F.col("px") * 16).alias("px")))


@query(f"WITH {OBS} SELECT site, tag, arg_min(hex, struct_pack(a := page_id, b := ord, c := hex)) AS hex FROM obs GROUP BY ALL")
def merged_semantic(spark, sf):
    return merge.first_wins(observations(spark, sf), ["site", "tag"], "hex", ["page_id", "ord", "hex"])


@query("""WITH e AS (SELECT event_type AS context, ['linear', 'ease', 'ease-in', 'ease-out', 'spring'][user_id % 5 + 1] AS easing, CAST(floor(value * 10) AS BIGINT) AS ms FROM events),
m AS (SELECT context, easing, count(*) AS n, min(ms) AS ms FROM e GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, easing) AS rank FROM m QUALIFY rank <= 8""")
def motion_profile(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("linear", "ease", "cubic-bezier(0.7, 0.1, 0.9, 0.5)", "cubic-bezier(0.1, 0.1, 0.9, 0.5)", "cubic-bezier(0.3, 1.4, 0.9, 0.5)"))), (F.col("user_id") % 5 + 1).cast("int"))
    rows = table(spark, sf, "events").select(F.col("event_type").alias("context"), text.easing_class(raw).alias("easing"), F.floor(F.col("value") * 10).alias("ms"))
    return extract.motion(rows)


# ---- drift

def _captures(spark, sf):
    return observations(spark, sf).select("site", F.concat_ws("@", "site", "capture").alias("snapshot_id"), "capture").distinct()


def _counts(spark, sf):
    """site, capture, category, value, num, count: how often each site and month has each colour, spacing, radius, type style
    and shadow. Elements are counted by their own columns; only what was counted is turned into tokens."""
    obs = observations(spark, sf)
    none = F.lit(None).cast("double")
    each = lambda category, value, num: F.struct(F.lit(category).alias("category"), value.alias("value"), num.cast("double").alias("num"))
    colors = obs.groupBy("site", "capture", "hex").agg(F.count("*").alias("count"))
    looks = obs.groupBy("site", "capture", "tag", "width", "px", "radius").agg(F.count("*").alias("count"))
    values = F.array(
        each("spacing", F.col("px").cast("string"), F.col("px")), each("radius", F.col("radius").cast("string"), F.col("radius")),
        each("shadow", F.concat(F.lit("0 "), F.col("width").cast("string"), F.lit("px "), F.col("radius").cast("string"), F.lit("px")), none),
        each("typography", F.concat_ws("/", "tag", (F.col("width") * 100).cast("string"), F.col("px").cast("string")), F.col("px")),
    )
    rows = looks.select("site", "capture", F.explode(values).alias("x"), "count").groupBy("site", "capture", "x.category", "x.value", "x.num").agg(F.sum("count").alias("count"))
    return rows.union(colors.select("site", "capture", F.lit("color"), "hex", none, "count"))


def _tokens(spark, sf, counts=None):
    """Tokens of each site and month: all its colours, spacings, radii, type styles and shadows by use, and a primary.

    Radii and shadows have the confidence of their use.
    """
    rows = (_counts(spark, sf) if counts is None else counts).select(F.concat_ws("@", "site", "capture").alias("snapshot_id"), "category", "value", "num", "count")
    high, medium = F.when(F.col("category") == "radius", 10).otherwise(5), F.when(F.col("category") == "radius", 3).otherwise(2)
    sure = F.when(~F.col("category").isin("radius", "shadow"), "high").when(F.col("count") > high, "high").when(F.col("count") > medium, "medium").otherwise("low")
    ord_ = F.row_number().over(Window.partitionBy("snapshot_id", "category").orderBy(F.desc("count"), "value")).cast("long")
    rows = rows.select("snapshot_id", "category", ord_.alias("ord"), F.when(F.col("category") == "typography", F.substring_index("value", "/", 1)).alias("key"), "value", "num", "count", sure.alias("confidence"))
    primary = (F.col("category") == "color") & (F.col("ord") == 1)
    kinds = F.when(primary, F.array(F.col("category"), F.lit("semantic"))).otherwise(F.array("category"))
    rows = rows.withColumn("category", F.explode(kinds))
    return rows.withColumn("key", F.when(F.col("category") == "semantic", "primary").otherwise(F.col("key")))


CAPTURES = f"{OBS}, cap AS (SELECT DISTINCT site, site || '@' || capture AS snapshot_id, capture FROM obs), pairs AS (SELECT * FROM (SELECT lag(snapshot_id) OVER (PARTITION BY site ORDER BY capture) AS base_id, snapshot_id AS cand_id FROM cap) WHERE base_id IS NOT NULL)"


@query(f"WITH {CAPTURES} SELECT base_id || '>' || cand_id AS pair_id, base_id, cand_id FROM pairs")
def capture_pairs(spark, sf):
    return drift.previous_pairs(_captures(spark, sf))


def _compared(spark, sf):
    counts = cut(_counts(spark, sf))  # captures and tokens come from them: elements are read for nothing else
    captures_ = counts.select("site", F.concat_ws("@", "site", "capture").alias("snapshot_id"), "capture").distinct()
    return drift.compared(drift.previous_pairs(captures_), _tokens(spark, sf, counts))


SHADOW = f"""{CAPTURES}, sh AS (SELECT site || '@' || capture AS snapshot_id, '0 ' || width || 'px ' || radius || 'px' AS value, count(*) AS n FROM obs GROUP BY ALL),
top AS (SELECT snapshot_id, value FROM sh WHERE n > 2),
gone AS (SELECT base_id || '>' || cand_id AS pair_id, 'removed' AS kind, value FROM pairs JOIN top ON snapshot_id = base_id WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.snapshot_id = cand_id AND t.value = top.value)),
new AS (SELECT base_id || '>' || cand_id AS pair_id, 'added' AS kind, value FROM pairs JOIN top ON snapshot_id = cand_id WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.snapshot_id = base_id AND t.value = top.value)),
shadows AS (SELECT * FROM gone UNION ALL SELECT * FROM new)"""


@query(f"WITH {SHADOW} SELECT pair_id, kind, value, count(*) AS n FROM shadows GROUP BY ALL")
def drift_shadows(spark, sf):
    rows = drift.changes(_compared(spark, sf)).where("category = 'shadow'")
    return rows.groupBy("pair_id", "kind", F.coalesce("before", "after").alias("value")).agg(F.count("*").alias("n"))


#: The greedy matching as a recursion over the base tokens of each pair and category: what is free, and what was taken.
FOLD = f"""{LAB}, {SHADOW.removeprefix(OBS + ', ')}, snap AS (SELECT *, site || '@' || capture AS snapshot_id FROM obs),
hx AS (SELECT snapshot_id, hex, count(*) AS n, row_number() OVER (PARTITION BY snapshot_id ORDER BY count(*) DESC, hex) AS ord FROM snap GROUP BY snapshot_id, hex),
tk AS (SELECT snapshot_id, 'color' AS category, ord, '' AS key, hx.hex AS value, 0.0::DOUBLE AS num, 0 AS fw, l, a, bb, CASE WHEN ord = 1 THEN 3.0::DOUBLE ELSE 1 END * sqrt(n) AS w FROM hx JOIN lab ON lab.hex = hx.hex
UNION ALL SELECT snapshot_id, 'spacing', row_number() OVER (PARTITION BY snapshot_id ORDER BY count(*) DESC, px::VARCHAR), '', px::VARCHAR, px, 0, 0, 0, 0, 1 FROM snap GROUP BY snapshot_id, px
UNION ALL SELECT snapshot_id, 'radius', row_number() OVER (PARTITION BY snapshot_id ORDER BY count(*) DESC, radius::VARCHAR), '', radius::VARCHAR, radius, 0, 0, 0, 0, 1 FROM snap GROUP BY snapshot_id, radius HAVING count(*) > 3
UNION ALL SELECT snapshot_id, 'typography', row_number() OVER (PARTITION BY snapshot_id ORDER BY count(*) DESC, tag || '/' || width * 100 || '/' || px), tag, tag || '/' || width * 100 || '/' || px, px, width, 0, 0, 0, 1 FROM snap GROUP BY snapshot_id, tag, width, px),
ptk AS (SELECT base_id || '>' || cand_id AS pair_id, snapshot_id = cand_id AS cand, tk.* FROM pairs JOIN tk ON snapshot_id IN (base_id, cand_id)),
side AS (SELECT pair_id, category, cand, row_number() OVER (PARTITION BY pair_id, category, cand ORDER BY ord) AS i, struct_pack(i := ord, key := key, value := value, num := num, fw := fw, l := l, a := a, bb := bb, w := w) AS t FROM ptk),
grp AS (SELECT pair_id, category, coalesce(list(t ORDER BY i) FILTER (cand), []) AS free, count(*) FILTER (NOT cand) AS nb, coalesce(sum(t.w) FILTER (NOT cand), 0) AS weight, count(*) FILTER (cand) AS nc FROM side GROUP BY ALL),
lim AS (SELECT * FROM (VALUES ('color', 2.3::DOUBLE, 15.0::DOUBLE), ('typography', 0, 3), ('spacing', 4, 25), ('radius', 4, 25)) v(category, same, most)),
fold AS (SELECT pair_id, category, 0::BIGINT AS i, free, NULL::STRUCT(d DOUBLE, i BIGINT) AS best, false AS hit, NULL::STRUCT(i BIGINT, key VARCHAR, value VARCHAR, num DOUBLE, fw BIGINT, l DOUBLE, a DOUBLE, bb DOUBLE, w DOUBLE) AS b, NULL::STRUCT(i BIGINT, key VARCHAR, value VARCHAR, num DOUBLE, fw BIGINT, l DOUBLE, a DOUBLE, bb DOUBLE, w DOUBLE) AS c FROM (SELECT pair_id, category, free FROM grp)
UNION ALL SELECT pair_id, category, i, CASE WHEN hit THEN list_filter(free, lambda x: x.i <> best.i) ELSE free END, best, hit, t, CASE WHEN hit THEN list_filter(free, lambda x: x.i = best.i)[1] END FROM (
SELECT *, coalesce(best.d <= most, false) AS hit FROM (SELECT f.pair_id, f.category, s.i, f.free, s.t, lim.most, list_sort(list_transform(f.free, lambda x: struct_pack(d := CASE f.category
 WHEN 'color' THEN sqrt(pow(s.t.l - x.l, 2) + pow(s.t.a - x.a, 2) + pow(s.t.bb - x.bb, 2))
 WHEN 'typography' THEN CASE WHEN s.t.key = x.key THEN (s.t.fw <> x.fw)::INT + (abs(s.t.num - x.num) / s.t.num * 100 > 4)::INT ELSE 1e300::DOUBLE END
 ELSE CASE WHEN s.t.num = 0 THEN CASE WHEN x.num = 0 THEN 0 ELSE 100 END ELSE abs(s.t.num - x.num) / abs(s.t.num) * 100 END END::DOUBLE, i := x.i)))[1] AS best
FROM fold f JOIN side s ON s.pair_id = f.pair_id AND s.category = f.category AND NOT s.cand AND s.i = f.i + 1 JOIN lim ON lim.category = f.category))),
moved AS (SELECT pair_id, category, CASE WHEN hit THEN 'changed' ELSE 'removed' END AS kind, b, CASE WHEN hit THEN c END AS c, CASE WHEN hit THEN best.d END AS d FROM fold JOIN lim USING (category) WHERE i > 0 AND (NOT hit OR best.d > same)
UNION ALL SELECT pair_id, category, 'added', NULL, unnest(free), NULL FROM fold JOIN (SELECT pair_id, category, nb FROM grp) USING (pair_id, category) WHERE i = nb),
chg AS (SELECT pair_id, category, kind, CASE WHEN category = 'typography' THEN coalesce(b.key, c.key) ELSE coalesce(b.value, c.value) END AS label, b.value AS before, c.value AS after, CASE WHEN category <> 'typography' THEN floor(d * 10 + 0.5) / 10 END AS delta,
 CASE kind WHEN 'added' THEN 0.5::DOUBLE * c.w WHEN 'removed' THEN b.w ELSE CASE category WHEN 'color' THEN d / 15 * b.w WHEN 'typography' THEN least(1.0::DOUBLE, 0.5::DOUBLE * (b.fw <> c.fw)::INT + CASE WHEN abs(b.num - c.num) / b.num * 100 > 4 THEN least(1.0::DOUBLE, abs(b.num - c.num) / b.num * 100 / 25) ELSE 0 END) ELSE d / 25 END END AS penalty, 0.0::DOUBLE AS weight FROM moved
UNION ALL SELECT pair_id, 'shadow', kind, value, CASE WHEN kind = 'removed' THEN value END, CASE WHEN kind = 'added' THEN value END, NULL, CASE WHEN kind = 'removed' THEN 1.0 ELSE 0.5 END, 0 FROM shadows
UNION ALL SELECT pair_id, 'color', 'changed', 'semantic.primary', before, after, floor(d * 10 + 0.5) / 10, CASE WHEN d <= 15 THEN d / 15 * 3 ELSE 3 END, 3 FROM (
 SELECT base_id || '>' || cand_id AS pair_id, b.value AS before, c.value AS after, sqrt(pow(b.l - c.l, 2) + pow(b.a - c.a, 2) + pow(b.bb - c.bb, 2)) AS d FROM pairs JOIN tk b ON b.snapshot_id = base_id AND b.category = 'color' AND b.ord = 1 JOIN tk c ON c.snapshot_id = cand_id AND c.category = 'color' AND c.ord = 1) WHERE d > 2.3::DOUBLE)"""
RATED = f"""{FOLD}, shn AS (SELECT base_id || '>' || cand_id AS pair_id, 'shadow' AS category, count(*) FILTER (snapshot_id = base_id) AS nb, count(*) FILTER (snapshot_id = cand_id) AS nc FROM pairs JOIN top ON snapshot_id IN (base_id, cand_id) GROUP BY ALL),
size AS (SELECT pair_id, category, nb, nc, CASE WHEN category = 'color' THEN weight ELSE nb END AS whole FROM grp UNION ALL SELECT *, nb FROM shn),
every AS (SELECT p.pair_id, c.category, c.weight, coalesce(s.nb, 0) AS nb, coalesce(s.nc, 0) AS nc, coalesce(s.whole, 0) AS whole FROM (SELECT base_id || '>' || cand_id AS pair_id FROM pairs) p, (VALUES ('color', 1.0::DOUBLE), ('typography', 1), ('spacing', 0.8), ('radius', 0.6), ('shadow', 0.6)) c(category, weight) LEFT JOIN size s ON s.pair_id = p.pair_id AND s.category = c.category),
told AS (SELECT pair_id, category, sum(penalty) AS penalty, sum(weight) AS more, max(CASE WHEN kind = 'removed' THEN 0.6::DOUBLE ELSE penalty END) AS peak, count(*) FILTER (kind = 'changed') AS changed, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed FROM chg GROUP BY ALL),
rated0 AS (SELECT e.pair_id, e.category, e.weight, nb + nc > 0 AS comparable, coalesce(changed, 0) AS changed, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, peak, CASE WHEN whole + coalesce(more, 0) > 0 THEN least(1.0::DOUBLE, coalesce(penalty, 0) / (whole + coalesce(more, 0))) WHEN nc > 0 THEN 1 ELSE 0 END AS score FROM every e LEFT JOIN told USING (pair_id, category)),
rated AS (SELECT * EXCLUDE (score, peak), CASE WHEN category = 'typography' THEN greatest(score, 0.5::DOUBLE * coalesce(peak, 0)) ELSE score END AS score FROM rated0),
rep AS (SELECT pair_id, CAST(floor(coalesce(sum(CASE WHEN comparable THEN weight * score END) / sum(CASE WHEN comparable THEN weight END), 0) * 100 + 0.5) AS BIGINT) AS score, CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM rated GROUP BY ALL),
reports AS (SELECT pair_id, score, CASE WHEN score > 10 THEN 'drift' ELSE 'stable' END AS status, changed, added, removed, false AS inconclusive FROM rep)"""


@query(f"WITH RECURSIVE {FOLD} SELECT pair_id, label, kind, before, after FROM chg WHERE label = 'semantic.primary'")
def drift_semantic(spark, sf):
    return drift.changes(_compared(spark, sf)).where("label like 'semantic.%'").select("pair_id", "label", "kind", "before", "after")


@query(f"WITH RECURSIVE {FOLD} SELECT pair_id, category, kind, label, before, after, delta, CAST(floor(penalty * 100000 + 0.5) AS BIGINT) AS penalty FROM chg")
def drift_changes(spark, sf):
    return drift.changes(_compared(spark, sf)).withColumn("penalty", text.scaled(F.col("penalty"), 100000))


@query(f"WITH RECURSIVE {RATED} SELECT pair_id, category, CAST(floor(score * 100000 + 0.5) AS BIGINT) AS score, changed, added, removed, weight, comparable, false AS bad FROM rated")
def drift_categories(spark, sf):
    return drift.categories(_compared(spark, sf)).withColumn("score", text.scaled(F.col("score"), 100000))


@query(f"WITH RECURSIVE {RATED} SELECT * FROM reports")
def drift_reports(spark, sf):
    """Flagship: the drift of every site's month against its month before."""
    return drift.reports(drift.categories(_compared(spark, sf)))


@query(f"""WITH RECURSIVE {RATED}, dr AS (SELECT * FROM reports WHERE status = 'drift'), ch AS (SELECT c.*, floor(delta * 10 + 0.5) / 10 AS d FROM chg c SEMI JOIN dr USING (pair_id)),
ln AS (SELECT pair_id, 0 AS part, NULL::DOUBLE AS delta, '' AS category, '' AS kind, '' AS label, '' AS b, '' AS a, '::error title=Design drift ' || score || ' exceeds threshold 10::' || changed || ' changed, ' || added || ' added, ' || removed || ' removed' AS line FROM dr UNION ALL
SELECT pair_id, 2, delta, category, kind, coalesce(label, ''), coalesce(before, ''), coalesce(after, ''), '::' || CASE WHEN kind = 'added' THEN 'warning' ELSE 'error' END || '::' || coalesce(label, '') || CASE WHEN before <> '' AND after <> '' THEN ' ' || before || ' -> ' || after WHEN before <> '' THEN ' ' || before || ' removed' WHEN after <> '' THEN ' ' || after || ' new' ELSE '' END
  || ' (token-drift:' || category || CASE WHEN delta IS NULL THEN '' ELSE ', delta ' || CASE WHEN d = floor(d) THEN d::BIGINT::VARCHAR ELSE d::VARCHAR END END || ')' FROM ch)
SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY part, delta DESC NULLS LAST, category, kind, label, b, a) AS n, line FROM ln""")
def drift_annotations(spark, sf):
    rows = cut(_compared(spark, sf))
    return drift.annotations(drift.reports(drift.categories(rows)), drift.changes(rows))


@query(f"""WITH RECURSIVE {RATED}, gt AS (SELECT split_part(pair_id, '@', -1) AS run, count(*) AS pages, count(*) FILTER (status = 'drift') AS drifted, 0::BIGINT AS failed FROM reports GROUP BY ALL)
SELECT *, CASE WHEN drifted > 0 THEN 1 ELSE 0 END AS verdict FROM gt""")
def gate_rollup(spark, sf):
    return drift.gate(drift.reports(drift.categories(_compared(spark, sf))), F.substring_index("pair_id", "@", -1))


@query(f"""WITH {CAPTURES}, dg AS (SELECT snapshot_id, unnest(CASE CAST(replace(capture, '-', '') AS INT) % 5 WHEN 0 THEN ['color'] WHEN 1 THEN ['radius', 'shadow'] WHEN 2 THEN ['color'] ELSE [] END) AS category FROM cap) SELECT DISTINCT * FROM dg""")
def degraded_categories(spark, sf):
    k = F.regexp_replace("capture", "-", "").cast("int") % 5
    none = F.array().cast("array<string>")
    degraded = F.when(k == 0, F.array(F.lit("mobile"), F.lit("reveal"))).when(k == 1, F.array(F.lit("shadows"))).otherwise(none)
    errors = F.when(k == 1, F.array(F.lit("borderRadius"))).when(k == 2, F.array(F.lit("colors"), F.lit("unknown"))).otherwise(none)
    return drift.degraded_categories(_captures(spark, sf).select("snapshot_id", degraded.alias("degraded"), errors.alias("errors")))


@query(f"""WITH {CAPTURES}, m AS (SELECT site, snapshot_id, CAST(replace(capture, '-', '') AS INT) AS k FROM cap),
x AS (SELECT base_id || '>' || cand_id AS pair_id, b.k AS bk, c.k AS ck FROM pairs JOIN m b ON b.snapshot_id = base_id JOIN m c ON c.snapshot_id = cand_id)
SELECT pair_id, 'viewport' AS warning FROM x WHERE (bk % 3 = 0) <> (ck % 3 = 0) UNION ALL
SELECT pair_id, 'page' FROM x WHERE (bk % 5 = 0) <> (ck % 5 = 0) UNION ALL
SELECT pair_id, 'dark-mode' FROM x WHERE (bk % 7 = 0) <> (ck % 7 = 0) UNION ALL
SELECT pair_id, 'fonts' FROM x WHERE bk % 11 = 0 OR ck % 11 = 0 UNION ALL
SELECT pair_id, 'degraded' FROM x WHERE bk % 4 = 1 OR ck % 4 = 1""")
def comparison_warnings(spark, sf):
    c = _captures(spark, sf)
    k = F.regexp_replace("capture", "-", "").cast("int")
    www = F.when(k % 2 == 0, "https://www.").otherwise("https://")
    url = F.concat(www, F.col("site").cast("string"), F.lit(".example.com"), F.when(k % 5 == 0, "/fi/").otherwise("/"))
    meta = c.select("snapshot_id", url.alias("url"), F.when(k % 3 == 0, 1280).otherwise(1920).alias("width"), (k % 7 == 0).alias("dark"), F.lit(False).alias("mobile"), (k % 11 != 0).alias("fonts_ready"), F.when(k % 4 == 1, F.array(F.lit("colors"))).otherwise(F.array().cast("array<string>")).alias("degraded"))
    return drift.warnings(drift.previous_pairs(c), meta)


# ---- findings, documents, reports

@query(f"WITH {SPACING} SELECT s.site, s.px FROM spacing s JOIN scale USING (site) WHERE (scale = 'base-8' AND px >= 8 AND px % 8 <> 0) OR (scale = 'base-4' AND px >= 4 AND px % 4 <> 0)")
def off_grid_spacing(spark, sf):
    h = extract.spacing_histogram(observations(spark, sf))
    return audit.off_grid(h, extract.spacing_scale(h))


@query()
def finding_scores(spark, sf):
    obs = observations(spark, sf)
    # few rows each, used more than once: elements are read once for each, and no test on a colour is made for every element
    h, stats = cut(extract.spacing_histogram(obs)), cut(extract.color_statistics(obs))
    styles = cut(extract.type_styles(type_observations(spark, sf)))
    return audit.finding_scores(obs.select("site").distinct(), audit.near_identical(extract.palette(stats)), audit.hierarchy_collisions(styles), audit.off_grid(h, extract.spacing_scale(h)), extract.primary_colors(stats))


# ---- colours from beside the scan

INJECTED = f"""{PALETTE}, rgb AS (SELECT DISTINCT hex, {CH} FROM obs), hue AS (SELECT hex, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo FROM rgb),
tint AS (SELECT hex, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS sat, CASE WHEN hi = lo OR (hi + lo) / 2 < 0.08 OR (hi + lo) / 2 > 0.92 THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS chroma FROM hue),
src AS (SELECT 0 AS rank, site, row_number() OVER (PARTITION BY site ORDER BY n DESC, hex) AS ord, hex, n, confidence, 'scan' AS said FROM palette UNION ALL
SELECT 1, site, 0, min(hex), 10, 'high', 'manifest:theme_color' FROM obs GROUP BY site UNION ALL SELECT 1, site, 1, max(hex), 10, 'high', 'manifest:background_color' FROM obs GROUP BY site UNION ALL
SELECT 2, site, min(page_id * 10 + ord), hex, 10, 'high', 'logo' FROM obs WHERE px = 50 GROUP BY site, hex UNION ALL
SELECT 3, site, min(page_id * 10 + ord), hex, 2, 'low', 'gradient' FROM obs JOIN tint USING (hex) WHERE radius = 12 AND chroma >= 0.2 GROUP BY site, hex HAVING count(*) >= 2 UNION ALL
SELECT 4, site, page_id * 10 + ord, hex, 1, 'medium', 'hover/focus' FROM obs JOIN tint USING (hex) WHERE px = 1 AND (ord % 2 = 0 OR sat <= 0.3::DOUBLE) UNION ALL
SELECT 5, site, min(page_id * 10 + ord), hex, count(*), 'low', 'dark' FROM obs WHERE px = 25 GROUP BY site, hex UNION ALL SELECT 7, site, min(page_id * 10 + ord), hex, count(*), 'medium', 'menu' FROM obs GROUP BY site, hex),
won AS (SELECT site, hex, arg_min(struct_pack(rank := rank, ord := ord, n := n, confidence := confidence, said := said), struct_pack(a := rank, b := ord)) AS m, bool_or(rank IN (1, 2)) AS lifted, bool_or(rank = 2) AS logo, list(said ORDER BY ord) FILTER (rank = 1) AS labels FROM src GROUP BY site, hex)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY m.rank, m.ord, hex) AS ord, hex, m.n AS n, CASE WHEN lifted THEN 'high' ELSE m.confidence END AS confidence,
CASE WHEN logo AND m.said <> 'logo' THEN 'logo,' ELSE '' END || array_to_string(CASE WHEN m.rank = 1 THEN labels ELSE list_concat([m.said], coalesce(labels, [])) END, ',') AS sources, CASE m.rank WHEN 5 THEN 'dark-mode' WHEN 7 THEN 'menu' END AS variant FROM won"""


@query(f"WITH {INJECTED}")
def injected_palettes(spark, sf):
    """The palette of each site with what manifest, logos, gradients, states, the dark page and the menu add."""
    obs = observations(spark, sf).withColumn("at", F.col("page_id") * 10 + F.col("ord"))
    scan = _palette(spark, sf).withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "hex"))).withColumn("sources", F.array(F.lit("scan")))
    said = lambda rows: rows.groupBy("site", "hex").agg(F.min("at").alias("ord"), F.count("*").alias("n")).withColumnRenamed("hex", "value")
    edge = obs.groupBy("site").agg(F.min("hex").alias("theme_color"), F.max("hex").alias("background_color"))
    manifest = edge.select("site", F.posexplode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in ("theme_color", "background_color")))).alias("ord", "m")).select("site", "ord", "m.label", "m.value")
    states = obs.where("px = 1").select("site", F.col("at").alias("ord"), F.col("hex").alias("value"), F.when(F.col("ord") % 2 == 0, "background-color").otherwise("color").alias("property"))
    shown = lambda rows, word: said(rows).select("site", "ord", F.col("value").alias("hex"), "n", F.lit("low").alias("confidence"), F.array(F.lit(word)).alias("sources"))
    out = inject.injected(
        inject.from_scan(scan), inject.from_manifest(manifest), inject.from_logos(said(obs.where("px = 50"))), inject.from_gradients(said(obs.where("radius = 12"))), inject.from_states(states),
        inject.from_scan(shown(obs.where("px = 25"), "dark"), inject.DARK), inject.from_scan(shown(obs, "menu"), inject.MENU))
    return out.select("site", "ord", "hex", "n", "confidence", F.array_join("sources", ",").alias("sources"), "variant")


def _part(h: str, k: int) -> str:
    v = f"round(CAST('0x' || substr({h}, {k}, 2) AS INT) / 255.0::DOUBLE, 3)"
    return f"(CASE WHEN {v} = floor({v}) THEN ({v})::BIGINT::VARCHAR ELSE ({v})::VARCHAR END)"


def _hex_json(h: str) -> str:
    return f"""('{{"colorSpace":"srgb","components":[' || {_part(h, 2)} || ',' || {_part(h, 4)} || ',' || {_part(h, 6)} || '],"hex":"' || {h} || '"}}')"""


def _px_json(v: str) -> str:
    return f"""('{{"value":' || {v} || ',"unit":"px"}}')"""


TOKENS = f"""{PALETTE}, {STYLES}, sp AS (SELECT site, px, count(*) AS n FROM obs WHERE px > 0 GROUP BY ALL), rd AS (SELECT site, radius, count(*) AS n FROM obs GROUP BY ALL HAVING n > 3),
pk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, hex) AS k FROM palette WHERE confidence <> 'low' QUALIFY k <= 30),
ts AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY first, context, family, size, weight) AS k FROM styles QUALIFY k <= 10),
bc AS (SELECT site, hex, CASE WHEN width > 2 THEN 'dashed' ELSE 'solid' END AS style, width, count(*) AS n FROM obs GROUP BY ALL HAVING n > 3), b10 AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, hex, style, width) AS k FROM bc QUALIFY k <= 10),
bw AS (SELECT site, width, row_number() OVER (PARTITION BY site ORDER BY min(k)) AS k FROM b10 GROUP BY site, width), bh AS (SELECT site, hex, row_number() OVER (PARTITION BY site ORDER BY min(k)) AS k FROM b10 GROUP BY site, hex),
sh AS (SELECT site, width, radius, hex, count(*) AS n FROM obs GROUP BY ALL HAVING n > 2), s6 AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, '0px ' || width || 'px ' || radius || 'px ' || hex) AS k FROM sh QUALIFY k <= 6),
tokens AS (SELECT site, 'color.semantic.first-colour' AS path, 'color' AS type, {_hex_json("hex")} AS value FROM pk WHERE k = 1 UNION ALL SELECT site, 'color.palette.palette-' || k, 'color', {_hex_json("hex")} FROM pk UNION ALL
SELECT site, 'typography.font-family.' || lower(replace(family, ' ', '-')), 'fontFamily', '"' || family || '"' FROM styles GROUP BY site, family UNION ALL
SELECT site, 'typography.style.text-' || context, 'typography', arg_max('{{"fontFamily":"{{typography.font-family.' || lower(replace(family, ' ', '-')) || '}}","fontSize":' || {_px_json("size")} || ',"fontWeight":' || weight || ',"lineHeight":1.5,"letterSpacing":{{"value":0,"unit":"px"}}}}', k) FROM ts GROUP BY site, context UNION ALL
SELECT site, 'spacing.spacing-' || k, 'dimension', {_px_json("px")} FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, px) AS k FROM sp QUALIFY k <= 12) UNION ALL
SELECT site, 'radius.radius-' || k, 'dimension', {_px_json("radius")} FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, radius) AS k FROM rd QUALIFY k <= 6) UNION ALL
SELECT site, 'border.width.border-width-' || k, 'dimension', {_px_json("width")} FROM bw UNION ALL SELECT site, 'border.color.border-color-' || k, 'color', {_hex_json("hex")} FROM bh UNION ALL
SELECT site, 'shadow.shadow-' || k, 'shadow', '{{"offsetX":' || {_px_json("0")} || ',"offsetY":' || {_px_json("width")} || ',"blur":' || {_px_json("radius")} || ',"spread":' || {_px_json("0")} || ',"color":' || {_hex_json("'#000000'")} || '}}' FROM s6)"""


def _sections(spark, sf) -> list[DataFrame]:
    obs = observations(spark, sf)
    palette, styles = _palette(spark, sf), extract.type_styles(type_observations(spark, sf))
    channel = lambda k: F.conv(F.substring("hex", k, 2), 16, 10)
    first = extract.top(palette.where("confidence <> 'low'"), ["site"], [F.desc("n"), "hex"], 1)
    roles = first.select("site", F.lit("First.Colour").alias("role"), F.lit(0).alias("ord"), F.concat(F.lit("rgb("), channel(2), F.lit(", "), channel(4), F.lit(", "), channel(6), F.lit(")")).alias("value"))
    return [
        exports.semantic(roles), exports.colors(palette), exports.families(styles), exports.text_styles(styles), exports.spacings(extract.spacing_histogram(obs).drop("rank")),
        exports.radii(extract.radius_histogram(obs)), exports.borders(extract.border_combinations(obs)), exports.shadows(extract.shadow_histogram(obs))]


def _document(spark, sf):
    out = None
    for rows in _sections(spark, sf):
        own = rows.select("site", F.array_join("path", ".").alias("path"), "type", "value")
        out = own if out is None else out.union(own)
    return out


@query(f"WITH {TOKENS} SELECT * FROM tokens")
def design_token_document(spark, sf):
    return _document(spark, sf)


@query(f"WITH {TOKENS} SELECT site, type, count(*) AS n FROM tokens GROUP BY ROLLUP (site, type)")
def report_counts(spark, sf):
    return audit.report_counts(_document(spark, sf))


@query(f"WITH {TOKENS} SELECT site AS doc_id, path, type, CASE WHEN type = 'fontFamily' THEN replace(value, '\"', '') ELSE value END AS value FROM tokens")
def exported_documents(spark, sf):
    """The assembled documents, flattened again."""
    return documents_of.flatten(exports.documents(*_sections(spark, sf)))


@query(f"""WITH {OBS}, t AS (SELECT DISTINCT site AS doc_id, CAST(px AS INT) AS k FROM obs)
SELECT doc_id, 'a.' || k AS path, '1px' AS value, 'ok' AS state FROM t WHERE list_contains(range(k - k % 5, k + 1), k) AND (SELECT count(*) FROM t u WHERE u.doc_id = t.doc_id AND u.k BETWEEN t.k - t.k % 5 AND t.k) = t.k % 5 + 1""")
def resolved_aliases(spark, sf):
    k = F.col("px").cast("int")
    rows = observations(spark, sf).select(F.col("site").alias("doc_id"), k.alias("k")).distinct()
    tokens = rows.select("doc_id", F.concat(F.lit("a."), F.col("k").cast("string")).alias("path"), F.when(F.col("k") % 5 == 0, "1px").otherwise(F.concat(F.lit("{a."), (F.col("k") - 1).cast("string"), F.lit("}"))).alias("value"))
    return audit.resolve_aliases(tokens).where("state = 'ok'")


@query(f"""WITH {PALETTE}, c AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, hex) AS rank FROM palette QUALIFY rank <= 24), nm AS (SELECT *, row_number() OVER (PARTITION BY site, role ORDER BY rank) AS nth FROM c),
sp AS (SELECT site, px, count(*) AS n FROM obs WHERE px > 0 GROUP BY ALL), s20 AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, px) AS k FROM sp QUALIFY k <= 20), s8 AS (SELECT *, max(n) OVER (PARTITION BY site) AS most FROM s20), s9 AS (SELECT * FROM s8 WHERE n >= 0.2::DOUBLE * most QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, px) <= 8)
SELECT site, 'color' AS section, rank AS ord, CASE WHEN nth = 1 THEN role ELSE role || '-' || nth END AS name, hex AS value FROM nm UNION ALL SELECT site, 'spacing', row_number() OVER (PARTITION BY site ORDER BY px), (row_number() OVER (PARTITION BY site ORDER BY px))::VARCHAR, px || 'px' FROM s9""")
def theme_tokens(spark, sf):
    return audit.theme_tokens(_palette(spark, sf), extract.spacing_histogram(observations(spark, sf)))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'legacy' ELSE 'unknown' END
WHEN o_orderkey % 4 = 2 THEN CASE WHEN o_custkey % 10 = 3 THEN 'current' ELSE 'compatible' END WHEN o_orderkey % 4 < 2 THEN 'outdated' ELSE 'ahead' END AS status FROM orders""")
def schema_status(spark, sf):
    o = table(spark, sf, "orders")
    found = F.when(F.col("o_orderkey") % 5 != 0, F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit("."), (F.col("o_custkey") % 10).cast("string"), F.lit(".0")))
    return o.select(F.col("o_orderkey").alias("id"), text.compatibility(found, F.when(F.col("o_custkey") % 2 == 0, "0.22.0"), "2.3.0").alias("status"))


# ---- landed pages

@query("""WITH l AS (SELECT page_id, html, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS path, array_to_string(regexp_extract_all(html, '(?s)<(?:nav|header|footer)[ >].*?</(?:nav|header|footer)>'), '') AS nav FROM pages),
m AS (SELECT page_id, path, max(CASE WHEN list_contains(regexp_extract_all(nav, '<a href="([^"]*)"', 1), path) THEN 2 ELSE 1 END) AS place FROM l WHERE path LIKE '/%' AND path <> '/' GROUP BY ALL),
s AS (SELECT page_id, path, place, CASE WHEN regexp_matches(lower(path), '/(login|signin|sign-in|signup|sign-up|register|auth)|/(terms|privacy|legal|cookie|gdpr|tos)|/(cdn-cgi|wp-admin|wp-content|wp-json)|\\.(pdf|jpg|jpeg|png|gif|svg|webp|zip|tar|gz|mp4|mp3)$|/tag/|/author/|/page/[0-9]+|\\?') THEN -1
 ELSE 100 - 10 * (length(path) - length(replace(path, '/', ''))) + CASE WHEN regexp_matches(lower(path), '^/(pricing|plans?|cost)') THEN 30 WHEN regexp_matches(lower(path), '^/(about|company|team|story)') THEN 25 WHEN regexp_matches(lower(path), '^/(product|features?|solutions?)') THEN 25
 WHEN regexp_matches(lower(path), '^/(enterprise|business|platform)') THEN 20 WHEN regexp_matches(lower(path), '^/(contact|demo|trial|start)') THEN 20 WHEN regexp_matches(lower(path), '^/(docs|documentation|developers?|api)') THEN 15 WHEN regexp_matches(lower(path), '^/(blog|resources|insights|news)') THEN 10 ELSE 0 END END AS base FROM m)
SELECT page_id, path, CAST(base + 5 * place AS BIGINT) AS score, row_number() OVER (PARTITION BY page_id ORDER BY base + 5 * place DESC, path) AS rank FROM s WHERE base >= 0 QUALIFY rank <= 20""")
def page_links(spark, sf):
    return page_ops.links(table(spark, sf, "pages"))


@query("""WITH t AS (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t, html FROM pages), u AS (SELECT page_id, trim(string_split_regex(t, '[|–—·]')[1]) AS t FROM t)
SELECT page_id, CASE WHEN length(t) BETWEEN 2 AND 39 THEN t END AS name FROM u""")
def site_names(spark, sf):
    return page_ops.site_names(table(spark, sf, "pages"))


@query("""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www[.]', '') AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages)
SELECT page_id, host || regexp_replace(CASE WHEN p = '' THEN '/' ELSE p END, '/+$', '') AS identity FROM p""")
def page_identity(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.page_identity(F.col("url")).alias("identity"))


@query("""SELECT page_id, 'plain-ads' AS mark, CAST((length(html) - length(replace(html, 'class="ad"', ''))) // 10 AS BIGINT) AS n FROM pages WHERE html LIKE '%class="ad"%'""")
def page_fingerprints(spark, sf):
    return page_ops.fingerprints(table(spark, sf, "pages"))


@query("""SELECT page_id, 'p' AS selector, 'margin' AS property, '0' AS value FROM pages WHERE html LIKE '%<style>p{margin:0}</style>%'""")
def page_css_rules(spark, sf):
    return page_ops.css_rules(table(spark, sf, "pages")).drop("ord")


@query()
def page_elements(spark, sf):
    """Elements per page and tag, with the deepest place of each."""
    return page_ops.elements(table(spark, sf, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query("""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www[.]', '') AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, CASE WHEN path = '' THEN '/' ELSE path END AS path, NOT (path LIKE '/fr/%' OR path LIKE '/de/%') OR path LIKE '/fr/1%' OR path LIKE '/de/%1' AS allowed FROM p""")
def robots_verdicts(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", text.host(F.col("url")).alias("host"), text.path(F.col("url")).alias("path"))
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\n# comment\nDisallow: /fr/\nAllow: /fr/1\nDisallow: /de/\nAllow: /de/*1$\n"
    return page_ops.robots_allowed(urls, page_ops.robots_rules(urls.select("host").distinct().withColumn("body", F.lit(body))))


@query("""SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 2, 4, 6, 7) THEN 'retryable' ELSE 'failure' END AS class FROM events""")
def crawl_error_classes(spark, sf):
    said = semantics._pick(semantics.SAID, F.col("event_id") % 10)
    return table(spark, sf, "events").select("event_id", text.crawl_error(said).alias("class"))


# ---- timelines

def _usage(spark, sf):
    return table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("site"), F.col("event_type").alias("token"), F.floor(F.col("value") * 100).alias("value"))


@query("SELECT date_trunc('hour', ts) AS start, event_type AS token, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def usage_timeline(spark, sf):
    out = captures.timeline(_usage(spark, sf))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id AS site, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY site ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT site, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY site, k""")
def capture_sessions(spark, sf):
    out = captures.sessions(_usage(spark, sf))
    return out.select("site", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# ---- brand colours

@query()
def brand_colors(spark, sf):
    """The most likely brand colour of each site, by a model fitted on what buttons and links have as background: whether a
    colour is the most frequent one there, which is none of the model's features."""
    obs = observations(spark, sf)
    used = obs.where("tag in ('BUTTON', 'A')").groupBy("site", "hex").agg(F.count("*").alias("uses"))
    first = used.groupBy("site").agg(F.min_by("hex", F.struct(-F.col("uses"), "hex")).alias("hex")).withColumn("label", F.lit(1.0))
    rows = brand.candidates(extract.color_statistics(obs)).join(first, ["site", "hex"], "left").fillna(0.0, ["label"])
    return brand.best(brand.fit(rows).transform(rows))


@query(f"WITH {STATS} SELECT site, hex, CAST(floor(sat * 1000 + 0.5) AS BIGINT) AS sat, CAST(floor(lum * 100000 + 0.5) AS BIGINT) AS lum, CAST(floor(bg / n::DOUBLE * 1000 + 0.5) AS BIGINT) AS bg_share FROM cs")
def brand_features(spark, sf):
    rows = brand.candidates(extract.color_statistics(observations(spark, sf)))
    return rows.select("site", "hex", text.scaled(F.col("sat")).alias("sat"), text.scaled(F.col("lum"), 100000).alias("lum"), text.scaled(F.col("bg_share")).alias("bg_share"))


# ---- roles

HSL = """CASE WHEN greatest(r, g, b) = least(r, g, b) OR greatest(r, g, b) + least(r, g, b) < 0.16 * 255 OR greatest(r, g, b) + least(r, g, b) > 1.84 * 255 THEN 0.0::DOUBLE WHEN greatest(r, g, b) + least(r, g, b) > 255 THEN (greatest(r, g, b) - least(r, g, b)) / (510.0::DOUBLE - greatest(r, g, b) - least(r, g, b))
 ELSE (greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + least(r, g, b))::DOUBLE END AS c, CASE WHEN greatest(r, g, b) = least(r, g, b) THEN -1.0::DOUBLE WHEN r >= greatest(g, b) THEN ((g - b) / (r - least(g, b))::DOUBLE + CASE WHEN g < b THEN 6 ELSE 0 END) * 60
 WHEN g >= b THEN ((b - r) / (g - least(r, b))::DOUBLE + 2) * 60 ELSE ((r - g) / (b - least(r, g))::DOUBLE + 4) * 60 END AS hue"""


@query(f"""WITH {STATS}, hs AS (SELECT hex, {HSL} FROM (SELECT DISTINCT hex, r, g, b FROM ch)), {PALETTE[len(STATS) + 2:]}, q AS (SELECT p1.site, p1.hex, n, confidence, is_token, c, hue FROM p1 JOIN hs USING (hex)),
cta AS (SELECT DISTINCT site, hex FROM obs WHERE tag = 'BUTTON' AND is_bg AND px > 48), nm AS (SELECT site, arg_min(hex, struct_pack(a := c, b := hex)) AS named FROM q WHERE site % 2 = 0 GROUP BY site),
k AS (SELECT q.*, EXISTS (SELECT 1 FROM cta WHERE cta.site = q.site AND cta.hex = q.hex) AS cta FROM q),
one AS (SELECT site, hex FROM k WHERE confidence <> 'low' AND c > 0.15 QUALIFY row_number() OVER (PARTITION BY site ORDER BY n + CASE WHEN is_token THEN 20 ELSE 0 END DESC, round(c, 12) DESC, hex) = 1),
two AS (SELECT site, hex FROM k WHERE c > 0.25 AND (is_token OR cta) QUALIFY row_number() OVER (PARTITION BY site ORDER BY n + CASE WHEN is_token THEN 20 ELSE 0 END + CASE WHEN cta THEN 20 ELSE 0 END DESC, round(c, 12) DESC, hex) = 1),
f AS (SELECT s.site, coalesce(named, one.hex) AS hex, two.hex AS strong FROM (SELECT DISTINCT site FROM k) s LEFT JOIN nm ON nm.site = s.site LEFT JOIN one ON one.site = s.site LEFT JOIN two ON two.site = s.site),
pr AS (SELECT f.site, CASE WHEN c < 0.12 THEN coalesce(strong, f.hex) ELSE f.hex END AS prim FROM f LEFT JOIN hs ON hs.hex = f.hex), pm AS (SELECT pr.*, hue AS mine FROM pr LEFT JOIN hs ON hs.hex = prim),
ac AS (SELECT k.site, k.hex FROM k JOIN pm USING (site) WHERE confidence <> 'low' AND c > 0.25 AND hex <> prim AND (mine < 0 OR least(abs(hue - mine), 360 - abs(hue - mine)) > 30) QUALIFY row_number() OVER (PARTITION BY k.site ORDER BY round(c, 12) DESC, hex) = 1)
SELECT pm.site, prim AS "primary", ac.hex AS accent FROM pm LEFT JOIN ac USING (site)""")
def primary_and_accent(spark, sf):
    """Elements of every second site name the dullest colour of its palette as its primary."""
    obs = observations(spark, sf)
    stats = extract.color_statistics(obs)
    palette = extract.palette(stats).select("site", "hex", "n", "confidence").join(stats.select("site", "hex", "is_token"), ["site", "hex"]).withColumn("ord", F.lit(0))
    dull = palette.where("site % 2 = 0").groupBy("site").agg(F.min_by("hex", F.struct(color.chroma(F.col("hex")), "hex")).alias("hex"))
    return roles.primary_and_accent(palette, obs.where("tag = 'BUTTON' and is_bg and px > 48"), dull)


ROLE = f"""{PALETTE}{LAB[len(OBS):]}, cand AS (SELECT site, 0 AS source, -n AS ord, hex, confidence FROM palette UNION ALL SELECT site, CASE tag WHEN 'BUTTON' THEN 1 ELSE 2 END, ord, hex, NULL FROM obs WHERE tag IN ('BUTTON', 'A') AND px > 48),
sem AS (SELECT site, CASE site % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'background' WHEN 2 THEN 'accent' ELSE 'on-surface' END AS role, min(hex) AS hex FROM obs WHERE site % 5 < 4 GROUP BY site),
su AS (SELECT site, bool_or(source = 0 AND confidence IN ('high', 'medium')) AS s FROM cand GROUP BY site), once AS (SELECT cand.site, hex, min(struct_pack(a := source, b := ord)) FILTER (source > 0 OR NOT s OR confidence IN ('high', 'medium')) AS first, max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS lev FROM cand JOIN su USING (site) GROUP BY ALL),
rk AS (SELECT once.site, once.hex, first, (greatest(r, g, b) / 255.0::DOUBLE - least(r, g, b) / 255.0::DOUBLE) * 100 + lev AS rank, 0.2126::DOUBLE * (r / 255.0::DOUBLE) + 0.7152::DOUBLE * (g / 255.0::DOUBLE) + 0.0722::DOUBLE * (b / 255.0::DOUBLE) AS lu FROM once JOIN (SELECT DISTINCT hex, r, g, b FROM h) hh ON hh.hex = once.hex WHERE first IS NOT NULL),
{_leaders('rank DESC, first, c.hex', 'rk')}, kp AS (SELECT rk.*, row_number() OVER (PARTITION BY rk.site ORDER BY rank DESC, first) AS i1 FROM rk JOIN led ON led.site = rk.site AND led.hex = rk.hex AND led.hex = led.leader AND i > 0),
r0 AS (SELECT k.site, list(k.hex ORDER BY i1) AS br, list(k.hex ORDER BY lu, i1) AS bl, any_value(s.role) AS srole, any_value(s.hex) AS shex FROM kp k LEFT JOIN sem s ON s.site = k.site GROUP BY k.site),
r1 AS (SELECT *, CASE WHEN srole = 'primary' THEN shex ELSE list_filter(br, lambda x: x IS DISTINCT FROM shex)[1] END AS p FROM r0), r2 AS (SELECT *, list_filter(br, lambda x: x IS DISTINCT FROM shex AND x IS DISTINCT FROM p)[1] AS q FROM r1),
r3 AS (SELECT *, list_filter(list_reverse(bl), lambda x: x IS DISTINCT FROM shex AND x IS DISTINCT FROM p AND x IS DISTINCT FROM q)[1] AS t FROM r2), r4 AS (SELECT *, CASE WHEN srole = 'on-surface' THEN shex ELSE list_filter(bl, lambda x: x IS DISTINCT FROM shex AND x IS DISTINCT FROM p AND x IS DISTINCT FROM q AND x IS DISTINCT FROM t)[1] END AS o FROM r3),
roles AS (SELECT * FROM (SELECT site, unnest([1, 2, 3, 4, 5]::BIGINT[]) AS ord, unnest(['primary', 'secondary', 'tertiary', 'surface', 'on-surface']) AS role, unnest([p, q, CASE WHEN srole = 'accent' THEN shex END, coalesce(t, CASE WHEN srole = 'background' THEN shex END), o]) AS hex FROM r4) WHERE hex IS NOT NULL)"""


def _color_roles(spark, sf):
    obs = observations(spark, sf)
    used = obs.where("tag in ('BUTTON', 'A') and px > 48").select("site", F.when(F.col("tag") == "BUTTON", 1).otherwise(2).alias("source"), "ord", "hex", F.lit(None).cast("string").alias("confidence"))
    names = F.when(F.col("site") % 5 == 0, "primary").when(F.col("site") % 5 == 1, "background").when(F.col("site") % 5 == 2, "accent").otherwise("on-surface")
    named = obs.where("site % 5 < 4").groupBy("site").agg(F.min("hex").alias("hex")).withColumn("role", names)
    return roles.color_roles(_palette(spark, sf).select("site", F.lit(0).alias("source"), (-F.col("n")).alias("ord"), "hex", "confidence").union(used), named)


@query(f"WITH RECURSIVE {ROLE} SELECT * FROM roles")
def color_roles(spark, sf):
    return _color_roles(spark, sf)


@query(f"""WITH RECURSIVE {ROLE}, rd AS (SELECT site, ['sm', 'md', 'lg', 'xl'][CAST(row_number() OVER (PARTITION BY site ORDER BY radius) AS BIGINT)] AS name, radius FROM (SELECT DISTINCT site, radius FROM obs WHERE radius > 2) QUALIFY row_number() OVER (PARTITION BY site ORDER BY radius) <= 4),
rn AS (SELECT * FROM rd UNION ALL SELECT DISTINCT site, 'none', 0 FROM obs WHERE radius = 2),
cp AS (SELECT site, CASE WHEN tag = 'BUTTON' THEN 'button' ELSE 'input' END AS kind, page_id * 10 + ord AS pos, hex, px, CASE WHEN radius = 2 THEN 0 ELSE radius END AS radius FROM obs WHERE tag IN ('BUTTON', 'P')),
fc AS (SELECT site, kind, arg_min(struct_pack(hex := hex, px := px, radius := radius), struct_pack(a := pos, h := hex, r := radius, p := px)) AS x FROM cp GROUP BY ALL), ro AS (SELECT site, hex, arg_min(role, ord) AS role FROM roles GROUP BY ALL)
SELECT fc.site, kind || '-observed' AS name, coalesce('{{colors.' || ro.role || '}}', x.hex) AS background, '#ffffff' AS color, coalesce('{{rounded.' || rn.name || '}}', x.radius || 'px') AS rounded, x.px || 'px' AS padding FROM fc LEFT JOIN ro ON ro.site = fc.site AND ro.hex = x.hex LEFT JOIN rn ON rn.site = fc.site AND rn.radius = x.radius""")
def component_tokens(spark, sf):
    obs = observations(spark, sf)
    radius = F.when(F.col("radius") == 2, 0).otherwise(F.col("radius"))
    found = obs.where("tag in ('BUTTON', 'P')").select("site", F.when(F.col("tag") == "BUTTON", "button").otherwise("input").alias("kind"), (F.col("page_id") * 10 + F.col("ord")).alias("ord"), F.col("hex").alias("background"), F.lit("#FFFFFF").alias("foreground"), radius.alias("radius"), F.col("px").alias("padding"))
    return roles.component_tokens(found, _color_roles(spark, sf), roles.rounded_names(obs.select("site", radius.alias("px"))))


@query(f"WITH {OBS} SELECT site, row_number() OVER (PARTITION BY site ORDER BY px) AS ord, ['xs', 'sm', 'md', 'lg', 'xl', 'xxl', 'xxxl', 'xxxxl'][CAST(row_number() OVER (PARTITION BY site ORDER BY px) AS BIGINT)] AS name, px FROM (SELECT DISTINCT site, px FROM obs WHERE px > 0) QUALIFY row_number() OVER (PARTITION BY site ORDER BY px) <= 8")
def spacing_names(spark, sf):
    return roles.named_sizes(observations(spark, sf).where("px > 0"), roles.SPACINGS)


# ---- names

@query(f"""WITH RECURSIVE {PALETTE}{LAB[len(OBS):]}, sm AS (SELECT site, CAST(CASE tag WHEN 'H1' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS BIGINT) AS ord, CASE tag WHEN 'H1' THEN 'primary' WHEN 'P' THEN 'Brand 2' ELSE '9 link' END AS said, min(hex) AS hex FROM obs WHERE tag IN ('H1', 'P', 'A') GROUP BY ALL),
al AS (SELECT site, 0 AS source, ord, hex, said FROM sm UNION ALL SELECT site, 1, -n, hex, NULL FROM palette WHERE confidence <> 'low' AND n % 7 > 0), oc AS (SELECT site, hex, min(struct_pack(source := source, ord := ord, said := said)) AS first FROM al GROUP BY ALL), {_leaders('first, c.hex', 'oc')},
va AS (SELECT site, hex, arg_min(['v0', 'v1', 'v1-2', 'c-'][CAST(px % 4 AS BIGINT) + 1], struct_pack(a := page_id * 10 + ord, b := px % 4)) AS vn FROM obs WHERE px > 47 GROUP BY ALL),
sh AS (SELECT oc.site, oc.hex, first, coalesce(first.said, CASE WHEN first.source = 1 THEN vn END) AS own, vn, row_number() OVER (PARTITION BY oc.site ORDER BY first, oc.hex) AS ord FROM oc JOIN led ON led.site = oc.site AND led.hex = oc.hex AND led.hex = leader AND i > 0 LEFT JOIN va ON va.site = oc.site AND va.hex = oc.hex QUALIFY ord <= 24),
nb AS (SELECT site, hex, ord, '--color-' || CASE own WHEN 'Brand 2' THEN 'brand-2' WHEN '9 link' THEN 'n9-link' WHEN 'c-' THEN 'c' ELSE coalesce(own, 'brand-' || count(*) FILTER (own IS NULL) OVER (PARTITION BY site ORDER BY ord)) END AS base, CASE WHEN first.said IS NOT NULL THEN 'semantic' WHEN vn IS NOT NULL THEN 'css variable' ELSE 'palette' END AS source FROM sh),
un AS (SELECT DISTINCT site, 0::BIGINT AS ord, []::VARCHAR[] AS used, NULL::VARCHAR AS name, NULL::VARCHAR AS hex, NULL::VARCHAR AS source FROM nb
UNION ALL SELECT site, ord, list_append(used, made), made, hex, source FROM (SELECT u.site, nb.ord, used, nb.hex, nb.source, CASE WHEN list_contains(used, base) THEN base || '-' || list_filter(range(2, 30), lambda k: NOT list_contains(used, base || '-' || k))[1] ELSE base END AS made FROM un u JOIN nb ON nb.site = u.site AND nb.ord = u.ord + 1))
SELECT site, ord, name, hex, source FROM un WHERE ord > 0""")
def theme_colors(spark, sf):
    obs = observations(spark, sf)
    at = F.when(F.col("tag") == "H1", 0).when(F.col("tag") == "P", 1).otherwise(2)
    semantic = obs.where("tag in ('H1', 'P', 'A')").groupBy("site", at.alias("ord")).agg(F.min("hex").alias("hex")).withColumn("role", F.element_at(F.array(*map(F.lit, ("primary", "Brand 2", "9 link"))), F.col("ord") + 1))
    palette = _palette(spark, sf).select("site", (-F.col("n")).alias("ord"), "hex", "confidence", (F.col("n") % 7 == 0).alias("is_variant"))
    names = F.element_at(F.array(*map(F.lit, ("--color-v0", "--colors-v1", "v1-2", "--c-"))), (F.col("px") % 4 + 1).cast("int"))
    variables = obs.where("px > 47").select("site", (F.col("page_id") * 10 + F.col("ord")).alias("ord"), F.when(F.col("px") % 4 == 3, "--color-c-").otherwise(names).alias("name"), "hex")
    return naming.theme_colors(semantic, palette, variables)


# ---- fault isolation

STAGES = {"palette": "array<struct<hex: string, n: bigint>>", "spacing": "array<bigint>", "styles": "array<struct<tag: string, size: bigint>>"}


def _captured_documents(spark, sf):
    """A JSON document a site and month; every fifth site's palettes, spacings, styles or whole documents are broken."""
    each = observations(spark, sf).groupBy("site", "capture").agg(
        F.to_json(F.array_sort(F.collect_set(F.struct("hex", F.lit(1).alias("n"))))).alias("palette"), F.to_json(F.array_sort(F.collect_set("px"))).alias("spacing"), F.to_json(F.array_sort(F.collect_set(F.struct("tag", F.col("px").alias("size"))))).alias("styles"))
    broken = {"palette": (0, '"boom"'), "spacing": (1, '[8, "boom"]'), "styles": (2, '{"tag": "P"}')}
    part = lambda c: F.concat(F.lit(f'"{c}": '), F.when(F.col("site") % 5 == broken[c][0], broken[c][1]).otherwise(F.col(c)))
    end = F.when(F.col("site") % 5 == 3, "").otherwise("}")
    return each.select("site", "capture", F.concat(F.lit("{"), F.concat_ws(", ", *map(part, broken)), end).alias("json"))


@query(f"""WITH {OBS}, g AS (SELECT site, capture, count(DISTINCT hex) AS c, count(DISTINCT px) AS p, count(DISTINCT tag || px) AS t FROM obs GROUP BY ALL)
SELECT site, capture, CASE WHEN site % 5 IN (0, 3) THEN 0 ELSE c END AS colors, CASE WHEN site % 5 IN (1, 3) THEN 0 ELSE p END AS spacings, CASE WHEN site % 5 IN (2, 3) THEN 0 ELSE t END AS styles, ['palette', 'spacing', 'styles', 'document', ''][site % 5 + 1] AS failed FROM g""")
def isolated_captures(spark, sf):
    rows = isolation.isolated(_captured_documents(spark, sf), STAGES)
    return rows.select("site", "capture", *(F.size(c).cast("long").alias(n) for c, n in (("palette", "colors"), ("spacing", "spacings"), ("styles", "styles"))), F.array_join(F.transform("errors", lambda e: e["stage"]), ",").alias("failed"))


@query(f"""WITH {OBS} SELECT DISTINCT site, capture, ['palette', 'spacing', 'styles', 'document'][site % 5 + 1] AS stage, CASE site % 5 WHEN 0 THEN 'not {STAGES["palette"]}: STRING' WHEN 1 THEN 'not {STAGES["spacing"]}: ARRAY<VARIANT>' WHEN 2 THEN 'not {STAGES["styles"]}: OBJECT<tag: STRING>' ELSE 'not JSON' END AS reason FROM obs WHERE site % 5 < 4""")
def capture_errors(spark, sf):
    return isolation.errors(isolation.isolated(_captured_documents(spark, sf), STAGES), "site", "capture")
