"""Landed web pages, robots files and sitemaps to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaspan.functions import text

#: page_id, el_id, parent_id, depth, tag, id, class, role, href, style, txt, the ids of all ancestors, and all attributes
ELEMENTS = "page_id long, el_id int, parent_id int, depth int, tag string, id string, class string, role string, href string, style string, txt string, ancestors array<int>, attrs map<string,string>"
#: Rows that are handed on at once.
ROWS_AT_ONCE = 20_000


def _elements(batches):
    """Rows of elements from batches of (page_id, html)."""
    from html.parser import HTMLParser

    import pandas as pd

    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    class Scan(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.rows, self.open = [], []

        def handle_starttag(self, tag, attrs):
            a = {k: v or "" for k, v in reversed(attrs)}  # the first of a repeated attribute counts
            above = [k for k, _ in self.open]
            self.rows.append([len(self.rows), above[-1] if above else None, len(above), tag, a.get("id"), a.get("class"), a.get("role"), a.get("href"), a.get("style"), "", above, a])
            if tag not in void:
                self.open.append((len(self.rows) - 1, tag))

        def handle_endtag(self, tag):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][1] == tag:
                    del self.open[k:]
                    break

        def handle_data(self, data):
            if self.open and data.strip():
                self.rows[self.open[-1][0]][9] += data

    names = [c.split()[0] for c in ELEMENTS.split(", ")]

    def frame(rows):
        made = pd.DataFrame(rows, columns=names)
        made["parent_id"] = made["parent_id"].astype("Int32")
        return made

    for pdf in batches:
        out = []
        for page, html in zip(pdf["page_id"], pdf["html"], strict=True):
            scan = Scan()
            scan.feed(html or "")
            out += [[page, *r] for r in scan.rows]
            if len(out) >= ROWS_AT_ONCE:
                yield frame(out)
                out = []
        yield frame(out)


def elements(pages: DataFrame) -> DataFrame:
    """One row per element of each page, in document order, with its ancestors (see ELEMENTS)."""
    return pages.select("page_id", "html").mapInPandas(_elements, ELEMENTS)


def css_rules(pages: DataFrame) -> DataFrame:
    """page_id, ord, selector, property, value: the declarations of a page's <style> elements, numbered through the page."""
    style = F.regexp_extract_all("html", F.lit("(?is)<style[^>]*>(.*?)</style>"), F.lit(1))
    rule = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.array_join(style, "\n"), F.lit(r"([^{}]+\{[^{}]*\})"), F.lit(1))).alias("at", "rule"))
    parts = rule.select("page_id", "at", F.trim(F.regexp_extract("rule", r"^([^{]+)\{", 1)).alias("selector"), F.posexplode(F.split(F.regexp_extract("rule", r"\{([^}]*)\}", 1), ";")).alias("line_at", "line"))
    return parts.where("line like '%:%'").select("page_id", (F.col("at").cast("long") * 100_000 + F.col("line_at")).alias("ord"), "selector", F.trim(F.substring_index("line", ":", 1)).alias("property"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))


def custom_properties(rules: DataFrame) -> DataFrame:
    """The root's custom properties; of several declarations of a name the last one counts, as in the cascade."""
    own = rules.where("property like '--%' and selector rlike '(^|,)\\\\s*(:root|html)\\\\s*(,|$)'")
    return own.groupBy("page_id", "property").agg(F.max_by("value", "ord").alias("value"))


#: States, what counts as interactive in a selector, and the properties that show a state.
STATES, INTERACTIVE = r":(hover|focus|focus-visible|active)", r"""(?i)(^|[\s,>~+])(a|button)\b|\[role=["']?button|\.(btn|button)\b"""
STATE_PROPERTIES = ("color", "background-color", "border-color", "box-shadow", "outline-color")


def state_rules(rules: DataFrame, most: int = 200) -> DataFrame:
    """page_id, ord, selector (140 characters) and a column for each of STATE_PROPERTIES: rules (see ``css_rules``) that restyle hovered, focused
    or pressed links and buttons, a page's first ``most``. Of a property's repeated declarations in a rule the last counts."""
    own = rules.where(F.col("selector").rlike(STATES) & F.col("selector").rlike(INTERACTIVE) & F.lower("property").isin(*STATE_PROPERTIES) & (F.col("value") != ""))
    last = lambda p: F.max_by(F.when(F.lower("property") == p, F.col("value")), F.when(F.lower("property") == p, F.col("ord"))).alias(p.replace("-", "_"))
    found = own.groupBy("page_id", F.expr("ord div 100000").alias("at")).agg(F.substring(F.first("selector"), 1, 140).alias("selector"), *map(last, STATE_PROPERTIES))
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("at")).cast("long")).where(F.col("ord") <= most).drop("at")


def media_breakpoints(pages: DataFrame) -> DataFrame:
    """page_id, px: the distinct widths in @media texts."""
    media = F.array_join(F.regexp_extract_all("html", F.lit(r"(@media[^{]*)\{"), F.lit(1)), " ")
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(media, F.lit(r"(\d+)px"), F.lit(1)))).alias("px")).select("page_id", F.col("px").cast("long"))


def links(pages: DataFrame, most: int = 20) -> DataFrame:
    """page_id, path, score, rank: same-site links with what their path and place in nav say, best first."""
    nav = F.array_join(F.regexp_extract_all("html", F.lit("(?s)<(?:nav|header|footer)[ >].*?</(?:nav|header|footer)>"), F.lit(0)), "")
    hrefs = lambda c: F.regexp_extract_all(c, F.lit('<a href="([^"]*)"'), F.lit(1))
    each = pages.withColumn("nav", hrefs(nav)).select("page_id", F.explode(hrefs("html")).alias("path"), "nav").where("path like '/%' and path <> '/'")
    found = each.select("page_id", "path", F.when(F.array_contains("nav", F.col("path")), 2).otherwise(1).alias("place")).groupBy("page_id", "path").agg(F.max("place").alias("place"))
    base = text.path_score(F.col("path"))
    scored = found.withColumn("score", (base + 5 * F.col("place")).cast("long")).where(base >= 0)
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("page_id", "path", "score", "rank")


def site_names(pages: DataFrame) -> DataFrame:
    """page_id, name: og:site_name, else application-name, else the title before a separator (2-39 characters)."""
    meta = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    title = F.trim(F.get(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[|–—·]"), 0))
    return pages.select("page_id", F.coalesce(meta('property="og:site_name" content="([^"]*)"'), meta('name="application-name" content="([^"]*)"'), F.when(F.length(title).between(2, 39), title)).alias("name"))


#: Marks of frameworks and icon sets in a page's source, and how many must stand there.
MARKS = {"bootstrap": ("class=\"[^\"]*\\b(?:btn|col|row|container)(?:-[a-z0-9]+)?\\b", 3), "tailwind": ("class=\"[^\"]*\\b(?:flex|grid|p|m|text|bg)-[a-z0-9]+", 3), "material": ("class=\"[^\"]*\\b(?:Mui|mdc-)", 2), "chakra": ("class=\"[^\"]*chakra-", 1), "ant": ("class=\"[^\"]*\\bant-", 2), "font-awesome": ("class=\"[^\"]*\\bfa-", 1), "plain-ads": ("class=\"ad\"", 1)}


def fingerprints(pages: DataFrame) -> DataFrame:
    """page_id, mark, n: frameworks and icon sets with enough marks in the page."""
    counts = F.create_map(*(x for k, (p, least) in MARKS.items() for x in (F.lit(k), F.struct(F.regexp_count("html", F.lit(p)).cast("long").alias("n"), F.lit(least).alias("least")))))
    return pages.select("page_id", F.explode(counts).alias("mark", "found")).where("found.n >= found.least").select("page_id", "mark", "found.n")


def robots_rules(files: DataFrame) -> DataFrame:
    """host, ord, agent, allow, pattern from (host, body): consecutive user-agent lines open one group."""
    line = F.trim(F.regexp_replace(F.col("line"), "#.*$", ""))
    rows = files.select("host", F.posexplode(F.split("body", "\n")).alias("ord", "line")).withColumn("line", line).where("line like '%:%'")
    rows = rows.withColumn("field", F.lower(F.trim(F.substring_index("line", ":", 1)))).withColumn("said", F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))).where("field in ('user-agent', 'allow', 'disallow')")
    order = Window.partitionBy("host").orderBy("ord")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("grp", F.sum("opens").over(order))
    agents = rows.where("field = 'user-agent'").select("host", "grp", F.lower("said").alias("agent"))
    return rows.where("field <> 'user-agent' and said <> ''").join(agents, ["host", "grp"]).select("host", "ord", "agent", (F.col("field") == "allow").alias("allow"), F.col("said").alias("pattern"))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """urls (page_id, host, path) with allowed: the longest matching rule wins, the first on ties; none allows.

    A host without a group for the agent is judged by its group for all agents.
    """
    escaped = F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    named = rules.where(F.col("agent") == agent.lower()).select("host").distinct().withColumn("own", F.lit(True))
    group = rules.where(F.col("agent").isin(agent.lower(), "*")).join(named, "host", "left").where((F.col("agent") == agent.lower()) | F.col("own").isNull())
    hit = urls.join(group.withColumn("rx", F.concat(F.lit("^"), escaped)), "host").where(F.expr("path rlike rx"))
    best = hit.groupBy("page_id").agg(F.max_by("allow", F.struct(F.length("pattern"), -F.col("ord"))).alias("allow"))
    return urls.join(best, "page_id", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


def sitemap_urls(files: DataFrame, most: int = 50) -> DataFrame:
    """host, url, score, rank from (host, xml): own-host locations without the homepage, best first."""
    loc = files.select("host", F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).withColumn("url", F.regexp_replace("url", "/+$", ""))
    own = loc.where(text.host(F.col("url")) == F.regexp_replace("host", "^www[.]", "")).where(text.path(F.col("url")) != "/").dropDuplicates(["host", "url"])
    scored = own.withColumn("score", text.path_score(text.path(F.col("url")))).where("score >= 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "url"))).where(F.col("rank") <= most)


def read_snapshots(spark, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """(snapshots, rejects): JSON documents under a schema; what cannot be read is a row of rejects."""
    from pyspark.sql.types import StringType, StructField, StructType

    both = spark.read.schema(StructType([*schema.fields, StructField("_corrupt_record", StringType())])).option("multiLine", True).option("mode", "PERMISSIVE").json(path).cache()
    return both.where("_corrupt_record is null").drop("_corrupt_record"), both.where("_corrupt_record is not null").select("_corrupt_record")


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Parquet by site and day of capture (site, captured_date)."""
    snapshots.write.mode("append").partitionBy("site", "captured_date").parquet(path)


def small_enough(rows: DataFrame, most: int = 150_000) -> DataFrame:
    """The rows whose JSON has at most ``most`` bytes."""
    return rows.where(F.octet_length(F.to_json(F.struct("*"))) <= most)


def manifest_fields(files: DataFrame) -> DataFrame:
    """host, theme_color, background_color, name, short_name from (host, body): a web app manifest; empty values are none."""
    m = F.from_json("body", "theme_color string, background_color string, name string, short_name string")
    read = files.select("host", m.alias("m"))
    return read.select("host", *(F.nullif(F.col(f"m.{c}"), F.lit("")).alias(c) for c in ("theme_color", "background_color", "name", "short_name")))
