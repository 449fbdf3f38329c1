"""Colour hints and icons that a page's head declares: <meta> and <link> tags to rows, by Spark expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Meta names and link relations that state a colour, in order of trust.
COLOR_SOURCES = ["theme-color", "mask-icon", "msapplication-tilecolor", "msapplication-navbutton-color", "apple-mobile-web-app-status-bar-style"]
#: Meta properties that name a picture of the site.
IMAGE_PROPERTIES = ["og:image", "twitter:image"]


def attribute(tag: Column, name: str) -> Column:
    """The trimmed value of a quoted attribute, null where absent or empty."""
    return F.nullif(F.trim(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))


def head_tags(pages: DataFrame) -> DataFrame:
    """page_id, ord, tag, name, rel, content, href, color, media, sizes: the <meta> and <link> tags in order."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:meta|link)\s[^>]*>)"), F.lit(1))).alias("ord", "raw"))
    raw = F.col("raw")
    return found.select(
        "page_id",
        "ord",
        F.lower(F.regexp_extract(raw, r"(?i)^<(meta|link)", 1)).alias("tag"),
        F.lower(F.coalesce(attribute(raw, "name"), attribute(raw, "property"))).alias("name"),
        F.lower(attribute(raw, "rel")).alias("rel"),
        *(attribute(raw, a).alias(a) for a in ("content", "href", "color", "media", "sizes")),
    )


def platform_colors(tags: DataFrame) -> DataFrame:
    """page_id, source, value, scheme, rank: declared colours, most trusted first, then in order of the page.

    Values are as written. theme-color has the scheme of its media query; a status bar counts only as hex digits.
    """
    source = F.when(F.col("tag") == "meta", F.col("name")).when(F.col("rel").contains("mask-icon"), "mask-icon")
    value = F.when(F.col("tag") == "meta", F.col("content")).otherwise(F.col("color"))
    trust = F.array_position(F.array(*map(F.lit, COLOR_SOURCES)), F.col("source"))
    media = F.lower("media")
    scheme = F.when(F.col("source") == "theme-color", F.when(media.contains("dark"), "dark").when(media.contains("light"), "light"))
    rows = tags.withColumn("source", source).withColumn("value", value).where(F.col("source").isin(COLOR_SOURCES) & F.col("value").isNotNull() & ~F.col("value").isin("yes", "no"))
    rows = rows.where((F.col("source") != COLOR_SOURCES[-1]) | F.col("value").rlike("^#[0-9a-fA-F]{3,8}$"))
    order = Window.partitionBy("page_id").orderBy(trust, "ord")
    return rows.select("page_id", "source", "value", scheme.alias("scheme"), F.row_number().over(order).cast("long").alias("rank"))


def theme(hints: DataFrame) -> DataFrame:
    """page_id, theme_color, dark_theme_color, background_color: the first hint of each kind; null where none is."""
    light = F.col("source").isin("theme-color", "mask-icon", "msapplication-navbutton-color") & ~F.coalesce(F.col("scheme") == "dark", F.lit(False))
    first = lambda test, name: F.min_by(F.when(test, F.col("value")), F.when(test, F.col("rank"))).alias(name)
    return hints.groupBy("page_id").agg(first(light, "theme_color"), first(F.col("scheme") == "dark", "dark_theme_color"), first(F.col("source") == "msapplication-tilecolor", "background_color"))


def icons(pages: DataFrame) -> DataFrame:
    """page_id, kind, href, sizes, rank: icon links, then pictures of the site; /favicon.ico where no icon is linked."""
    tags = head_tags(pages)
    linked = tags.where((F.col("tag") == "link") & F.col("rel").contains("icon") & F.col("href").isNotNull()).select("page_id", F.lit(0).alias("place"), "ord", F.col("rel").alias("kind"), "href", "sizes")
    pictures = tags.where((F.col("tag") == "meta") & F.col("name").isin(IMAGE_PROPERTIES) & F.col("content").isNotNull()).select("page_id", F.lit(1).alias("place"), "ord", F.col("name").alias("kind"), F.col("content").alias("href"), F.lit(None).cast("string").alias("sizes"))
    usual = pages.select("page_id").distinct().join(linked.select("page_id"), "page_id", "left_anti").select("page_id", F.lit(2).alias("place"), F.lit(0).alias("ord"), F.lit("favicon.ico").alias("kind"), F.lit("/favicon.ico").alias("href"), F.lit(None).cast("string").alias("sizes"))
    order = Window.partitionBy("page_id").orderBy("place", "ord")
    return linked.union(pictures).union(usual).select("page_id", "kind", "href", "sizes", F.row_number().over(order).cast("long").alias("rank"))
