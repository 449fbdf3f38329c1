"""Font sources and settings of pages: asset addresses, families of stylesheet links, faces, axes and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hosts that serve web fonts, and hosts whose faces are no fonts of a site's own.
PROVIDERS = ("fonts.googleapis.com", "fonts.gstatic.com", "use.typekit.net", "fonts.bunny.net")
THIRD_PARTIES = ("googleapis.com", "gstatic.com", "typekit.net", "adobe.com", "fonts.com", "cloud.typography.com", "fast.fonts.net", "use.fontawesome.com")


def is_font_url(url: Column) -> Column:
    """http(s) addresses of a font file or at a provider's host."""
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]+)", 1))
    return url.rlike("(?i)^https?://") & (url.rlike(r"(?i)\.(woff2?|ttf|otf|eot)([?#].*)?$") | host.isin(*PROVIDERS))


def font_urls(candidates: DataFrame) -> DataFrame:
    """site, url: distinct font addresses of (site, url)."""
    return candidates.where(is_font_url(F.col("url"))).select("site", "url").distinct()


def linked_families(links: DataFrame) -> DataFrame:
    """site, family, variable from stylesheet addresses (site, url): the family parameters."""
    own = links.where(F.col("url").rlike(r"fonts\.(googleapis|gstatic)\.com"))
    each = own.select("site", F.explode(F.regexp_extract_all("url", F.lit("family=([^&:%]+)"), F.lit(1))).alias("family"), F.col("url").rlike("wght|ital").alias("variable"))
    return each.groupBy("site", F.regexp_replace("family", r"\+", " ").alias("family")).agg(F.bool_or("variable").alias("variable"))


def faces(rules: DataFrame) -> DataFrame:
    """site, family, custom, variable from font faces (site, family, src, variation): custom if served by the site."""
    family = F.trim(F.regexp_replace("family", "['\"]", ""))
    src, low = F.coalesce("src", F.lit("")), F.lower(family)
    custom = ~F.coalesce(*(F.when(src.contains(h), True) for h in THIRD_PARTIES), F.lit(False)) & (src.contains("url(") | src.rlike("^[.]?/"))
    variable = low.contains("variable") | low.contains(" vf") | low.endswith("-var") | (src.contains("woff2") & F.col("variation").isNotNull())
    rows = rules.select("site", family.alias("family"), custom.alias("custom"), variable.alias("variable")).where("family <> ''")
    return rows.groupBy("site", "family").agg(F.bool_or("custom").alias("custom"), F.bool_or("variable").alias("variable"))


def variable_axes(settings: DataFrame) -> DataFrame:
    """site, axis, low, high, n from font-variation-settings (site, setting)."""
    pairs = F.regexp_extract_all("setting", F.lit(r'("[^"]+"\s+-?\d+(?:\.\d+)?)'), F.lit(1))
    each = settings.select("site", F.explode(pairs).alias("pair"))
    each = each.select("site", F.regexp_extract("pair", '"([^"]+)"', 1).alias("axis"), F.regexp_extract("pair", r"\s(-?[\d.]+)$", 1).cast("double").alias("value"))
    return each.groupBy("site", "axis").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def merged_axes(axes: DataFrame) -> DataFrame:
    """Axes of several pages: the widest range, the sum of uses."""
    return axes.groupBy("site", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def open_type_features(settings: DataFrame) -> DataFrame:
    """site, feature: features switched on in font-feature-settings (site, setting)."""
    each = settings.select("site", F.explode(F.regexp_extract_all("setting", F.lit(r'("[^"]+"(?:\s+(?:on|off|\d+))?)'), F.lit(1))).alias("said"))
    return each.where(~F.col("said").rlike(r'"\s+(off|0)$')).select("site", F.regexp_extract("said", '"([^"]+)"', 1).alias("feature")).distinct()
