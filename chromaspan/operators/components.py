"""Buttons, inputs and badges of a page: candidates, one row per look, and their merge over pages.

Elements have site, page_id, ord, tag, role, type, class, inside (in navigation or a footer), width, height, top, bg,
fg, border_width, border_color, radius, size, weight, text; bg and border_color are null where transparent. Looks are
found by group-bys of minima, so frequent looks are combined before the shuffle and no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import top

PAGE = ["site", "page_id"]
#: Backgrounds that mark a badge's meaning.
MEANINGS = {
    "error": ("#ff0000", "#dc3545", "#ef4444"),
    "warning": ("#ffc107", "#fbbf24", "#f59e0b"),
    "success": ("#28a745", "#22c55e", "#10b981"),
    "info": ("#007bff", "#3b82f6", "#2563eb"),
}
#: How many looks of each group of inputs stay.
INPUT_LOOKS = {"text": 5, "checkbox": 3, "radio": 3, "select": 3}


def has_border() -> Column:
    return (F.coalesce("border_width", F.lit(0)) > 0) & F.col("border_color").isNotNull()


def border() -> Column:
    return F.concat_ws(" ", F.col("border_width").cast("string"), F.coalesce("border_color", F.lit("transparent")))


def looks(rows: DataFrame, key: list[str], rest: list[str], best: list[Column], most: int) -> DataFrame:
    """One row per key, the rest from its best row; per page (and group) the first ``most`` in that order.

    Rows at the same place are told apart by their other columns, so the outcome is one and the same.
    """
    order = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(best)), *rest)
    first = rows.groupBy(*key).agg(F.min(order).alias("place"), F.min_by(F.struct(*rest), order).alias("own"))
    groups = [c for c in key if c in (*PAGE, "grp")]
    return top(first, groups, ["place", *key], most).select(*key, "own.*", "rank")


def buttons(elements: DataFrame, fold: int = 900, most: int = 8) -> DataFrame:
    """site, page_id, bg, fg, radius, border, text, size, weight, confidence, rank: the most prominent looks."""
    role = F.coalesce("role", F.lit(""))
    filled, bordered = F.col("bg").isNotNull(), has_border()
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = points(F.col("tag") == "BUTTON", 30) + points(role == "button", 20) + points(filled, 20) + points(bordered & ~filled, 10) + points(F.col("top") < fold, 15) + points(F.col("top") < 300, 10)
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    seen = elements.where((F.col("tag").isin("BUTTON", "A") | (role == "button")) & ~role.isin("tab", "menuitem", "option", "switch", "treeitem") & ~F.col("inside") & (filled | bordered) & F.col("height").between(24, 100) & F.col("width").between(40, 600) & (said != ""))
    rows = seen.select(*PAGE, "ord", F.coalesce("bg", F.lit("transparent")).alias("bg"), "fg", "radius", border().alias("border"), F.substring(said, 1, 40).alias("text"), "size", "weight", score.alias("score"))
    out = looks(rows, [*PAGE, "bg", "fg", "radius", "border"], ["text", "size", "weight", "score"], [-F.col("score"), F.col("ord")], most)
    return out.withColumn("confidence", F.when(F.col("score") >= 40, "high").otherwise("medium")).drop("score")


def inputs(elements: DataFrame) -> DataFrame:
    """site, page_id, grp, border, radius, bg, specific, rank: looks of text fields, boxes, radios and selections."""
    kind, role = F.coalesce("type", F.lit("")), F.coalesce("role", F.lit(""))
    group = F.when(F.col("tag") == "SELECT", "select").when(kind.isin("checkbox", "radio"), kind).otherwise("text")
    seen = elements.where((F.col("tag").isin("INPUT", "TEXTAREA", "SELECT") | role.isin("textbox", "searchbox", "combobox")) & (F.col("width") > 0) & (F.col("height") > 0))
    rows = seen.select(*PAGE, "ord", group.alias("grp"), border().alias("border"), "radius", F.coalesce("bg", F.lit("transparent")).alias("bg"), F.when(kind != "", kind).otherwise(F.lower("tag")).alias("specific"))
    out = looks(rows, [*PAGE, "grp", "border", "radius", "bg"], ["specific"], [F.col("ord")], max(INPUT_LOOKS.values()))
    limit = F.coalesce(*(F.when(F.col("grp") == g, n) for g, n in INPUT_LOOKS.items()))
    return out.where(F.col("rank") <= limit)


def badges(elements: DataFrame) -> DataFrame:
    """site, page_id, bg, fg, radius, style, variant, rounded, confidence, rank: every look of a page's small marks."""
    role, named = F.coalesce("role", F.lit("")), F.lower(F.coalesce("class", F.lit(""))).rlike("badge|tag|pill|chip|label|status")
    filled = F.col("bg").isNotNull()
    seen = elements.where((named | (role == "status")) & F.col("width").between(1, 200) & F.col("height").between(1, 60) & (F.col("size") <= 16) & (filled | (F.col("border_width") > 0)))
    meaning = F.coalesce(*(F.when(F.col("bg").isin(*own), name) for name, own in MEANINGS.items()), F.lit("neutral"))
    pale = F.least(*(F.conv(F.substring("bg", k, 2), 16, 10).cast("int") for k in (2, 4, 6))) > 240
    style = F.when(~filled, "outline").when(pale, "subtle").otherwise("filled")
    rows = seen.select(*PAGE, "ord", F.coalesce("bg", F.lit("transparent")).alias("bg"), "fg", "radius", style.alias("style"), meaning.alias("variant"), (F.col("radius") > F.col("height") / 3).alias("rounded"), F.when(named | (role == "status"), "high").otherwise("medium").alias("confidence"))
    return looks(rows, [*PAGE, "bg", "fg", "radius", "style"], ["variant", "rounded", "confidence"], [F.col("ord")], 2**31 - 1)


def merged(parts: DataFrame, key: list[str], order: list[str], rest: list[str]) -> DataFrame:
    """Looks of all pages of a site: n is on how many rows a look stands, the rest is its first page's."""
    own = F.min_by(F.struct(*rest), F.struct(*order))
    return parts.groupBy("site", *key).agg(F.count("*").alias("n"), own.alias("own")).select("site", *key, "n", "own.*")
