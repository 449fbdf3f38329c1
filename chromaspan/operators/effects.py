"""Gradients and motion: layers, stop colours, contexts, and their merge over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import top

#: Commas outside brackets, one level of brackets inside others included.
BETWEEN_LAYERS = r",(?![^()]*(?:\([^()]*\)[^()]*)*\))"
STOPS = r"(?i)(#[0-9a-f]{3,8}|rgba?\([^)]+\)|hsla?\([^)]+\)|oklch\([^)]+\)|oklab\([^)]+\))"


def gradients(rows: DataFrame, most: int = 20) -> DataFrame:
    """site, gradient, kind, stops, n, rank from (site, image): the most used gradient layers."""
    layer = rows.select("site", F.explode(F.split("image", BETWEEN_LAYERS)).alias("layer"))
    layer = layer.select("site", F.trim(F.regexp_replace("layer", r"\s+", " ")).alias("gradient")).where(F.col("gradient").rlike("^(repeating-)?(linear|radial|conic)-gradient"))
    used = top(layer.groupBy("site", "gradient").agg(F.count("*").alias("n")), ["site"], [F.desc("n"), "gradient"], most)
    kind = F.concat(F.regexp_extract("gradient", "(linear|radial|conic)", 1), F.when(F.col("gradient").startswith("repeating-"), "-repeating").otherwise(""))
    return used.select("site", "gradient", kind.alias("kind"), F.array_join(F.regexp_extract_all("gradient", F.lit(STOPS), F.lit(1)), " ").alias("stops"), "n", "rank")


def motion_context(tag: Column, role: Column, hint: Column) -> Column:
    """Which part of a page moves, by tag, role, and the words of class and id."""
    t, r = F.lower(tag), F.coalesce(role, F.lit(""))
    h = F.concat_ws(" ", F.lower(F.coalesce(hint, F.lit(""))), r)
    return (
        F.when((t == "button") | (r == "button") | h.contains("btn"), "button")
        .when((t == "a") | (r == "link"), "link")
        .when((t == "nav") | (r == "navigation") | h.rlike("nav|menu"), "nav")
        .when(h.rlike("modal|dialog|overlay|drawer"), "modal")
        .when(h.rlike("card|tile|item"), "card")
        .when(h.rlike("hero|banner|header"), "hero")
        .when(h.rlike("tooltip|popover|dropdown"), "overlay")
        .when(t.isin("input", "textarea", "select"), "input")
        .when(h.rlike("image|img|media|video"), "media")
        .otherwise("other")
    )


def delta_pattern(before: DataFrame, after: DataFrame) -> DataFrame:
    """page_id, el, pattern: how an element (page_id, el, transform, opacity, bg, fg) differs between two states."""
    b, a = before.alias("b"), after.alias("a")
    was, now = (lambda c: F.col(f"b.{c}")), (lambda c: F.col(f"a.{c}"))
    shift = now("transform")
    scale = F.regexp_extract(shift, r"scale\(([0-9.]+)", 1).try_cast("double")
    moved = ~shift.eqNullSafe(was("transform")) & (F.coalesce(shift, F.lit("none")) != "none")
    how = F.when(scale.isNotNull(), F.when(scale > 1, "scale-up").otherwise("scale-down")).when(shift.contains("translateY"), "slide-y").when(shift.contains("translateX"), "slide-x").otherwise("transform")
    pattern = F.when(moved, how).when(now("opacity") > was("opacity"), "fade-in").when(now("opacity") < was("opacity"), "fade-out").when((now("bg") != was("bg")) | (now("fg") != was("fg")), "color-shift")
    return b.join(a, ["page_id", "el"]).select("page_id", "el", pattern.alias("pattern")).where("pattern is not null")


def merged_values(rows: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """site, value, n: sums over pages (a missing count is one); with ``most``, the most used."""
    out = rows.groupBy("site", value).agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))
    return out if most is None else top(out, ["site"], [F.desc("n"), value], most)
