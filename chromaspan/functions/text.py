"""Strings, dimensions, addresses and versions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 0) -> Column:
    """Half up, also for negative numbers."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def scaled(x: Column, factor: int = 1000) -> Column:
    """x as a whole number of 1 / factor: what both engines agree on."""
    return F.floor(x * factor + 0.5).cast("long")


def leading_number(text: Column) -> Column:
    """The number a string begins with, else null."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def percent_change(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise(F.abs(before - after) / F.abs(before) * 100)


def first_family(family: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.split(F.coalesce(family, F.lit("")), ",")[0]), "^[\"']|[\"']$", ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1)), "^www[.]", "")


def path(url: Column) -> Column:
    p = F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def page_identity(url: Column) -> Column:
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))


#: Paths that are no content, and what main sections begin with.
NOISE = [r"/(login|signin|sign-in|signup|sign-up|register|auth)", r"/(terms|privacy|legal|cookie|gdpr|tos)", r"/(cdn-cgi|wp-admin|wp-content|wp-json)", r"\.(pdf|jpg|jpeg|png|gif|svg|webp|zip|tar|gz|mp4|mp3)$", r"/tag/", r"/author/", r"/page/[0-9]+", r"\?"]
SECTIONS = [(r"^/(pricing|plans?|cost)", 30), (r"^/(about|company|team|story)", 25), (r"^/(product|features?|solutions?)", 25), (r"^/(enterprise|business|platform)", 20), (r"^/(contact|demo|trial|start)", 20), (r"^/(docs|documentation|developers?|api)", 15), (r"^/(blog|resources|insights|news)", 10)]


def path_score(p: Column) -> Column:
    """Importance of a path: -1 for noise, else 100 less 10 a slash plus the first section's bonus."""
    low = F.lower(p)
    bonus = F.lit(0)
    for pattern, points in reversed(SECTIONS):
        bonus = F.when(low.rlike(pattern), points).otherwise(bonus)
    return F.when(low.rlike("|".join(NOISE)), -1).otherwise(100 - 10 * F.regexp_count(p, F.lit("/")) + bonus)


def compatibility(found: Column, tool: Column, expected: str) -> Column:
    """current, compatible, outdated, ahead, legacy or unknown."""
    major = F.regexp_extract(found, r"^(\d+)\.\d+\.\d+", 1).try_cast("int")
    want = int(expected.split(".")[0])
    return F.when(major.isNull(), F.when(tool.isNotNull(), "legacy").otherwise("unknown")).when(major == want, F.when(found == expected, "current").otherwise("compatible")).when(major < want, "outdated").otherwise("ahead")


#: Fixed value: messages of failures that may pass.
RETRYABLE = "timeout|net::err_|econnrefused|etimedout|enotfound|err_name_not_resolved"


def crawl_error(message: Column) -> Column:
    """retryable for failures of network, names and time, else failure."""
    return F.when(F.coalesce(F.lower(message), F.lit("")).rlike(RETRYABLE), "retryable").otherwise("failure")


def title_case(value: Column) -> Column:
    """Words with spaces between them, each with a large first letter; other letters stay."""
    spaced = F.trim(F.regexp_replace(value, "[-_]+", " "))
    return F.array_join(F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def type_group(context: Column) -> Column:
    """Display, Headings, Body, Links, UI, Caption or Other, by the words of a typography context (fixed values)."""
    c = F.lower(context)
    groups = (("Display", "display|hero"), ("Headings", "^h[1-6]|heading|title"), ("Body", "body|text|paragraph"), ("Links", "link"), ("UI", "button|input|label|nav|ui"), ("Caption", "caption|small|meta|footnote"))
    return F.coalesce(*(F.when(c.rlike(p), name) for name, p in groups), F.lit("Other"))


def weight_name(weight: Column) -> Column:
    """The name of a font weight (fixed values); nothing for none."""
    n = F.regexp_extract(weight.cast("string"), r"^\s*([0-9]+)", 1).try_cast("int")
    steps = ((300, "light"), (400, "regular"), (500, "medium"), (600, "semi-bold"), (700, "bold"))
    return F.when(weight.isNull() | (weight.cast("string") == "") | (weight.cast("string") == "0"), "").otherwise(F.coalesce(*(F.when(n <= most, name) for most, name in steps), F.lit("extra-bold")))


def trimmed_number(value: Column) -> Column:
    """A decimal without needless zeros."""
    t = value.try_cast("double")
    return F.when(t == F.floor(t), F.floor(t).cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", t), "0+$", ""))


def length_value(value: Column) -> Column:
    """A length in px, rem or em with its first unit; a bare number is px; null for others, percentages too."""
    raw = F.trim(value)
    n, unit = F.regexp_extract(raw, r"^(-?[0-9]*\.?[0-9]+)(px|rem|em)\b", 1), F.regexp_extract(raw, r"^(-?[0-9]*\.?[0-9]+)(px|rem|em)\b", 2)
    return F.when(raw.rlike(r"^-?[0-9]*\.?[0-9]+$"), F.concat(trimmed_number(raw), F.lit("px"))).when(unit != "", F.concat(trimmed_number(n), unit))


def line_height_value(value: Column) -> Column:
    raw = F.trim(value)
    return F.when(raw.isin("", "normal"), None).when(raw.rlike(r"^[0-9]*\.?[0-9]+$"), trimmed_number(raw)).otherwise(length_value(raw))


def weight_value(value: Column) -> Column:
    raw = F.lower(F.trim(value))
    return F.when(raw == "normal", "400").when(raw == "bold", "700").when(raw.rlike("^[0-9]{3}$"), raw)


def tracking_value(value: Column) -> Column:
    """A letter spacing other than none."""
    return F.when(leading_number(length_value(value)) != 0, length_value(value))


def radius_value(value: Column) -> Column:
    """A radius; half and all of a box become a pill."""
    return F.when(F.trim(value).isin("50%", "100%"), "9999px").otherwise(length_value(F.trim(F.substring_index(value, "(", 1))))


def padding_value(value: Column) -> Column:
    """One to four lengths; null if one of them is none."""
    parts = F.transform(F.split(F.trim(value), r"\s+"), length_value)
    return F.when(F.forall(parts, lambda x: x.isNotNull()), F.array_join(parts, " "))


def family_value(value: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def run_summary(flags: dict[str, Column], paths: Column, pages: Column) -> Column:
    """The active flags in their order, explicit paths, and how many pages were merged.

    flags: name of a flag -> whether it is on, or its value (a string stands behind the name).
    """
    bits = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"--{n} "), c)) if kind == "value" else F.when(c, F.lit(f"--{n}")) for n, (kind, c) in flags.items()]
    merged = F.when(pages > 1, F.concat(F.lit("("), pages.cast("string"), F.lit(" pages merged)")))
    return F.concat(F.array_compact(F.array(*bits)), F.coalesce(paths, F.array().cast("array<string>")), F.array_compact(F.array(merged)))


def provenance(schema: str, spec: str, tool: Column, url: Column, at: Column) -> Column:
    """Where a capture comes from."""
    return F.struct(F.lit(schema).alias("schema_version"), tool.alias("tool_version"), F.lit(spec).alias("spec_version"), url.alias("url"), host(url).alias("domain"), at.alias("extracted_at"))


def type_context(tag: Column, size: Column, class_: Column, role: Column) -> Column:
    """The typography context of an element."""
    t, c = F.upper(tag), F.coalesce(class_, F.lit(""))
    return (
        F.when((t == "BUTTON") | (F.coalesce(role, F.lit("")) == "button") | c.contains("btn"), "ui")
        .when(t == "A", "link")
        .when((t == "H1") & (size >= 56), "display")
        .when(t.rlike("^H[1-6]$"), F.concat(F.lit("heading-"), F.substring(t, 2, 1)))
        .when(size >= 56, "display")
        .when(size <= 12, "caption")
        .when(size > 24, "text")
        .when(t.isin("LABEL", "SMALL") | c.rlike("label|caption|badge"), "ui")
        .otherwise("body")
    )


def easing_class(value: Column) -> Column:
    """Class of a CSS easing: keywords, or by a cubic-bezier's control points."""
    x1, y1, y2 = (F.regexp_extract(value, r"cubic-bezier\(\s*([-0-9.]+)\s*,\s*([-0-9.]+)\s*,\s*([-0-9.]+)\s*,\s*([-0-9.]+)", k).try_cast("double") for k in (1, 2, 4))
    return F.when(value.isin("linear", "ease", "ease-in", "ease-out", "ease-in-out"), value).when(x1.isNull(), "custom").when((y1 < 0) | (y1 > 1) | (y2 < 0) | (y2 > 1), "spring").when(x1 < 0.2, "ease-out").when(x1 > 0.6, "ease-in").otherwise("custom")


def milliseconds(value: Column) -> Column:
    n = leading_number(value)
    return F.when(value.endswith("ms"), n).when(value.endswith("s"), n * 1000)


#: What an element is called by a part of its class, the first that fits; borders know five of these, corners all.
CONTEXTS = {"button": "button|btn", "card": "card", "input": "input|field", "badge": "badge|tag|chip", "modal": "modal|dialog", "image": "image|img|avatar"}
BORDER_CONTEXTS = ("button", "card", "input", "modal")


def element_context(tag: Column, classes: Column, said: Column, kinds: tuple[str, ...] = tuple(CONTEXTS)) -> Column:
    """What an element is: its role or label (``said``) if it has one, else what its classes speak of, else its tag."""
    return F.coalesce(F.nullif(said, F.lit("")), *(F.when(classes.rlike(CONTEXTS[k]), k) for k in kinds), F.lower(tag))
