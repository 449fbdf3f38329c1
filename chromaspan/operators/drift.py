"""Two captures to a 0-100 drift report.

tokens: snapshot_id, category (color, typography, spacing, radius, shadow, semantic), ord, key, value, num,
confidence and, where known, count (uses). A pair table (pair_id, base_id, cand_id) says what is compared.

Each capture's tokens are gathered once, which is one page's worth; pairs join two such rows, and all the rest is
column work on that row: the greedy nearest matching, in the order of the tokens, is a fold over an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaspan.functions import color, text
from chromaspan.functions.color import let

#: Limits and weights.
SAME_E, CHANGED_E, SAME_PCT, CHANGED_PCT, LIMIT = 2.3, 15.0, 4.0, 25.0, 10
WEIGHTS = {"color": 1.0, "typography": 1.0, "spacing": 0.8, "radius": 0.6, "shadow": 0.6}
ROLES = {"accent": 3.0, "primary": 3.0, "brand": 3.0, "cta": 2.0, "secondary": 1.5, "surface": 0.3, "background": 0.3}
#: The category that a failed stage of a capture makes incomparable.
STAGES = {
    "colors": "color", "dark-mode": "color", "mobile": "color", "reveal": "color", "hover-focus": "color", "gradient-colors": "color",
    "svg-logo-colors": "color", "manifest": "color", "typography": "typography", "spacing": "spacing", "borderRadius": "radius", "shadows": "shadow",
}
CHANGE = "struct<category: string, kind: string, label: string, before: string, after: string, delta: double, penalty: double>"
FAR = 1e300


def previous_pairs(captures: DataFrame) -> DataFrame:
    """pair_id, base_id, cand_id: each capture of a site beside the one before it (site, snapshot_id, capture)."""
    order = Window.partitionBy("site").orderBy("capture")
    out = captures.withColumn("base_id", F.lag("snapshot_id").over(order)).where("base_id is not null")
    return out.select(F.concat_ws(">", "base_id", "snapshot_id").alias("pair_id"), "base_id", F.col("snapshot_id").alias("cand_id"))


def baseline_pairs(captures: DataFrame, baselines: DataFrame) -> DataFrame:
    """Pairs with each site's pinned baseline (site, base_id)."""
    return captures.join(baselines, "site").where("snapshot_id <> base_id").select(F.concat_ws(">", "base_id", "snapshot_id").alias("pair_id"), "base_id", F.col("snapshot_id").alias("cand_id"))


def snapshots(tokens: DataFrame) -> DataFrame:
    """snapshot_id and, per category, the array of its tokens that drift looks at, in order.

    Unsure radii and shadows, sizes out of 0 to 500 and shadows in notations that cannot be compared are left out.
    """
    rows = tokens if "count" in tokens.columns else tokens.withColumn("count", F.lit(1))
    sized = "category in ('spacing', 'radius')"
    rows = rows.where(f"not ({sized}) or num between 0 and 500").where("category not in ('radius', 'shadow') or coalesce(confidence, 'high') <> 'low'")
    rows = rows.where("category <> 'shadow' or (trim(value) <> '' and not value rlike '(oklab|oklch|color)[(]')")
    painted = F.col("category").isin("color", "semantic")
    rows = color.parsed(rows.withColumn("paint", F.when(painted, F.col("value"))), "paint").drop("paint")
    rows = rows.withColumn("hex", F.when(F.col("rgba").isNotNull(), color.to_hex(F.col("rgba.r"), F.col("rgba.g"), F.col("rgba.b"))))
    part = F.split("value", "/")
    token = F.struct(
        F.col("ord").cast("long").alias("ord"), F.coalesce("key", F.lit("")).alias("key"), "value", F.coalesce(F.col("num").cast("double"), F.lit(0.0)).alias("num"), F.greatest(F.lit(1.0), F.col("count").cast("double")).alias("count"),
        "hex", F.col("rgba.a").cast("double").alias("alpha"), F.when(F.col("hex").isNotNull(), color.lab(F.col("hex"))).alias("lab"),
        F.when(F.col("category") == "typography", text.first_family(F.get(part, 0))).alias("family"), F.when(F.col("category") == "typography", F.get(part, 1)).alias("font_weight"),
        F.trim(F.regexp_replace("value", r"\s+", " ")).alias("plain"),
    )
    rows = rows.select("snapshot_id", "category", token.alias("token"))
    own = lambda c: F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("token")))).alias(c)
    return rows.groupBy("snapshot_id").agg(*(own(c) for c in (*WEIGHTS, "semantic")))


def change(category: str, kind: str, label: Column, before=None, after=None, delta=None, penalty=0.0) -> Column:
    values = [F.lit(category), F.lit(kind), label, *(F.lit(None).cast("string") if v is None else v for v in (before, after)), F.lit(None).cast("double") if delta is None else delta, F.lit(penalty) if isinstance(penalty, float) else penalty]
    return F.struct(*(v.alias(n) for v, n in zip(values, ("category", "kind", "label", "before", "after", "delta", "penalty"), strict=True))).cast(CHANGE)


def tenth(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def pct(x: Column, y: Column) -> Column:
    """Change from x to y in per cent; from nothing it is 100."""
    return F.when(x == 0, F.when(y == 0, 0.0).otherwise(100.0)).otherwise(F.abs(x - y) / F.abs(x) * 100)


def color_distance(x: Column, y: Column) -> Column:
    """CIE76 of two tokens; of values that cannot be read 0 if they are equal, else beyond every limit."""
    return F.when(x["lab"].isNotNull() & y["lab"].isNotNull(), color.delta_e(x["lab"], y["lab"])).when(F.trim(x["value"]) == F.trim(y["value"]), 0.0).otherwise(FAR)


def matched(base: Column, cand: Column, distance, limit: float, told) -> Column:
    """The changes of a category: each base token, in order, takes the nearest candidate token that is free and within
    the limit. told(kind, b, c, d): the change as a struct, or null if the two count as the same."""
    nothing = F.array().cast(f"array<{CHANGE}>")

    def step(acc: Column, b: Column) -> Column:
        def take(best: Column) -> Column:
            hit = F.coalesce(best["d"] <= limit, F.lit(False))
            new = F.when(hit, let(F.get(cand, best["i"]), lambda c: told("changed", b, c, best["d"]))).otherwise(told("removed", b, None, None))
            free = F.when(hit, F.filter(acc["free"], lambda c: c["i"] != best["i"])).otherwise(acc["free"])
            return F.struct(free.alias("free"), F.concat(acc["out"], F.filter(F.array(new), lambda x: x.isNotNull())).alias("out"))

        return let(F.array_min(F.transform(acc["free"], lambda c: F.struct(distance(b, c["t"]).alias("d"), c["i"].alias("i")))), take)

    start = F.struct(F.transform(cand, lambda c, i: F.struct(i.alias("i"), c.alias("t"))).alias("free"), nothing.alias("out"))
    return let(F.aggregate(base, start, step), lambda x: F.concat(x["out"], F.transform(x["free"], lambda c: told("added", None, c["t"], None))))


def role_weight(role: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(role) == r, w) for r, w in ROLES.items()), F.lit(1.0))


def color_weight(token: Column, semantic: Column) -> Column:
    """A colour counts by its role (the last one of the capture's semantic colours that equals it) and its uses."""
    role = F.try_element_at(F.filter(semantic, lambda s: s["hex"] == token["hex"]), F.lit(-1))["key"]
    return let(F.coalesce(role, F.lit("")), role_weight) * F.sqrt(token["count"])


def color_changes(b: Column, c: Column, b_roles: Column, c_roles: Column) -> Column:
    def told(kind, x, y, d):
        if kind == "removed":
            return change("color", kind, x["value"], before=x["value"], penalty=color_weight(x, b_roles))
        if kind == "added":
            return change("color", kind, y["value"], after=y["value"], penalty=0.5 * color_weight(y, c_roles))
        return F.when(d > SAME_E, change("color", kind, x["value"], x["value"], y["value"], tenth(d), d / CHANGED_E * color_weight(x, b_roles)))

    return matched(b, c, color_distance, CHANGED_E, told)


def role_changes(b: Column, c: Column) -> Column:
    """Changes of semantic roles with their weight: array<struct<change, weight>>. Only a role that has another colour on
    both sides has a penalty and a weight; one that comes or goes is told, its colours count in the palette."""
    there = lambda roles: F.filter(roles, lambda s: (F.trim(s["value"]) != "") & (F.coalesce(s["alpha"], F.lit(1.0)) != 0))

    def one(role: Column) -> Column:
        last = lambda roles: F.try_element_at(F.filter(there(roles), lambda s: s["key"] == role), F.lit(-1))

        def told(v: Column) -> Column:
            x, y, label, w = v["x"], v["y"], F.concat(F.lit("semantic."), role), role_weight(role)

            def both(d: Column) -> Column:
                delta = F.when(d < FAR, tenth(d))
                new = change("color", "changed", label, x["value"], y["value"], delta, F.when(d <= CHANGED_E, d / CHANGED_E * w).otherwise(w))
                return F.when(d > SAME_E, F.struct(new.alias("change"), w.alias("weight")))

            only = lambda new: F.struct(new.alias("change"), F.lit(0.0).alias("weight"))
            moved = let(color_distance(x, y), both)
            return F.when(x.isNotNull() & y.isNotNull(), moved).when(x.isNotNull(), only(change("color", "removed", label, before=x["value"]))).when(y.isNotNull(), only(change("color", "added", label, after=y["value"])))

        return let(F.struct(last(b).alias("x"), last(c).alias("y")), told)

    names = F.array_sort(F.array_distinct(F.concat(F.transform(b, lambda s: s["key"]), F.transform(c, lambda s: s["key"]))))
    return F.filter(F.transform(names, one), lambda x: x.isNotNull())


def type_changes(b: Column, c: Column) -> Column:
    """Styles of a context, the one with the fewest differing fields first."""
    context = lambda t: F.lower(F.trim(t["key"]))

    def distance(x, y):
        return (x["family"] != y["family"]).cast("double") + (x["font_weight"] != y["font_weight"]).cast("double") + (pct(x["num"], y["num"]) > SAME_PCT).cast("double")

    def told(kind, x, y, d):
        if kind == "removed":
            return change("typography", kind, x["key"], before=x["value"], penalty=1.0)
        if kind == "added":
            return change("typography", kind, y["key"], after=y["value"], penalty=0.5)
        size = pct(x["num"], y["num"])
        severity = (x["family"] != y["family"]).cast("double") + 0.5 * (x["font_weight"] != y["font_weight"]).cast("double") + F.when(size > SAME_PCT, F.least(F.lit(1.0), size / CHANGED_PCT)).otherwise(0.0)
        return F.when(d > 0, change("typography", kind, x["key"], x["value"], y["value"], None, F.least(F.lit(1.0), severity)))

    own = lambda side, k: F.filter(side, lambda t: context(t) == k)
    contexts = F.array_distinct(F.concat(F.transform(b, context), F.transform(c, context)))
    return F.flatten(F.transform(contexts, lambda k: let(F.struct(own(b, k).alias("b"), own(c, k).alias("c")), lambda v: matched(v["b"], v["c"], distance, 3.0, told))))


def size_changes(category: str, b: Column, c: Column) -> Column:
    def told(kind, x, y, d):
        if kind == "removed":
            return change(category, kind, x["value"], before=x["value"], penalty=1.0)
        if kind == "added":
            return change(category, kind, y["value"], after=y["value"], penalty=0.5)
        return F.when(d > SAME_PCT, change(category, kind, x["value"], x["value"], y["value"], tenth(d), d / CHANGED_PCT))

    return matched(b, c, lambda x, y: pct(x["num"], y["num"]), CHANGED_PCT, told)


def shadow_changes(b: Column, c: Column) -> Column:
    """Shadows of one side only, by their text with single spaces."""
    plain = lambda side: F.transform(side, lambda t: t["plain"])
    gone = F.transform(F.filter(b, lambda t: ~F.array_contains(plain(c), t["plain"])), lambda t: change("shadow", "removed", t["value"], before=t["value"], penalty=1.0))
    new = F.transform(F.filter(c, lambda t: ~F.array_contains(plain(b), t["plain"])), lambda t: change("shadow", "added", t["value"], after=t["value"], penalty=0.5))
    return F.concat(gone, new)


def compared(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """A row per pair: its changes by category, the sizes of both sides, and the weights of the colours."""
    each = snapshots(tokens)
    side = lambda s: each.select(F.col("snapshot_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in (*WEIGHTS, "semantic")))
    rows = pairs.join(side("base"), "base_id").join(side("cand"), "cand_id")
    b, c = ({n: F.col(f"{s}_{n}") for n in (*WEIGHTS, "semantic")} for s in ("base", "cand"))
    total = F.aggregate(b["color"], F.lit(0.0), lambda a, t: a + color_weight(t, b["semantic"]))
    return rows.select(
        "pair_id", color_changes(b["color"], c["color"], b["semantic"], c["semantic"]).alias("color"), role_changes(b["semantic"], c["semantic"]).alias("roles"),
        type_changes(b["typography"], c["typography"]).alias("typography"), *(size_changes(n, b[n], c[n]).alias(n) for n in ("spacing", "radius")),
        shadow_changes(b["shadow"], c["shadow"]).alias("shadow"), total.alias("color_weight"),
        *(F.size(side[n]).alias(f"{s}_{n}") for s, side in (("base", b), ("cand", c)) for n in (*WEIGHTS, "semantic")),
    )


def degraded_categories(meta: DataFrame) -> DataFrame:
    """snapshot_id, category: what failed stages (meta: snapshot_id, degraded and errors, arrays of stage names) make incomparable."""
    known = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    stages = F.array_union(F.coalesce("degraded", F.array().cast("array<string>")), F.coalesce("errors", F.array().cast("array<string>")))
    return meta.select("snapshot_id", F.explode(stages).alias("stage")).select("snapshot_id", F.try_element_at(known, F.col("stage")).alias("category")).where("category is not null").distinct()


def without(rows: DataFrame, pairs: DataFrame, degraded: DataFrame) -> DataFrame:
    """compared() rows with the array of the categories that are degraded on either side of the pair."""
    bad = pairs.select("pair_id", F.explode(F.array("base_id", "cand_id")).alias("snapshot_id")).join(degraded, "snapshot_id")
    return rows.join(bad.groupBy("pair_id").agg(F.collect_set("category").alias("bad")), "pair_id", "left")


def changes(rows: DataFrame) -> DataFrame:
    """pair_id and the fields of CHANGE: all changes of the comparable categories; those of semantic roles count as colour."""
    bad = F.coalesce("bad", F.array().cast("array<string>")) if "bad" in rows.columns else F.array().cast("array<string>")
    every = F.concat("color", F.transform("roles", lambda r: r["change"]), "typography", "spacing", "radius", "shadow")
    return rows.select("pair_id", F.explode(F.filter(every, lambda x: ~F.array_contains(bad, x["category"]))).alias("x")).select("pair_id", "x.*")


def kinds(own: Column, kind: str) -> Column:
    return F.size(F.filter(own, lambda x: x["kind"] == kind))


def categories(rows: DataFrame) -> DataFrame:
    """pair_id, category, score (0-1), changed, added, removed, weight, comparable (something there, and not degraded), bad (degraded)."""
    found = []
    for c, w in WEIGHTS.items():
        own = F.concat("color", F.transform("roles", lambda r: r["change"])) if c == "color" else F.col(c)
        base, cand = F.col(f"base_{c}"), F.col(f"cand_{c}")
        penalty = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["penalty"])
        whole = F.col("color_weight") + F.aggregate("roles", F.lit(0.0), lambda a, r: a + r["weight"]) if c == "color" else base.cast("double")
        score = F.when(whole > 0, F.least(F.lit(1.0), penalty / whole)).otherwise(F.when(cand > 0, 1.0).otherwise(0.0))
        if c == "typography":
            peak = F.array_max(F.transform(own, lambda x: F.when(x["kind"] == "removed", 0.6).otherwise(x["penalty"])))
            score = F.greatest(score, 0.5 * F.coalesce(peak, F.lit(0.0)))
        there = base + cand > 0
        if c == "color":
            there = there | (F.col("base_semantic") + F.col("cand_semantic") > 0)
        bad = F.coalesce(F.array_contains("bad", c), F.lit(False)) if "bad" in rows.columns else F.lit(False)
        counts = [F.when(bad, F.lit(0)).otherwise(kinds(own, k)).cast("long").alias(k) for k in ("changed", "added", "removed")]
        found.append(F.struct(F.lit(c).alias("category"), F.when(bad, 0.0).otherwise(score).alias("score"), *counts, F.lit(w).alias("weight"), (there & ~bad).alias("comparable"), bad.alias("bad")))
    return rows.select("pair_id", F.explode(F.array(*found)).alias("x")).select("pair_id", "x.*")


def reports(rated: DataFrame) -> DataFrame:
    """pair_id, score (0-100), status, changed, added, removed, inconclusive (degraded, and nothing else to compare)."""
    w = F.when(F.col("comparable"), F.col("weight"))
    out = rated.groupBy("pair_id").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("mean"), F.bool_or("bad").alias("some_bad"), *(F.sum(k).alias(k) for k in ("changed", "added", "removed")))
    score = F.floor(F.coalesce("mean", F.lit(0.0)) * 100 + 0.5).cast("long")
    return out.select("pair_id", score.alias("score"), F.when(score > LIMIT, "drift").otherwise("stable").alias("status"), "changed", "added", "removed", (F.col("mean").isNull() & F.col("some_bad")).alias("inconclusive"))


def verdict(status: Column, inconclusive: Column) -> Column:
    """The gate's exit code: 1 drift, 2 inconclusive, 0 else."""
    return F.when(inconclusive, 2).when(status == "drift", 1).otherwise(0)


def annotations(reported: DataFrame, changed: DataFrame, warned: DataFrame | None = None) -> DataFrame:
    """pair_id, n, line: the lines of every pair that drifts, from 1: the verdict, its warnings, then each change; additions
    warn, others are errors. Texts are escaped."""
    escape = lambda c, *more: _replaced(c, ("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *more)
    number = lambda c: c.cast("string")
    drifting = reported.where("status = 'drift'")
    title = escape(F.concat(F.lit("Design drift "), number(F.col("score")), F.lit(f" exceeds threshold {LIMIT}")), (":", "%3A"), (",", "%2C"))
    sums = F.concat(number(F.col("changed")), F.lit(" changed, "), number(F.col("added")), F.lit(" added, "), number(F.col("removed")), F.lit(" removed"))
    none = F.lit(None)
    order = F.struct(F.lit(0).alias("part"), none.cast("double").alias("delta"), *(F.lit("").alias(c) for c in ("category", "kind", "label", "before", "after")))
    lines = drifting.select("pair_id", order.alias("at"), F.concat(F.lit("::error title="), title, F.lit("::"), sums).alias("line"))
    if warned is not None:
        about = F.struct(F.lit(1).alias("part"), none.cast("double").alias("delta"), F.col("warning").alias("category"), *(F.lit("").alias(c) for c in ("kind", "label", "before", "after")))
        lines = lines.union(warned.join(drifting.select("pair_id"), "pair_id", "left_semi").select("pair_id", about, F.concat(F.lit("::warning title=Drift comparison caveat::"), escape(F.col("warning")))))
    before, after = (F.nullif(F.col(c), F.lit("")) for c in ("before", "after"))
    move = F.when(before.isNotNull() & after.isNotNull(), F.concat(F.lit(" "), before, F.lit(" -> "), after)).when(before.isNotNull(), F.concat(F.lit(" "), before, F.lit(" removed"))).when(after.isNotNull(), F.concat(F.lit(" "), after, F.lit(" new"))).otherwise("")
    tenth_ = tenth(F.col("delta"))
    by = F.when(F.col("delta").isNotNull(), F.concat(F.lit(", delta "), F.when(tenth_ == F.floor(tenth_), number(tenth_.cast("long"))).otherwise(number(tenth_)))).otherwise("")
    said = F.concat(F.coalesce("label", F.lit("")), move, F.lit(" (token-drift:"), F.col("category"), by, F.lit(")"))
    place = F.struct(F.lit(2).alias("part"), (-F.col("delta")).alias("delta"), "category", "kind", *(F.coalesce(c, F.lit("")).alias(c) for c in ("label", "before", "after")))
    each = changed.join(drifting.select("pair_id"), "pair_id", "left_semi").select("pair_id", place, F.concat(F.lit("::"), F.when(F.col("kind") == "added", "warning").otherwise("error"), F.lit("::"), escape(said)))
    at = F.col("at")
    nth = F.row_number().over(Window.partitionBy("pair_id").orderBy(at["part"], F.asc_nulls_last(at["delta"]), *(at[c] for c in ("category", "kind", "label", "before", "after"))))
    return lines.union(each).select("pair_id", nth.cast("long").alias("n"), "line")


def _replaced(text_: Column, *pairs: tuple[str, str]) -> Column:
    for one, other in pairs:
        text_ = F.replace(text_, F.lit(one), F.lit(other))
    return text_


def warnings(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """pair_id, warning: what makes a pair hard to compare.

    meta: snapshot_id, url, width, dark, mobile, fonts_ready, degraded (array).
    """
    side = lambda s: meta.select(*(F.col(c).alias(f"{s}_id" if c == "snapshot_id" else f"{s}_{c}") for c in meta.columns))
    both = pairs.join(side("base"), "base_id").join(side("cand"), "cand_id")
    rule = lambda when, name: F.when(when, name)
    found = F.array_compact(F.array(
        rule((F.col("base_width") > 0) & (F.col("cand_width") > 0) & (F.col("base_width") != F.col("cand_width")), "viewport"),
        rule(text.page_identity(F.col("base_url")) != text.page_identity(F.col("cand_url")), "page"),
        rule(F.col("base_dark") != F.col("cand_dark"), "dark-mode"),
        rule(F.col("base_mobile") != F.col("cand_mobile"), "mobile"),
        rule(~F.col("base_fonts_ready") | ~F.col("cand_fonts_ready"), "fonts"),
        rule((F.size("base_degraded") > 0) | (F.size("cand_degraded") > 0), "degraded"),
    ))
    return both.select("pair_id", F.explode(found).alias("warning"))


def gate(reported: DataFrame, run: Column) -> DataFrame:
    """run, pages, drifted, failed, verdict: the gate over all pairs of a run."""
    code = verdict(F.col("status"), F.col("inconclusive"))
    out = reported.groupBy(run.alias("run")).agg(F.count("*").alias("pages"), F.count_if(code == 1).alias("drifted"), F.count_if(code == 2).alias("failed"))
    return out.withColumn("verdict", F.when(F.col("drifted") > 0, 1).when(F.col("failed") > 0, 2).otherwise(0))
