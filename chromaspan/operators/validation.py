"""Validation of token documents: rule tables joined to the node table, references and inheritance followed to their ends.

violations() types nodes from the tokens' values downwards: a table of slots says which members or items a value of a type
has and what type they are of, so each round joins the typed nodes with their children. A reference in braces names a
token, one by pointer ({"$ref": "#/..."}) any node; both are followed by doubling before the rounds.

All joins are by document and more. Where functions take ``buckets``, tables are in that many buckets by document (see
``lineage.cut``), so that nodes are not shuffled again for each join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaspan.lineage import cut, together
from chromaspan.operators.nodes import buckets_of, escaped, followed, nodes

#: Types, reserved names, style and weight names, units.
TYPES = ("color", "dimension", "fontFamily", "fontWeight", "duration", "cubicBezier", "number", "strokeStyle", "border", "transition", "shadow", "gradient", "typography")
RESERVED = ("$value", "$type", "$description", "$extensions", "$deprecated", "$extends", "$ref", "$schema")
STROKES = ("solid", "dashed", "dotted", "double", "groove", "ridge", "outset", "inset")
LINE_CAPS = ("round", "butt", "square")
WEIGHTS = ("thin", "hairline", "extra-light", "ultra-light", "light", "normal", "regular", "book", "medium", "semi-bold", "demi-bold", "bold", "extra-bold", "ultra-bold", "black", "heavy", "extra-black", "ultra-black")
#: Colour spaces with the ranges of their three components. None is unbounded; "hue" is 0 to 360 without 360.
UNIT, PERCENT, ANY, POSITIVE, HUE = (0, 1), (0, 100), (None, None), (0, None), "hue"
SPACES = {
    "srgb": (UNIT, UNIT, UNIT), "srgb-linear": (UNIT, UNIT, UNIT), "hsl": (HUE, PERCENT, PERCENT), "hwb": (HUE, PERCENT, PERCENT),
    "lab": (PERCENT, ANY, ANY), "lch": (PERCENT, POSITIVE, HUE), "oklab": (UNIT, ANY, ANY), "oklch": (UNIT, POSITIVE, HUE),
    "display-p3": (UNIT, UNIT, UNIT), "a98-rgb": (UNIT, UNIT, UNIT), "prophoto-rgb": (UNIT, UNIT, UNIT), "rec2020": (UNIT, UNIT, UNIT),
    "xyz-d65": (ANY, ANY, ANY), "xyz-d50": (ANY, ANY, ANY),
}
#: Members of values by type, with their types; those with a question mark may be left out.
SHADOW = "color:color offsetX:dimension offsetY:dimension blur:dimension spread:dimension inset:flag?"
MEMBERS = {
    "border": "color:color width:dimension style:strokeStyle",
    "transition": "duration:duration delay:duration timingFunction:cubicBezier",
    "shadow": SHADOW, "one shadow": SHADOW, "stop": "color:color position:number",
    "typography": "fontFamily:fontFamily fontSize:dimension fontWeight:fontWeight letterSpacing:dimension lineHeight:number",
    "strokeStyle": "dashArray:dashes lineCap:cap", "dimension": "value:amount unit:length", "duration": "value:amount unit:time",
    "color": "components:components hex:hex? alpha:alpha?",
}
ITEMS = {"shadow": "one shadow", "gradient": "stop", "dashes": "dimension", "components": "component", "cubicBezier": "bezier"}
#: What may stand in braces, or be a pointer, below a token's value.
BRACED = ("color", "dimension", "duration", "cubicBezier", "strokeStyle", "fontWeight", "fontFamily", "number", "one shadow", "stop")
POINTED = ("color", "dimension", "duration", "cubicBezier", "strokeStyle", "fontWeight", "fontFamily", "number", "component", "amount", "length", "time")
#: Categories of errors that are not about a value, and what to do about each rule.
CATEGORY = {
    "empty": "structure", "invalid JSON": "structure", "root": "structure", "missing value": "structure", "unknown type": "type", "no type": "type",
    "name characters": "naming", "missing reference": "reference", "circular reference": "reference", "missing pointer": "reference", "circular pointer": "reference", "pointer form": "reference",
}
ADVICE = {
    "empty": "give a document", "invalid JSON": "look for missing commas, brackets or quotes", "root": "put the tokens into an object", "missing value": "add $value",
    "unknown type": "use one of the 13 types", "no type": "add $type to the token or its group", "name characters": "leave out dots, braces and quotes", "name with $": "use $ for reserved names only",
    "no colorSpace": "add colorSpace", "unknown colorSpace": "use one of the 14 colour spaces", "component range": "keep to the colour space's range", "bare color": "give colorSpace and components",
    "bare dimension": "give value and unit", "bare duration": "give value and unit", "length": "use px or rem", "time": "use ms or s",
    "missing reference": "name a token that exists", "circular reference": "break the circle", "missing pointer": "point to a member that exists", "circular pointer": "break the circle",
}


def is_braced(text: Column) -> Column:
    return text.rlike(r"(?s)^\{.+\}$")


def inside_braces(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^\{(.+)\}$", 1)


def pointers(table: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, at, to, bad: each object with a textual $ref, the node that it leads to in the end, and why it does not (null,
    'pointer form', 'missing pointer' or 'circular pointer')."""
    said = table.where("name = '$ref' and kind = 'string'").select("doc_id", F.col("up").alias("at"), "text")
    said = said.withColumn("to", F.when(F.col("text").isin("#", "#/"), "").when(F.col("text").startswith("#/"), F.expr("substring(text, 2)")))
    ends = followed(said.where("to is not null").select("doc_id", "at", "to"), buckets)
    there = table.select("doc_id", F.col("at").alias("to"), F.lit(True).alias("there"))
    wrong = said.where("to is null").select("doc_id", F.col("at").alias("to"), F.lit(True).alias("wrong"))
    ends = ends.join(there, ["doc_id", "to"], "left").join(wrong, ["doc_id", "to"], "left")
    bad = F.when(F.col("state") == "cycle", "circular pointer").when(F.col("there").isNull(), "missing pointer").when(F.col("wrong"), "pointer form")
    malformed = said.where("to is null").select("doc_id", "at", F.lit(None).cast("string").alias("to"), F.lit("pointer form").alias("bad"))
    return cut(ends.select("doc_id", "at", "to", bad.alias("bad")), malformed, by="doc_id", buckets=buckets)


def references(table: DataFrame, pointed: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, at, to, type, bad: each text in braces, the node of the value that it leads to in the end with its token's
    type, and why it does not (null, 'missing reference' or 'circular reference')."""
    tokens = table.where("token").select("doc_id", "at", "path", "type")
    own = table.where("name = '$value'").select("doc_id", F.col("up").alias("at"), F.col("at").alias("own"))
    said = table.where("name = '$ref' and kind = 'string'").select("doc_id", F.col("up").alias("at"), F.when(F.col("text").startswith("#/"), F.expr("substring(text, 2)")).alias("said"))
    kept = lambda *rows: cut(*rows, by="doc_id", buckets=buckets)
    places = kept(tokens.join(own, ["doc_id", "at"], "left").join(said, ["doc_id", "at"], "left").select("doc_id", "path", "type", F.coalesce("own", "said").alias("place")))
    named = places.groupBy("doc_id", F.col("path").alias("target")).agg(F.max("place").alias("to"))
    braced = table.where((F.col("kind") == "string") & is_braced(F.col("text"))).select("doc_id", "at", inside_braces(F.col("text")).alias("target"))
    edges = kept(braced.join(named, ["doc_id", "target"], "left").select("doc_id", "at", "to"))
    ends = followed(edges.where("to is not null"), buckets)
    lost = edges.where("to is null").select("doc_id", "at")
    ends = kept(ends, lost.select("doc_id", "at", F.col("at").alias("to"), F.lit("ok").alias("state")))
    ends = ends.join(lost.select("doc_id", F.col("at").alias("to"), F.lit(True).alias("lost")), ["doc_id", "to"], "left")
    types = places.groupBy("doc_id", F.col("place").alias("to")).agg(F.max("type").alias("type"))
    bad = F.when(F.col("state") == "cycle", "circular reference").when(F.col("lost"), "missing reference")
    return kept(ends.join(types, ["doc_id", "to"], "left").select("doc_id", "at", "to", "type", bad.alias("bad")))


def extension_errors(table: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, path, rule of groups whose chain of $extends is not one of groups."""
    said = table.where("name = '$extends'").select("doc_id", F.col("up").alias("at"), "kind", "text")
    dotted = F.concat(F.lit("/"), F.array_join(F.transform(F.split(inside_braces(F.col("text")), r"\."), escaped), "/"))
    to = F.when(F.col("kind") == "string", F.when(is_braced(F.col("text")), dotted).when(F.col("text").isin("#", "#/"), "").when(F.col("text").startswith("#"), F.expr("substring(text, 2)")))
    said = cut(said.select("doc_id", "at", to.alias("to")), by="doc_id", buckets=buckets)
    plain = table.where("kind = 'object' and not held").select("doc_id", "at")
    ends = followed(said.where("to is not null").join(plain, ["doc_id", "at"], "left_semi"), buckets)
    target = table.select("doc_id", F.col("at").alias("to"), F.col("kind").alias("end_kind"), "held")
    wrong = said.where("to is null").select("doc_id", F.col("at").alias("to"), F.lit(True).alias("wrong"))
    rule = F.when(F.col("state") == "cycle", "extends circle").when(F.col("end_kind").isNull(), "extends missing").when(F.col("end_kind") != "object", "extends no group").when(F.col("held"), "extends token").when(F.col("wrong"), "extends form")
    found = ends.join(target, ["doc_id", "to"], "left").join(wrong, ["doc_id", "to"], "left").select("doc_id", "at", rule.alias("rule"))
    found = found.union(said.where("to is null").select("doc_id", "at", F.lit("extends form"))).where("rule is not null")
    groups = table.where("live and kind = 'object' and not token").select("doc_id", "at", F.when(F.col("at") == "", "root").otherwise(F.col("path")).alias("path"))
    return found.join(groups, ["doc_id", "at"]).select("doc_id", "path", "rule")


def _own_rule() -> Column:
    """The rule that a typed node breaks by itself; null if none."""
    type_, kind, text, n = (F.col(c) for c in ("type", "kind", "text", "n"))
    number = text.cast("double")
    is_a = lambda *kinds: kind.isin(*kinds)
    of = lambda t, *cases: [F.when((type_ == t) & when, rule) for rule, when in cases]
    form = lambda t, *kinds: of(t, (f"{t} form", ~is_a(*kinds)))
    rules = [
        *of("color", ("bare color", is_a("string")), ("color form", ~is_a("object", "array")), ("no colorSpace", F.coalesce("space", F.lit("")).isin("", "0", "false")), ("unknown colorSpace", ~F.col("space").isin(*SPACES)),
            ("components form", F.coalesce("components", F.lit("")) != "array"), ("component count", F.col("component_count") != 3)),
        *of("dimension", ("bare dimension", ~is_a("object"))), *of("duration", ("bare duration", ~is_a("object"))),
        *of("amount", ("amount", ~is_a("number"))), *of("length", ("length", ~is_a("string") | ~text.isin("px", "rem"))), *of("time", ("time", ~is_a("string") | ~text.isin("ms", "s"))),
        *form("fontFamily", "string", "array"), *form("number", "number"),
        *of("fontWeight", ("fontWeight range", is_a("number") & ~number.between(1, 1000)), ("fontWeight name", is_a("string") & ~text.isin(*WEIGHTS)), ("fontWeight form", ~is_a("number", "string"))),
        *of("cubicBezier", ("cubicBezier form", ~is_a("array") | (n != 4))),
        *of("bezier", ("cubicBezier number", ~is_a("number")), ("cubicBezier range", F.col("ord").isin(0, 2) & ~number.between(0, 1))),
        *of("strokeStyle", ("strokeStyle name", is_a("string") & ~text.isin(*STROKES)), ("strokeStyle form", ~is_a("string", "object", "array"))),
        *form("dashes", "array"), *of("cap", ("lineCap", ~is_a("string") | ~text.isin(*LINE_CAPS))),
        *(x for t in ("border", "transition", "typography", "shadow", "one shadow", "stop") for x in form(t, "object", "array")),
        *form("gradient", "array"), *form("flag", "boolean"),
        *of("component", ("component form", ~is_a("number") & ~(is_a("string") & (text == "none"))), ("component range", is_a("number") & F.when(F.col("hue"), (number < 0) | (number >= 360)).otherwise((number < F.coalesce("lo", number)) | (number > F.coalesce("hi", number))))),
        *of("hex", ("hex form", ~is_a("string") | ~text.rlike("^#[0-9a-fA-F]{6}$"))), *of("alpha", ("alpha form", ~is_a("number")), ("alpha range", ~number.between(0, 1))),
    ]
    return F.coalesce(*rules)


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slots (type, member, of, needed), items (type, of) and ranges (space, ord, lo, hi, hue): some tens of rows each."""
    slots = [(t, m.split(":")[0], m.split(":")[1].rstrip("?"), not m.endswith("?")) for t, of in MEMBERS.items() for m in of.split()]
    ranges = [(s, k, *((None, None, True) if r == HUE else (None if r[0] is None else float(r[0]), None if r[1] is None else float(r[1]), False))) for s, rs in SPACES.items() for k, r in enumerate(rs)]
    return tuple(F.broadcast(spark.createDataFrame(rows, schema)) for rows, schema in (
        (slots, "type string, member string, of string, needed boolean"), (list(ITEMS.items()), "type string, of string"), (ranges, "note string, ord long, lo double, hi double, hue boolean")))


def _values(table: DataFrame, pointed: DataFrame, named: DataFrame, buckets: int) -> DataFrame:
    """doc_id, path, at, type, rule: each token's own value, followed if it is a reference."""
    tokens = table.where("token").select("doc_id", "at", "path", "type")
    own = table.where("name = '$value'").select("doc_id", F.col("up").alias("at"), F.col("at").alias("own"))
    tokens = tokens.join(own, ["doc_id", "at"], "left").join(pointed, ["doc_id", "at"], "left")
    lost = F.when(F.col("own").isNull(), F.coalesce("bad", F.when(F.col("to").isNull(), "pointer form")))
    tokens = tokens.select("doc_id", "path", "type", F.coalesce("own", "to").alias("at"), lost.alias("rule"))
    ref = named.select("doc_id", "at", F.col("to").alias("end"), F.col("type").alias("end_type"), "bad")
    out = tokens.join(ref, ["doc_id", "at"], "left")
    return cut(out.select("doc_id", "path", F.coalesce("end", "at").alias("at"), F.coalesce("type", "end_type").alias("type"), F.coalesce("rule", "bad").alias("rule")), by="doc_id", buckets=buckets)


def violations(documents: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """doc_id, path, rule, severity of documents (doc_id, json); severity is error or warning."""
    spark = documents.sparkSession
    buckets = buckets_of(documents)
    table = nodes(documents, buckets) if table is None else cut(table, by="doc_id", buckets=buckets)
    slots, items, ranges = _tables(spark)
    error, warning = F.lit("error").alias("severity"), F.lit("warning").alias("severity")
    found = [table.where("at = '' and kind <> 'object'").select("doc_id", F.lit("").alias("path"), F.when(F.col("kind") == "empty", "empty").when(F.col("kind") == "invalid", "invalid JSON").otherwise("root").alias("rule"), error)]
    groups = table.where("live and not token").select("doc_id", F.col("at").alias("up"))
    named_here = table.join(groups, ["doc_id", "up"], "left_semi")
    dollar = F.col("name").startswith("$") & (F.col("name") != "$root")
    rule = F.when(dollar & ~F.col("name").isin(*RESERVED), "name with $").when(~dollar & F.col("name").rlike(r'[{}."]'), "name characters")
    found.append(named_here.select("doc_id", "path", rule.alias("rule"), error).where("rule is not null"))
    live = table.where("live").select("doc_id", "at", F.when(F.col("at") == "", "root").otherwise(F.col("path")).alias("path"), "held")
    marks = table.where("name = '$deprecated' and kind not in ('boolean', 'string')").select("doc_id", F.col("up").alias("at"))
    found.append(live.join(marks, ["doc_id", "at"], "left_semi").select("doc_id", "path", F.lit("deprecated form").alias("rule"), error))
    kids = table.where("up is not null").groupBy("doc_id", F.col("up").alias("at")).agg(F.bool_or(F.col("name") == "$type").alias("typed"), F.count_if(~dollar).alias("members"))
    found.append(live.where("at <> '' and not held").join(kids.where("typed and members = 0"), ["doc_id", "at"]).select("doc_id", "path", F.lit("missing value").alias("rule"), error))
    found.append(extension_errors(table, buckets).select("doc_id", "path", "rule", error))

    pointed = pointers(table, buckets)
    values = _values(table, pointed, references(table, pointed, buckets), buckets)
    found.append(values.where("rule is not null").select("doc_id", "path", "rule", error))
    values = values.where("rule is null").drop("rule")
    found.append(values.where("type is null").select("doc_id", "path", F.lit("no type").alias("rule"), error))
    found.append(values.where(~F.col("type").isin(*TYPES)).select("doc_id", "path", F.lit("unknown type").alias("rule"), warning))

    spaces = table.where("name in ('colorSpace', 'components')").groupBy("doc_id", F.col("up").alias("at")).agg(
        F.max(F.when(F.col("name") == "colorSpace", F.coalesce("text", F.lit("object")))).alias("space"), F.max(F.when(F.col("name") == "components", F.col("kind"))).alias("components"), F.max(F.when(F.col("name") == "components", F.col("n"))).alias("component_count"))
    facts = table.select("doc_id", "at", "kind", "text", "n")
    children = table.where("up is not null").select("doc_id", "up", "name", F.col("at").alias("child"), F.col("ord").alias("child_ord"))
    level = values.where(F.col("type").isin(*TYPES)).select("doc_id", "path", "at", "type", F.lit(None).cast("string").alias("note"), F.lit(0).cast("long").alias("ord"), F.lit(False).alias("below"))
    while not level.isEmpty():
        seen = level.join(pointed, ["doc_id", "at"], "left")
        moved = F.col("below") & F.col("type").isin(*POINTED)
        seen = seen.select("doc_id", "path", F.when(moved, F.coalesce("to", "at")).otherwise(F.col("at")).alias("at"), "type", "note", "ord", "below", F.when(moved, F.col("bad")).alias("bad"))
        seen = seen.join(facts, ["doc_id", "at"], "left").join(spaces, ["doc_id", "at"], "left").join(ranges, ["note", "ord"], "left")
        fine = F.col("below") & F.col("type").isin(*BRACED) & (F.col("kind") == "string") & is_braced(F.col("text"))
        seen = cut(seen.where(~F.coalesce(fine, F.lit(False))).withColumn("rule", F.coalesce("bad", _own_rule())), by="doc_id", buckets=buckets)
        found.append(seen.where("rule is not null").select("doc_id", "path", "rule", error))
        whole = seen.where("rule is null").select("doc_id", "path", F.col("at").alias("up"), "type", F.col("space").alias("note"), "kind", F.col("note").alias("given"))
        known = whole.where("type <> 'strokeStyle' or kind <> 'string'").where("type <> 'shadow' or kind <> 'array'").join(slots, "type").withColumnRenamed("member", "name").join(children, ["doc_id", "up", "name"], "left")
        found.append(known.where("child is null and needed").select("doc_id", "path", F.concat(F.lit("missing "), F.col("name")).alias("rule"), error))
        extra = whole.where("type = 'typography'").join(children, ["doc_id", "up"]).where(~F.col("name").isin(*(m.split(":")[0] for m in MEMBERS["typography"].split())))
        found.append(extra.select("doc_id", "path", F.lit("unknown member").alias("rule"), warning))
        inner = known.where("child is not null").select("doc_id", F.concat_ws(".", "path", "name").alias("path"), F.col("child").alias("at"), F.col("of").alias("type"), "note", F.lit(0).cast("long").alias("ord"), F.lit(True).alias("below"))
        listed = whole.where("kind = 'array'").join(items, "type").join(children, ["doc_id", "up"])
        listed = listed.select("doc_id", F.concat("path", F.lit("["), "name", F.lit("]")).alias("path"), F.col("child").alias("at"), F.col("of").alias("type"), F.col("given").alias("note"), F.col("child_ord").alias("ord"), F.lit(True).alias("below"))
        level = cut(inner, listed, by="doc_id", buckets=buckets)
    out = found[0]
    for rows in found[1:]:
        out = out.union(rows)
    with together(spark):
        return cut(out)


def categories(errors: DataFrame) -> DataFrame:
    """doc_id, category (structure, type, value, naming or reference), n, advice: the errors of each document by category,
    and what to do about them (an array of distinct texts, sorted)."""
    look = lambda of: F.try_element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col("rule"))
    rows = errors.where("severity = 'error'").select("doc_id", F.coalesce(look(CATEGORY), F.lit("value")).alias("category"), look(ADVICE).alias("advice"))
    return rows.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("advice")).alias("advice"))
