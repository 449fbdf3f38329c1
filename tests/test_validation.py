"""Token documents: node tables, pointers, rules by type, assembly."""

import json

import pytest
from pyspark.sql import functions as F

from chromaspan.operators import nodes, validation

RED = {"colorSpace": "srgb", "components": [1, 0, 0]}
PX = {"value": 1, "unit": "px"}
SHADOW = {"color": RED, "offsetX": PX, "offsetY": PX, "blur": PX, "spread": PX}
TYPE = {"fontFamily": "F", "fontSize": PX, "fontWeight": 400, "letterSpacing": PX, "lineHeight": 1.5}


def color(space, *parts, **more):
    return {"colorSpace": space, "components": list(parts), **more}


def token(type_, value):
    return {"t": {"$type": type_, "$value": value}}


def without(value, member):
    return {k: v for k, v in value.items() if k != member}


#: A document and the rules that it breaks.
CASES = [
    ({}, []), ([], ["root"]), ("{oops", ["invalid JSON"]), ("", ["empty"]), (None, ["empty"]), (3, ["root"]),
    (token("color", "#0066cc"), ["bare color"]), (token("color", "#0066cc80"), ["bare color"]), (token("color", 3), ["color form"]),
    *((token("color", color(s, 0.5, 0.5, 0.5)), []) for s in validation.SPACES),
    (token("color", color("srgb", 1, 0, 0, hex="#ff0000", alpha=0.5)), []), (token("color", color("cmyk", 0, 0, 0)), ["unknown colorSpace"]), (token("color", {"components": [0, 0, 0]}), ["no colorSpace"]),
    (token("color", {"colorSpace": "srgb"}), ["components form"]), (token("color", color("srgb", 0, 0)), ["component count"]), (token("color", color("srgb", 0, "x", 0)), ["component form"]),
    (token("color", color("hsl", "none", "none", 50)), []), (token("color", color("srgb", -0.1, 0, 1.1)), ["component range"] * 2), (token("color", color("hsl", 0, -1, 101)), ["component range"] * 2),
    (token("color", color("hsl", 360, 0, 0)), ["component range"]), (token("color", color("hsl", 359.9, 0, 0)), []), (token("color", color("lab", -1, -200, 900)), ["component range"]), (token("color", color("lab", 101, 0, 0)), ["component range"]),
    (token("color", color("lch", 50, -1, 10)), ["component range"]), (token("color", color("oklch", 0.5, 9, 360)), ["component range"]), (token("color", color("xyz-d65", -1, 1.2, 9)), []),
    (token("color", color("srgb", 0, 0, 0, alpha=2)), ["alpha range"]), (token("color", color("srgb", 0, 0, 0, alpha="1")), ["alpha form"]), (token("color", color("srgb", 0, 0, 0, hex="#fff")), ["hex form"]),
    (token("dimension", "8px"), ["bare dimension"]), (token("dimension", 8), ["bare dimension"]), (token("dimension", PX), []), (token("dimension", {"value": 1, "unit": "em"}), ["length"]), (token("dimension", {"unit": "px"}), ["missing value"]),
    (token("fontFamily", "Inter"), []), (token("fontFamily", ["Inter", "serif"]), []), (token("fontFamily", 3), ["fontFamily form"]),
    (token("fontWeight", 400), []), (token("fontWeight", "bold"), []), (token("fontWeight", "heaviest"), ["fontWeight name"]), (token("fontWeight", 0), ["fontWeight range"]), (token("fontWeight", 1001), ["fontWeight range"]), (token("fontWeight", True), ["fontWeight form"]),
    (token("duration", {"value": 200, "unit": "ms"}), []), (token("duration", {"value": 0.2, "unit": "s"}), []), (token("duration", {"value": 1, "unit": "min"}), ["time"]), (token("duration", "200ms"), ["bare duration"]),
    (token("cubicBezier", [0.4, 0, 0.2, 1]), []), (token("cubicBezier", [0, 0, 1]), ["cubicBezier form"]), (token("cubicBezier", [-0.1, 0, 0, 1]), ["cubicBezier range"]), (token("cubicBezier", [0, 5, 1.5, -5]), ["cubicBezier range"]), (token("cubicBezier", [0, "a", 0, 1]), ["cubicBezier number"]),
    (token("strokeStyle", "dashed"), []), (token("strokeStyle", "wavy"), ["strokeStyle name"]), (token("strokeStyle", {"dashArray": [PX], "lineCap": "round"}), []), (token("strokeStyle", {"lineCap": "round"}), ["missing dashArray"]),
    (token("strokeStyle", {"dashArray": [PX], "lineCap": "flat"}), ["lineCap"]), (token("strokeStyle", {"dashArray": ["2px"], "lineCap": "butt"}), ["bare dimension"]),
    (token("border", {"color": RED, "width": PX, "style": "solid"}), []), (token("border", {"width": PX, "style": "solid"}), ["missing color"]), (token("border", {"color": RED, "width": "1px", "style": "solid"}), ["bare dimension"]),
    (token("transition", {"duration": {"value": 1, "unit": "s"}, "delay": {"value": 0, "unit": "s"}, "timingFunction": [0, 0, 1, 1]}), []), (token("transition", {"delay": {"value": 0, "unit": "s"}, "timingFunction": [0, 0, 1, 1]}), ["missing duration"]),
    (token("shadow", SHADOW), []), (token("shadow", {**SHADOW, "inset": True}), []), (token("shadow", [SHADOW, SHADOW]), []), (token("shadow", without(SHADOW, "spread")), ["missing spread"]), (token("shadow", {**SHADOW, "inset": "yes"}), ["flag form"]), (token("shadow", [SHADOW, 3]), ["one shadow form"]),
    (token("gradient", [{"color": RED, "position": 0}, {"color": RED, "position": 3}]), []), (token("gradient", {"color": RED}), ["gradient form"]), (token("gradient", [{"position": 0}]), ["missing color"]), (token("gradient", [{"color": RED}]), ["missing position"]),
    (token("typography", TYPE), []), (token("typography", without(TYPE, "fontFamily")), ["missing fontFamily"]), (token("typography", without(TYPE, "fontSize")), ["missing fontSize"]), (token("typography", {**TYPE, "x": 1}), ["unknown member"]),
    ({"a.b": {"$type": "number", "$value": 1}}, ["name characters"]), ({"a{b": {"$type": "number", "$value": 1}}, ["name characters"]), ({"a-b_c 1": {"$type": "number", "$value": 1}}, []), ({"$odd": 1}, ["name with $"]),
    ({"g": {"$type": "number", "h": {"a": {"$value": 1}, "b": {"$value": "x"}}}}, ["number form"]), ({"t": {"$type": "color"}}, ["missing value"]), (token("colour", 1), ["unknown type"]), ({"t": {"$value": 1}}, ["no type"]),
    ({"t": {"$type": "number", "$value": 1, "$deprecated": True}}, []), ({"$deprecated": 3, "t": {"$type": "number", "$value": 1, "$deprecated": "old"}}, ["deprecated form"]), ({"g": {"$type": "number", "$root": {"$value": 2}, "x": {"$value": "{g.$root}"}}}, []),
    ({"c": {"$type": "color", "a": {"$value": RED}, "b": {"$value": "{c.a}"}}}, []), ({"a": {"b": {"$type": "color", "$value": RED}}, "x": {"$value": "{a.b}"}}, []), ({"x": {"$type": "color", "$value": "{no.such}"}}, ["missing reference"]),
    ({"a": {"$type": "color", "$value": RED}, "b": {"$value": "{a}"}, "c": {"$value": "{b}"}}, []), ({"a": {"$type": "color", "$value": "{b}"}, "b": {"$type": "color", "$value": "{a}"}}, ["circular reference"] * 2), ({"a": {"$type": "color", "$value": "{a}"}}, ["circular reference"]),
    ({"a": {"$type": "color", "$value": "{b}"}, "b": {"$type": "color", "$value": "{c}"}, "c": {"$type": "color", "$value": "{b}"}}, ["circular reference"] * 3), ({"a": {"$type": "dimension", "$value": PX}, "b": {"$type": "color", "$value": "{a}"}}, ["no colorSpace"]),
    (token("shadow", {**SHADOW, "color": "{c.a}"}), []), (token("shadow", ["{s.a}", SHADOW]), []), (token("gradient", [{"color": "{c}", "position": "{p}"}]), []), (token("typography", {k: "{x}" for k in TYPE}), []),
    ({"a": {"$type": "color", "$value": RED}, "b": {"$type": "color", "$ref": "#/a/$value"}}, []), ({"a": {"$type": "color", "$value": color("srgb", 0.2, 0, 0)}, "n": {"$type": "number", "$ref": "#/a/$value/components/0"}}, []),
    ({"a": {"$type": "color", "$value": RED}, "b": {"$type": "color", "$value": color("srgb", {"$ref": "#/a/$value/components/0"}, 0, 0)}}, []), ({"a": {"$type": "dimension", "$value": PX}, "b": {"$type": "dimension", "$value": {"value": {"$ref": "#/a/$value/value"}, "unit": {"$ref": "#/a/$value/unit"}}}}, []),
    ({"a": {"$type": "dimension", "$value": PX}, "b": {"$type": "dimension", "$value": {"value": {"$ref": "#/a/$value/unit"}, "unit": {"$ref": "#/a/$value/value"}}}}, ["amount", "length"]), ({"b": {"$type": "color", "$ref": "#/no/such"}}, ["missing pointer"]), ({"b": {"$type": "color", "$ref": "no"}}, ["pointer form"]),
    ({"a": {"$type": "color", "$ref": "#/b"}, "b": {"$type": "color", "$ref": "#/a"}}, ["circular pointer"] * 2), ({"x/y~z": {"$type": "number", "$value": 1}, "b": {"$type": "number", "$ref": "#/x~1y~0z/$value"}}, []),
    ({"a": {"$type": "color", "$value": RED}, "b": {"$value": "{a}"}, "c": {"$type": "color", "$ref": "#/b/$value"}}, []), (token("fontFamily", "{}"), []), (token("fontFamily", "{a"), []), (token("border", {"color": {"$ref": "#/none"}, "width": PX, "style": "solid"}), ["missing pointer"]),
    ({"g": {"a": {"$type": "number", "$value": 1}}, "h": {"$extends": "{g}", "b": {"$type": "number", "$value": 1}}}, []), ({"h": {"$extends": "{no}"}}, ["extends missing"]), ({"h": {"$extends": "h"}}, ["extends form"]), ({"g": {"$extends": "{h}"}, "h": {"$extends": "#/g"}}, ["extends circle"] * 2),
    ({"t": {"$type": "number", "$value": 1}, "h": {"$extends": "{t}"}}, ["extends token"]), ({"g": {"x": 1}, "h": {"$extends": "#/g/x"}}, ["extends no group"]), ({"g": {"$extends": "{no}"}, "h": {"$extends": "{g}"}}, ["extends missing"] * 2),
]


def test_rules_of_every_type(spark):
    said = [(k, d if d is None or isinstance(d, str) else json.dumps(d)) for k, (d, _) in enumerate(CASES)]
    got: dict[int, list] = {}
    for r in validation.violations(spark.createDataFrame(said, "doc_id long, json string")).collect():
        got.setdefault(r["doc_id"], []).append(r["rule"])
    wrong = [(d, sorted(got.get(k, [])), want) for k, (d, want) in enumerate(CASES) if sorted(got.get(k, [])) != sorted(want)]
    assert not wrong, wrong[:5]


def test_paths_of_errors_and_categories(spark):
    doc = {"g": {"$type": "shadow", "s": {"$value": [SHADOW, {**SHADOW, "color": color("srgb", 2, 0, 0)}]}}, "x": {"$type": "dimension", "$value": "8px"}, "y": {"$value": "{no}"}}
    rows = validation.violations(spark.createDataFrame([(7, json.dumps(doc))], "doc_id long, json string"))
    assert {(r["path"], r["rule"]) for r in rows.collect()} == {("g.s[1].color.components[0]", "component range"), ("x", "bare dimension"), ("y", "missing reference")}
    got = {r["category"]: (r["n"], r["advice"]) for r in validation.categories(rows).collect()}
    assert got == {"value": (2, ["give value and unit", "keep to the colour space's range"]), "reference": (1, ["name a token that exists"])}


def test_long_chains_and_circles_are_followed(spark):
    long = [(1, f"n{k}", f"n{k + 1}") for k in range(40)] + [(1, f"c{k}", f"c{(k + 1) % 7}") for k in range(7)] + [(1, "tail", "c3"), (2, "n1", "x")]
    got = {(r["doc_id"], r["at"]): (r["to"], r["state"]) for r in nodes.followed(spark.createDataFrame(long, "doc_id long, at string, to string")).collect()}
    assert len(got) == len(long) and all(got[1, f"n{k}"] == ("n40", "ok") for k in range(40)) and got[2, "n1"] == ("x", "ok")
    assert all(got[1, at][1] == "cycle" for at in [*(f"c{k}" for k in range(7)), "tail"])
    assert nodes.followed(spark.createDataFrame([], "doc_id long, at string, to string")).count() == 0


def test_assembly_is_the_inverse_of_flattening(spark):
    docs = [(1, {"a": {"b": {"c": {"d": {"e": {"f": 1}}, "x": "q\"uo\nte"}}, "z": [1, {"k": None}]}, "m": {}}), (2, {"only": True})]
    rows = nodes.nodes(spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "doc_id long, json string"))
    raw = {k: d for k, d in docs}

    def leaves(value, path):
        if isinstance(value, dict) and value:
            return [x for k, v in value.items() for x in leaves(v, [*path, k])]
        return [(path, json.dumps(value))]

    flat = [(k, path, n, said) for k, d in raw.items() for n, (path, said) in enumerate(leaves(d, []))]
    out = {r["doc_id"]: r["json"] for r in nodes.assemble(spark.createDataFrame(flat, "doc_id long, path array<string>, ord long, json string")).collect()}
    assert {k: json.loads(v) for k, v in out.items()} == raw and list(json.loads(out[1])) == ["a", "m"]
    deep = rows.where("doc_id = 1").agg(F.max(F.size(F.split("at", "/"))).alias("n")).first()["n"]
    assert deep == 7 and rows.count() == 1 + 1 + 1 + 5 + 1 + 1 + 1 + 1 + 1 + 1 + 1


@pytest.mark.parametrize("rows", [[], [(None, '{"a": {"$type": "number", "$value": "x"}}')]])
def test_no_documents_and_null_ids(spark, rows):
    assert validation.violations(spark.createDataFrame(rows, "doc_id long, json string")).where("rule is null").count() == 0


def test_nodes_in_buckets_are_joined_without_another_shuffle(spark):
    from chromaspan.lineage import TOGETHER, cut, together
    from chromaspan.operators import nodes

    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit('{"a":{"$type":"number","$value":1},"b":{"$ref":"#/a"}}').alias("json"))
    table = nodes.nodes(docs, 4)
    before = {k: spark.conf.get(k, None) for k in TOGETHER}
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with together(spark):
            kids = table.where("up is not null").groupBy("doc_id", F.col("up").alias("at")).agg(F.count("*").alias("kids"))
            plan = table.join(kids, ["doc_id", "at"], "left").select("n", "kids")
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
            assert plan.where("n <> coalesce(kids, 0)").isEmpty()
        both = cut(table.select("doc_id", "at"), table.select("doc_id", "at"), by="doc_id", buckets=4)
        assert both.count() == 2 * table.count() == 20 * 6 * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert before == {k: spark.conf.get(k, None) for k in TOGETHER}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cut_")]
    assert nodes.buckets_of(docs.limit(0)) == spark.sparkContext.defaultParallelism


def test_tables_in_buckets_are_not_broadcast_for_their_size(spark, monkeypatch):
    """Files of a few MB hold node tables of hundreds; only frames marked as small go through the driver."""
    from chromaspan import lineage

    plans, original = [], lineage.cut

    def cut(df, *more, by=None, buckets=None):
        with lineage.together(spark):
            plans.extend(rows._jdf.queryExecution().executedPlan().toString() for rows in (df, *more))
        return original(df, *more, by=by, buckets=buckets)

    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    for module in (nodes, validation):
        monkeypatch.setattr(module, "cut", cut)
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit('{"a":{"$type":"number","$value":1},"b":{"$ref":"#/c"},"c":{"$ref":"#/a"},"d":{"$type":"number","$value":"{a}"}}').alias("json"))
    table = nodes.nodes(docs, 4)
    pointed = validation.pointers(table, 4)
    assert pointed.where("bad is null and to = '/a'").count() == 2 * 20
    assert validation.references(table, pointed, 4).where("bad is null and to = '/a/$value'").count() == 20
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    plans.clear()
    assert {r["rule"] for r in validation.violations(docs).collect()} == {"no type"}  # of b and c
    small = [line for p in plans for line in p.splitlines() if "BroadcastExchange" in line]
    assert small and len(plans) > 10
    below = [b for p in plans for a, b in zip(p.splitlines(), p.splitlines()[1:], strict=False) if "BroadcastExchange" in a]
    assert not [b for b in below if "FileScan" in b]
