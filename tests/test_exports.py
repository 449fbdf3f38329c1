"""Token documents from token tables."""

import json

from chromaspan.operators import exports, validation


def sections(spark):
    palette = spark.createDataFrame([(1, "#0066CC", 9, "high"), (1, "#ffffff", 5, "medium"), (1, "#123456", 7, "low"), (2, "#000000", 3, "high")], "site long, hex string, n long, confidence string")
    roles = spark.createDataFrame([(1, "Call.To {Action}", 0, "rgb(0 102 204 / 50%)"), (1, "odd", 1, "var(--x)"), (1, "named", 2, "Tomato")], "site long, role string, ord long, value string")
    styles = spark.createDataFrame([(1, "body", 'Inter "X"', "16px (1.00rem)", "400", 1, None, "0.5em"), (1, "hero", "Serif", "120%", "700", 2, "1.2", None), (1, "body", "Serif", "1.5rem", None, 3, "24px", "normal")], "site long, context string, family string, size string, weight string, first long, line_height string, letter_spacing string")
    spacing = spark.createDataFrame([(1, 8, 4), (1, 16, 9)], "site long, px long, n long")
    radius = spark.createDataFrame([(1, "50%", 20, "high"), (1, "4px", 9, "medium"), (1, "2px", 1, "low")], "site long, radius string, n long, confidence string")
    border = spark.createDataFrame([(1, "1px", "solid", "#cccccc", 9, "high"), (1, "2px", "solid", "#cccccc", 8, "high"), (1, "1px", "dashed", "#000000", 7, "high")], "site long, width string, style string, hex string, n long, confidence string")
    shadow = spark.createDataFrame([(1, "0 1px  2px 0px #112233", 9, "high"), (1, "inset 0 0 1vw", 4, "medium")], "site long, shadow string, n long, confidence string")
    return [exports.semantic(roles), exports.colors(palette), exports.families(styles), exports.text_styles(styles), exports.spacings(spacing), exports.radii(radius), exports.borders(border), exports.shadows(shadow)]


def test_documents_have_objects_and_break_no_rule(spark, tmp_path):
    docs = exports.documents(*sections(spark))
    exports.write_documents(docs, str(tmp_path / "docs"))
    back = {r["doc_id"]: json.loads(r["json"]) for r in exports.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert back == {r["doc_id"]: json.loads(r["json"]) for r in docs.collect()} and set(back) == {1, 2}
    one = back[1]
    assert list(one) == ["color", "typography", "spacing", "radius", "border", "shadow"]
    assert one["color"]["semantic"] == {"call-to--action-": {"$type": "color", "$value": {"colorSpace": "srgb", "components": [0, 0.4, 0.8], "hex": "#0066cc", "alpha": 0.5}}, "named": {"$type": "color", "$value": {"colorSpace": "srgb", "components": [1, 0.388, 0.278], "hex": "#ff6347"}}}
    assert one["color"]["palette"]["palette-1"] == {"$type": "color", "$value": {"colorSpace": "srgb", "components": [0, 0.4, 0.8], "hex": "#0066cc"}, "$description": "Count: 9, Confidence: high"}
    assert list(one["color"]["palette"]) == ["palette-1", "palette-2"]
    assert one["typography"]["font-family"] == {'inter-"x"': {"$type": "fontFamily", "$value": 'Inter "X"'}, "serif": {"$type": "fontFamily", "$value": "Serif"}}
    assert one["typography"]["style"] == {"text-body": {"$type": "typography", "$value": {"fontFamily": "{typography.font-family.serif}", "fontSize": {"value": 1.5, "unit": "rem"}, "fontWeight": 400, "lineHeight": 24, "letterSpacing": {"value": 0, "unit": "px"}}}}
    assert [t["$value"]["value"] for t in one["spacing"].values()] == [16, 8]
    assert one["radius"] == {"radius-2": {"$type": "dimension", "$value": {"value": 4, "unit": "px"}}}
    assert {k: v["$value"]["value"] for k, v in one["border"]["width"].items()} == {"border-width-1": 1, "border-width-2": 2}
    assert {k: v["$value"]["hex"] for k, v in one["border"]["color"].items()} == {"border-color-1": "#cccccc", "border-color-2": "#000000"}
    assert one["shadow"]["shadow-1"]["$value"]["blur"] == {"value": 2, "unit": "px"} and one["shadow"]["shadow-1"]["$value"]["color"]["hex"] == "#112233"
    assert one["shadow"]["shadow-2"]["$value"]["blur"] == {"value": 0, "unit": "px"}
    rules = {(r["path"], r["rule"]) for r in validation.violations(docs).collect()}
    assert rules == {('typography.font-family.inter-"x"', "name characters")}  # the name's quotes are kept, as documents name families
