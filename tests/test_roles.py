"""Roles, accents and tokens that refer to them, by worked cases."""

from pyspark.sql import functions as F

from chromaspan.functions import color
from chromaspan.operators import roles

PALETTE = "site long, ord long, hex string, n long, confidence string, is_token boolean"
CANDIDATES = "site long, source int, ord long, hex string, confidence string"


def test_primary_yields_to_a_chromatic_token_only(spark):
    rows = [
        (1, 0, "#222222", 90, "high", False), (1, 1, "#0066cc", 5, "medium", True), (1, 2, "#cc3300", 9, "medium", False),  # dull name, token wins
        (2, 0, "#222222", 90, "high", False), (2, 1, "#0066cc", 50, "high", False),  # dull name, no strong colour
        (3, 0, "#0066cc", 5, "high", True), (3, 1, "#cc3300", 24, "medium", False), (3, 2, "#00cc33", 99, "low", False),  # token 20 ahead, low ones do not count
        (4, 0, "#0066cc", 30, "high", False), (4, 1, "#0055bb", 20, "high", False),  # no other hue
        (5, 0, "#808080", 30, "high", False)]
    ctas = spark.createDataFrame([(9, "#000000")], "site long, hex string")
    named = spark.createDataFrame([(1, "#222222"), (2, "#222222")], "site long, hex string")
    got = {r["site"]: (r["primary"], r["accent"]) for r in roles.primary_and_accent(spark.createDataFrame(rows, PALETTE), ctas, named).collect()}
    assert got == {1: ("#0066cc", "#cc3300"), 2: ("#222222", "#0066cc"), 3: ("#0066cc", "#cc3300"), 4: ("#0066cc", None), 5: (None, None)}
    cta = roles.primary_and_accent(spark.createDataFrame(rows, PALETTE), spark.createDataFrame([(2, "#0066cc"), (2, "#0066cc")], "site long, hex string"), named).where("site = 2").first()
    assert (cta["primary"], cta["accent"]) == ("#0066cc", None)


def test_roles_use_each_colour_once(spark):
    rows = [(1, 0, 0, "#FF0000", "high"), (1, 0, 1, "#fb0505", "high"), (1, 0, 2, "#0000ff", "medium"), (1, 0, 3, "#ffffff", "medium"), (1, 0, 4, "#000000", "medium"), (1, 0, 5, "#00ff00", "low"), (1, 1, 0, "#00ff00", None), (1, 2, 0, "bad", None), (1, 2, 1, None, None),
            (2, 0, 0, "#123456", "low"), (2, 1, 0, "#654321", None)]
    named = [(1, "accent", "#FF00FF"), (1, "error", "#990000"), (1, "primary", "#0000FF"), (3, "text", "#111111"), (3, "background", "#eeeeee")]
    got = [tuple(r) for r in roles.color_roles(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame(named, "site long, role string, hex string")).orderBy("site", "ord").collect()]
    # site 1: green of a button has the points of its palette row; red comes before it; blue is named. Site 2: two candidates only. Site 3: names only.
    assert got == [(1, 1, "primary", "#0000ff"), (1, 2, "secondary", "#ff0000"), (1, 3, "tertiary", "#ff00ff"), (1, 4, "surface", "#ffffff"), (1, 5, "on-surface", "#000000"), (1, 6, "error", "#990000"),
                   (2, 1, "primary", "#123456"), (2, 2, "secondary", "#654321"), (3, 4, "surface", "#eeeeee"), (3, 5, "on-surface", "#111111")]


def test_components_refer_to_roles_and_corners(spark):
    named = spark.createDataFrame([(1, 1, "primary", "#0066cc"), (1, 4, "surface", "#0066cc"), (1, 5, "on-surface", "#000000")], "site long, ord long, role string, hex string")
    corners = roles.rounded_names(spark.createDataFrame([(1, v) for v in (0, 12, 4, 4, 9999, 20, 8, 30)], "site long, px long"))
    assert {(r["name"], r["px"]) for r in corners.collect()} == {("none", 0), ("sm", 4), ("md", 8), ("lg", 12), ("xl", 20), ("full", 9999)}
    parts = [(1, "button", 0, None, "#ffffff", 4, 1), (1, "button", 1, "#0066CC", "#fff000", 9999, 8), (1, "button", 2, "#000000", None, 4, 8), (1, "input", 0, None, "#000000", 5, None)]
    out = roles.component_tokens(spark.createDataFrame(parts, "site long, kind string, ord long, background string, foreground string, radius long, padding long"), named, corners)
    assert {tuple(r) for r in out.collect()} == {(1, "button-observed", "{colors.primary}", "#fff000", "{rounded.full}", "8px"), (1, "input-observed", None, "{colors.on-surface}", "5px", None)}


def test_hues(spark):
    rows = spark.createDataFrame([("#ff0000", 0.0), ("#00ff00", 120.0), ("#0000ff", 240.0), ("#ff00ff", 300.0), ("#808080", -1.0)], "hex string, want double")
    assert rows.where(F.abs(color.hue(F.col("hex")) - F.col("want")) > 1e-9).collect() == []
    assert spark.range(1).select(color.hue_distance(F.lit(350.0), F.lit(10.0))).first()[0] == 20.0
