"""What work is done for every element, and what once for each distinct value."""

from pyspark.sql import functions as F

from chromaspan.functions import color
from chromaspan.operators import elements, extract
from chromaspan.plans import catalog

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hex_of_channels(spark):
    rows = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (1, 171, 16), (None, 1, 2)], "r int, g int, b int")
    got = [x[0] for x in rows.select(color.to_hex(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert got == ["#000000", "#ffffff", "#01ab10", None]


def test_near_colors_tests_no_distance_on_elements(spark):
    assert "lineitem" not in plan_of(catalog.near_colors(spark, SF))


def test_finding_scores_read_statistics_not_elements(spark):
    plan = plan_of(catalog.finding_scores(spark, SF))
    assert plan.count("lineitem.parquet") == 1 and "format_string" not in plan  # once, for the list of sites


def test_page_logos_judge_marks_once(spark):
    plan = plan_of(catalog.QUERIES["page_logos"](spark, SF))
    assert plan.count("lineitem.parquet") == 1 and "RegExpReplace" not in plan and "regexp_replace" not in plan  # once, for the walls


def test_shadows_are_taken_apart_once_a_text(spark):
    obs = spark.createDataFrame([("a", 1, 2, "#000000")] * 7 + [("a", 2, 2, "#000000")] * 2, "site string, width int, radius int, hex string")
    got = {(r["shadow"], r["n"], r["confidence"], r["blur"]) for r in extract.shadow_histogram(obs).collect()}
    assert got == {("0px 1px 2px #000000", 7, "high", 2), ("0px 2px 2px #000000", 2, "low", 2)}
    plan = plan_of(extract.shadow_histogram(obs))
    assert plan.rindex("HashAggregate") > plan.rindex("regexp_replace")  # elements are counted before texts are looked at


def test_colours_are_taken_apart_once_a_text(spark):
    rows = [(1, "rgb(1, 2, 3)", "rgb(1, 2, 3)", "rgb(9, 9, 9) none #0a0b0c"), (2, None, "rgba(1, 2, 3, 0.2)", None), (3, "linear-gradient(#fff000, #00000010, red)", "red", "none"), (3, "transparent", "#FFF000", "")]
    painted = elements.painted(spark.createDataFrame(rows, "el_id int, bg string, fg string, border string"))
    got = sorted((r["el_id"], r["hex"], r["is_bg"]) for r in painted.collect())
    assert got == [(1, "#010203", True), (1, "#010203", True), (1, "#090909", False), (1, "#0a0b0c", False), (3, "#ff0000", True), (3, "#ff0000", True), (3, "#fff000", False), (3, "#fff000", True)]
    plan = plan_of(painted)
    assert painted.columns == ["el_id", "bg", "fg", "border", "hex", "is_bg"] and "EvalPython" not in plan and "regexp_extract_all" not in plan


def test_drift_reads_counts_not_elements(spark):
    assert "lineitem" not in plan_of(catalog.drift_reports(spark, SF))
    counts = catalog._counts(spark, SF)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Aggregate" in plan[plan.index("Generate") :]  # elements are counted before they become tokens
    got = {r["category"]: (r["n"], r["kinds"]) for r in counts.groupBy("category").agg(F.sum("count").alias("n"), F.countDistinct("value").alias("kinds")).collect()}
    obs = catalog.observations(spark, SF)
    n = obs.count()
    want = {"color": "hex", "spacing": "px", "radius": "radius", "shadow": "width, radius", "typography": "tag, width, px"}
    assert got == {k: (n, obs.selectExpr(*c.split(", ")).distinct().count()) for k, c in want.items()}
