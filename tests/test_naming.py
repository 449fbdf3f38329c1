"""Names that authors gave, names made unique, names of elements."""

from pyspark.sql import functions as F

from chromaspan.functions import text
from chromaspan.operators import naming


def test_suffixes_that_meet_real_names(spark):
    names = ["a", "a-2", "a", "a", "a-2", "b", "a-2-2", "b"]
    rows = spark.createDataFrame([(1, k, n, k * 10) for k, n in enumerate(names)] + [(2, 0, "a", 0)], "site long, ord long, name string, more long")
    got = [tuple(r) for r in naming.unique_names(rows).orderBy("site", "ord").collect()]
    assert [g[2] for g in got] == ["a", "a-2", "a-3", "a-4", "a-2-2", "b", "a-2-2-2", "b-2", "a"]
    assert [g[3] for g in got] == [0, 10, 20, 30, 40, 50, 60, 70, 0]


def test_first_author_counts(spark):
    rows = [(1, 0, "--color-", "#0000ff"), (1, 1, "--colors-blue", "#0000FF"), (1, 2, "--navy", "#0000ff"), (1, 3, "--c-red", "#ff0000"), (1, 4, "--none", None)]
    got = {(r["hex"], r["name"]) for r in naming.authored_names(spark.createDataFrame(rows, "site long, ord long, name string, hex string")).collect()}
    assert got == {("#0000ff", "blue"), ("#ff0000", "red")}


def test_theme_colors(spark):
    semantic = spark.createDataFrame([(1, 0, "primary", "#0000ff"), (1, 1, "Brand 1", "#00ff00"), (1, 2, "???", "#ffffff"), (1, 3, "lost", "#0101fe")], "site long, ord long, role string, hex string")
    palette = spark.createDataFrame([(1, 0, "#0000fe", "high", False), (1, 1, "#ff0000", "medium", False), (1, 2, "#000000", "high", False), (1, 3, "#888888", "low", False), (1, 4, "#ffff00", "high", True), (1, 5, "#ff00ff", "high", False), (1, 6, None, "high", False)], "site long, ord long, hex string, confidence string, is_variant boolean")
    variables = spark.createDataFrame([(1, 0, "--color-primary", "#000000"), (1, 1, "--color-blue", "#0000ff")], "site long, ord long, name string, hex string")
    got = [tuple(r)[1:] for r in naming.theme_colors(semantic, palette, variables).orderBy("ord").collect()]
    assert got == [(1, "--color-primary", "#0000ff", "semantic"), (2, "--color-brand-1", "#00ff00", "semantic"), (3, "--color-token", "#ffffff", "semantic"), (4, "--color-brand-1-2", "#ff0000", "palette"), (5, "--color-primary-2", "#000000", "css variable"), (6, "--color-brand-2", "#ff00ff", "palette")]
    assert naming.theme_colors(semantic.limit(0), palette.limit(0), variables).collect() == []


def test_element_contexts(spark):
    rows = [("DIV", "x btn-x card", None, "button", "button"), ("DIV", "chip", "", "badge", "div"), ("IMG", None, None, "img", "img"), ("P", "avatar", None, "image", "p"), ("A", "card", "tab", "tab", "tab"), ("A", "Button", None, "a", "a"), ("A", "my-dialog", None, "modal", "modal")]
    frame = spark.createDataFrame(rows, "tag string, class string, said string, corner string, border string")
    own = lambda *kinds: text.element_context(F.col("tag"), F.col("class"), F.col("said"), *kinds)
    assert frame.where((own() != F.col("corner")) | (own(text.BORDER_CONTEXTS) != F.col("border"))).collect() == []
