"""Colour notations, font faces, motion contexts and gradients on small inputs."""

from pyspark.sql import functions as F

from chromaspan.functions import color
from chromaspan.operators import effects, fonts

#: Worked by the CSS definitions: notation, and r, g, b, a or None.
NOTATIONS = {
    "hsl(240 100% 50%)": (0, 0, 255, 1.0),
    "hsla(120, 100%, 25%, 0.5)": (0, 128, 0, 0.5),
    "hsl(0.5turn 100% 50%)": (0, 255, 255, 1.0),
    "hwb(120 0% 0%)": (0, 255, 0, 1.0),
    "hwb(0 60% 60%)": (128, 128, 128, 1.0),
    "oklch(0.627966 0.257704 29.2346)": (255, 0, 0, 1.0),
    "oklab(62.7966% 0.22488 0.12585)": (255, 0, 0, 1.0),
    "lab(29.2345% 39.3825 20.0664)": (125, 35, 41, 1.0),
    "lch(54.29 106.84 40.85)": (255, 0, 0, 1.0),
    "color(srgb 1 0.5 0)": (255, 128, 0, 1.0),
    "color(srgb-linear 0.5 0.5 0.5)": (188, 188, 188, 1.0),
    "color(display-p3 1 1 1 / 50%)": (255, 255, 255, 0.5),
    "#336699": (51, 102, 153, 1.0),
    "hsl(foo)": None,
    "color(xyz 1 1 1)": (255, 255, 255, 1.0),
    "": None,
}


def test_notations(spark):
    rows = spark.createDataFrame([(t,) for t in NOTATIONS] + [(None,)], "t string")
    got = {r["t"]: r["rgba"] and tuple(r["rgba"]) for r in color.parsed(rows, "t").collect()}
    assert got == {**NOTATIONS, None: None}


def test_faces_of_other_hosts_are_not_custom(spark):
    rows = [(1, "'Own VF'", "url(/a.woff2)", None), (1, "Theirs", "url(https://fonts.gstatic.com/b.woff2)", None), (1, "Theirs", "local(x)", None), (1, "", "url(c)", None), (1, "Set", "url(d.woff2)", '"wght" 400')]
    got = {tuple(r) for r in fonts.faces(spark.createDataFrame(rows, "site long, family string, src string, variation string")).collect()}
    assert got == {(1, "Own VF", True, True), (1, "Theirs", False, False), (1, "Set", True, True)}


def test_axes_merge_to_the_widest_range(spark):
    axes = fonts.variable_axes(spark.createDataFrame([(1, '"wght" 600, "slnt" -4'), (1, '"wght" 300.5'), (1, None)], "site long, setting string"))
    assert {tuple(r) for r in fonts.merged_axes(axes).collect()} == {(1, "wght", 300.5, 600.0, 2), (1, "slnt", -4.0, -4.0, 1)}


def test_motion_contexts(spark):
    rows = [("button", None, None, "button"), ("DIV", None, "card-list menu", "nav"), ("div", None, "Tile", "card"), ("select", None, None, "input"), ("div", None, None, "other"), ("div", "link", "hero", "link")]
    frame = spark.createDataFrame(rows, "tag string, role string, hint string, want string")
    assert [r[0] for r in frame.select(effects.motion_context(F.col("tag"), F.col("role"), F.col("hint")) == F.col("want")).collect()] == [True] * 6


def test_gradient_layers(spark):
    image = "linear-gradient(90deg, rgb(1, 2, 3), hsla(calc(1 + 2), 3%, 4%, 1)), url(x.png), conic-gradient(#FFF, #000)"
    got = effects.gradients(spark.createDataFrame([(1, image), (1, None), (1, "none")], "site long, image string")).collect()
    assert [(r["kind"], r["n"]) for r in got] == [("conic", 1), ("linear", 1)]
    assert got[0]["stops"] == "#FFF #000"
