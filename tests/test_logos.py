"""Logo rules against worked values."""

import pytest
from pyspark.sql import functions as F

from chromaspan.operators import logos


def test_home_links(spark):
    x = "https://x.com"
    cases = [("/", x, True), ("./", x, True), (x, x, True), (x + "/", x, True), ("HTTPS://X.COM/", x, True), (x + "/", x + "/", True), ("/about", x, False), (x + "/pricing", x, False), ("https://other.com", x, False), (None, x, False), ("", x, False), ("  ", x, False),
             (x, None, False), ("/en", x, True), ("/de/", x, True), ("/en-us", x, True), (x + "/en", x, True), ("/en/pricing", x, False), ("https://x.community", x, False)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, href string, origin string, want boolean")
    assert rows.where(logos.home_href(F.col("href"), F.col("origin")) != F.col("want")).collect() == []


def test_regions_and_sizes(spark):
    cases = [(0.0, 8000.0, "header"), (500.0, 8000.0, "header"), (7500.0, 8000.0, "footer"), (4000.0, 8000.0, "body"), (600.0, 900.0, "body"), (float("nan"), 8000.0, "header"), (None, 8000.0, "header"), (4000.0, float("nan"), "body"), (4000.0, None, "body"), (4000.0, 0.0, "body")]
    rows = spark.createDataFrame(cases, "top double, high double, want string")
    assert rows.where(logos.region(F.col("top"), F.col("high")) != F.col("want")).collect() == []
    sizes = spark.createDataFrame([(24.0, 24.0, True), (118.0, 13.0, True), (20.0, 20.0, False), (0.0, 99.0, False), (-5.0, 30.0, False), (None, 30.0, False), (float("inf"), 30.0, False)], "w double, h double, want boolean")
    assert sizes.where(logos.logo_sized(F.col("w"), F.col("h")) != F.col("want")).collect() == []


def test_other_brands(spark):
    cases = [("Globex logo", "acme", "globex"), ("Initech", "acme", "initech"), ("Acme Widgets Logo", "globex", "acmewidgets"), ("Acme logo", "acme", None), ("AcmeLogo", "acme", None), ("logo", "acme", None), ("Brand Icon", "acme", None), ("", "acme", None), ("X", "acme", None), (None, "acme", None), ("Globex logo", "", None),
             ("Globex logo", None, None), ("logo-initech-on-white.svg", "acme", "initech"), ("globex-logo-2023.svg", "globex", None), ("logo-white.svg", "acme", None)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, alt string, site string, want string")
    assert rows.where(~logos.third_party(F.col("alt"), F.col("site")).eqNullSafe(F.col("want"))).collect() == []


def test_positions(spark):
    cases = [("0%", 0.0), ("50%", 0.5), ("100%", 1.0), ("left", 0.0), ("right", 1.0), ("top", 0.0), (" Bottom ", 1.0), ("center", 0.5), ("12px", 0.5), ("150%", 1.0), ("-20%", 0.0), ("x%", 0.5), (None, 0.5)]
    rows = spark.createDataFrame(cases, "token string, want double")
    assert rows.where(logos.position_fraction(F.col("token")) != F.col("want")).collect() == []


@pytest.mark.parametrize("box, natural, fit, at, want", [
    ((10, 20, 200, 100), (400, 100), "cover", (0.5, 0.5), (10, 20, 200, 100)), ((0, 0, 200, 200), (400, 100), "contain", (0.5, 0.5), (0, 75, 200, 50)), ((0, 0, 200, 200), (400, 100), "contain", (0.5, 0.0), (0, 0, 200, 50)), ((0, 0, 200, 200), (400, 100), "contain", (0.5, 1.0), (0, 150, 200, 50)),
    ((0, 0, 200, 200), (40, 20), "scale-down", (0.5, 0.5), (80, 90, 40, 20)), ((5, 5, 100, 50), (None, 10), "contain", (0.5, 0.5), (5, 5, 100, 50)), ((5, 5, 100, 50), (0, 0), "contain", (0.5, 0.5), (5, 5, 100, 50)), ((0, 0, 0, 0), (100, 100), "contain", (0.5, 0.5), (0, 0, 0, 0)), ((float("nan"), None, None, -5), (None, None), None, (0.5, 0.5), (0, 0, 0, 0))])
def test_painted_boxes(spark, box, natural, fit, at, want):
    lit = lambda v: F.lit(v).cast("double")
    out = spark.range(1).select(logos.painted_box(*map(lit, box), *map(lit, natural), F.lit(fit).cast("string"), *map(lit, at)).alias("b")).first()["b"]
    assert tuple(out) == pytest.approx(want)


MARK = "page_id long, el_id long, tag string, alt string, class string, id string, src string, aria string, link string, link_aria string, zone string, ancestors array<struct<id: int, tag: string>>, x double, y double, width double, height double, natural_width double, natural_height double, fit string, at_x string, at_y string, doc_height int, site string, origin string"


def mark(el, ancestors, zone=None, y=10.0, alt="", link=None, klass="logo", tag="img", page=1):
    return (page, el, tag, alt, klass, None, "/a.png", None, link, None, zone, ancestors, 10.0, y, 100.0, 40.0, None, None, None, None, None, 4000, "acme", "https://acme.com")


def test_walls_keep_marks_that_link_home(spark):
    body, wall, other = (0, "body"), (1, "section"), (2, "div")
    rows = [mark(1, [body, (9, "header")], "header"), mark(2, [body, wall], y=300.0), mark(3, [body, wall, other], y=300.0), mark(4, [body, wall], y=300.0, link="/"), mark(5, [body, (3, "div")], y=300.0), mark(6, [body, (3, "div")], y=300.0, alt="Globex"), mark(7, [body], y=3900.0, link="/"), mark(8, [body], y=3900.0), mark(1, None, page=2, y=None)]
    got = {(r["page_id"], r["el_id"]): (r["context"], r["score"], r["rank"]) for r in logos.ranked(spark.createDataFrame(rows, MARK)).collect()}
    # header: 50 region, 30 name, 20 place, 15 shape; swept marks get 20 more
    assert got == {(1, 1): ("header", 135, 2), (1, 4): ("header", 155, 1), (1, 5): ("header", 125, 3), (1, 7): ("footer", 75, 4), (2, 1): ("header", 125, 1)}


def test_no_marks_no_logos(spark):
    assert logos.ranked(spark.createDataFrame([], MARK)).collect() == []
