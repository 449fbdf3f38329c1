"""Documents, snapshots, merges and summaries on small tables."""

from pyspark.sql import functions as F

from chromaspan.functions import text
from chromaspan.operators import documents, elements, merge, summary
from chromaspan.sources import pages, snapshots


def test_flatten_inherits_types_and_tells_broken_documents(spark):
    rows = [(1, '{"g":{"$type":"color","a":{"$value":"#fff"},"h":{"b":{"$type":"number","$value":3},"c":{"$ref":"#/g/a"}}},"n":5}'), (2, "{oops"), (3, "{}"), (4, None)]
    got = {(r["doc_id"], r["path"]): (r["type"], r["value"]) for r in documents.flatten(spark.createDataFrame(rows, "doc_id long, json string")).collect()}
    assert got == {(1, "g.a"): ("color", "#fff"), (1, "g.h.b"): ("number", "3"), (1, "g.h.c"): ("color", "#/g/a"), (2, ""): ("invalid JSON", "{oops"), (4, ""): ("invalid JSON", None)}
    assert documents.flatten(spark.createDataFrame([], "doc_id long, json string")).count() == 0


def test_snapshots_of_several_shapes(spark):
    json = '{"url":"u","meta":{"snapshotId":"s"},"colors":{"semantic":{"primary":{"color":"#010203"},"accent":"#fff"},"palette":[{"color":"rgb(1,2,3)","normalized":"#010203","count":4}]},"typography":{"styles":[{"context":"body","fontFamily":"F","fontSize":"16px (1.00rem)","weight":"700"}],"sources":{"adobeFonts":true}},"spacing":{"commonValues":[{"px":8},{"px":"12px"}]},"shadows":[{"shadow":"0 1px #000","confidence":"low"}],"_links":[1]}'
    out = snapshots.normalized(spark.createDataFrame([(1, json), (2, "no")], "doc_id long, json string"))
    one = out.where("doc_id = 1").first()
    assert one["semantic"] == {"primary": "#010203", "accent": "#fff"} and one["adobe_fonts"] == "[]"
    assert one["styles"][0]["weight"] == 700 and [s["display"] for s in one["spacing"]] == ["8px", "12px"]
    told = [(r["category"], r["value"], r["count"]) for r in snapshots.tokens(out).where("snapshot_id = 's'").collect()]
    assert ("color", "#010203", 4) in told and ("shadow", "0 1px #000", 1) in told and ("typography", "F/700/16px (1.00rem)", 1) in told
    assert snapshots.tokens(out).where("snapshot_id = '2'").count() == 0


def test_transparent_values(spark):
    said = {None: True, "": True, "transparent": True, "#0000": True, "#abcd": False, "#11223300": True, "#112233": False, "rgba(1, 2, 3, 0)": True, "rgb(1 2 3 / 0.0)": True, "rgb(1 2 3 / 50%)": False, "red": False, "rgb(0, 0, 0)": False}
    rows = spark.createDataFrame([(v,) for v in said], "v string").select("v", elements.transparent(F.col("v")).alias("t")).collect()
    assert {r["v"]: r["t"] for r in rows} == said


def test_merged_palettes_keep_the_first_leader_and_lift_confidence(spark):
    rows = [(1, 1, 1, "#102030", 5, "low"), (1, 2, 1, "#112131", 9, "low"), (1, 3, 1, "#102030", 1, "low"), (1, 2, 2, "#ff0000", 2, "medium")]
    got = {r["hex"]: (r["n"], r["pages"], r["confidence"]) for r in merge.palettes(spark.createDataFrame(rows, "site long, page_id long, ord long, hex string, n long, confidence string")).collect()}
    assert got == {"#112131": (15, 3, "high"), "#ff0000": (2, 1, "medium")}


def test_robots_groups_fall_back_to_all_agents(spark):
    body = "User-agent: *\nDisallow: /a\n\nUser-agent: bot\nDisallow: /b\n"
    files = spark.createDataFrame([("h", body), ("g", "User-agent: *\nDisallow: /a\n")], "host string, body string")
    urls = spark.createDataFrame([(1, "h", "/a"), (2, "h", "/b"), (3, "g", "/a"), (4, "g", "/b")], "page_id long, host string, path string")
    got = {r["page_id"]: r["allowed"] for r in pages.robots_allowed(urls, pages.robots_rules(files), "Bot").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_crawl_errors_and_hues(spark):
    said = {"net::ERR_FAILED": "retryable", "Timeout 30000ms": "retryable", "econnreset": "failure", "dns": "failure", "ETIMEDOUT": "retryable", None: "failure"}
    rows = spark.createDataFrame([(v,) for v in said], "v string").select("v", text.crawl_error(F.col("v")).alias("c")).collect()
    assert {r["v"]: r["c"] for r in rows} == said
    hues = {"#ff0000": "Red", "#00ff00": "Green", "#0000ff": "Blue", "#ffffff": "White", "#000000": "Black", "#808080": "Gray", "zzz": "Color"}
    rows = spark.createDataFrame([(v,) for v in hues], "v string").select("v", summary.hue_name(F.col("v")).alias("n")).collect()
    assert {r["v"]: r["n"] for r in rows} == hues
