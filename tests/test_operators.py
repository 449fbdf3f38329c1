"""Operators on small tables with worked values."""

import math

import pytest
from pyspark.sql import functions as F

from chromaspan.functions import color, text
from chromaspan.operators import audit, drift, merge
from chromaspan.sources import pages
from chromaspan.streaming import captures


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("said", "want"), [("#FfF", (255, 255, 255, 1.0)), ("#01020380", (1, 2, 3, 0.502)), ("rgb(1, 2, 3)", (1, 2, 3, 1.0)), ("rgba(300 0 50% / 50%)", (255, 0, 128, 0.5)), ("transparent", (0, 0, 0, 0.0)), ("#12345", None), ("var(--x)", None)])
def test_css_colors(spark, said, want):
    got = one(spark, color.parse_css(F.lit(said)))
    assert (tuple(got) if got else None) == want


def test_color_distances(spark):
    lab = lambda h: color.lab(F.lit(h))
    assert abs(one(spark, lab("#ffffff"))["l"] - 100) < 0.01
    assert abs(one(spark, color.contrast(color.luminance(F.lit("#000000")), color.luminance(F.lit("#ffffff")))) - 21) < 1e-9
    assert one(spark, color.ciede2000(lab("#133174"), lab("#133174"))) == 0
    assert one(spark, color.ciede2000(lab("#133174"), lab("#133074"))) < 1 < one(spark, color.ciede2000(lab("#133174"), lab("#d03174")))
    assert one(spark, color.capped(F.lit("high"), F.lit(2))) == "medium" and one(spark, color.capped(F.lit("medium"), F.lit(1))) == "low"


def test_strings(spark):
    assert one(spark, text.leading_number(F.lit(" 12.5px"))) == 12.5 and one(spark, text.leading_number(F.lit("auto"))) is None
    assert one(spark, text.path_score(F.lit("/pricing"))) == 120 and one(spark, text.path_score(F.lit("/login"))) == -1
    assert one(spark, text.page_identity(F.lit("https://www.a.com/x/"))) == "a.com/x"
    assert one(spark, text.rounded(F.lit(-2.5))) == -2
    assert one(spark, text.milliseconds(F.lit("0.2s"))) == 200


def tokens(spark, rows):
    return spark.createDataFrame(rows, "snapshot_id string, category string, ord int, key string, value string, num double, confidence string")


def drifted(spark, base, cand, degraded=None):
    rows = [("b", *r, "high") for r in base] + [("c", *r, "high") for r in cand]
    pairs = spark.createDataFrame([("p", "b", "c")], "pair_id string, base_id string, cand_id string")
    found = drift.compared(pairs, tokens(spark, rows))
    if degraded:
        meta = spark.createDataFrame(degraded, "snapshot_id string, degraded array<string>, errors array<string>")
        found = drift.without(found, pairs, drift.degraded_categories(meta))
    return drift.reports(drift.categories(found)).first(), drift.changes(found).collect()


COLOR = ("color", 1, None, "#133174", None)
SPACE = [("spacing", k, None, f"{v}px", float(v)) for k, v in enumerate((8, 16, 24))]
RADIUS = ("radius", 1, None, "4px", 4.0)


def styles(n, family="Inter"):
    return [("typography", k, f"role{k}", f"{family}/400/16px", 16.0) for k in range(n)]


@pytest.mark.parametrize(("cand", "score", "status"), [(styles(9), 9, "stable"), ([*styles(9), ("typography", 9, "role9", "Other/400/16px", 16.0)], 15, "drift"), (styles(4), 18, "drift"), (styles(10, "Other"), 29, "drift"), (styles(10), 0, "stable")])
def test_drift_worked_values(spark, cand, score, status):
    rest = [COLOR, *SPACE, RADIUS]
    got, _ = drifted(spark, [*rest, *styles(10)], [*rest, *cand])
    assert (got["score"], got["status"], got["inconclusive"]) == (score, status, False)


def test_drift_matches_nearest_first(spark):
    got, changed = drifted(spark, [COLOR, ("color", 2, None, "#ff0000", None), RADIUS], [("color", 1, None, "#133175", None), ("color", 2, None, "#f01010", None), ("radius", 1, None, "5px", 5.0)])
    kinds = sorted((c["category"], c["kind"]) for c in changed)
    assert kinds == [("color", "changed"), ("radius", "changed")]
    assert got["score"] > 0


def test_degraded_categories_never_score(spark):
    got, changed = drifted(spark, [COLOR], [("color", 1, None, "#ff0000", None)], [("c", ["dark-mode"], None)])
    assert got["inconclusive"] and got["status"] == "stable" and not changed
    got, changed = drifted(spark, [COLOR, RADIUS], [("color", 1, None, "#ff0000", None), RADIUS], [("b", [], ["manifest"])])
    assert not got["inconclusive"] and got["score"] == 0 and not changed


def test_semantic_roles_move_but_do_not_score_by_coming_or_going(spark):
    role = lambda name, value: ("semantic", 1, name, value, None)
    got, changed = drifted(spark, [COLOR, role("primary", "#133174")], [COLOR, role("primary", "rgb(19, 49, 116)"), role("accent", "#ff0000")])
    assert got["score"] == 0 and [(c["label"], c["kind"], c["penalty"]) for c in changed] == [("semantic.accent", "added", 0.0)]
    # the role's weight 3 joins the palette's 3 (its one colour has the role): 3 of 6
    got, changed = drifted(spark, [COLOR, role("primary", "#133174")], [COLOR, role("primary", "#ffd000")])
    assert got["score"] == 50 and changed[0]["label"] == "semantic.primary" and changed[0]["penalty"] == 3.0
    got, changed = drifted(spark, [COLOR, role("primary", "var(--a)")], [COLOR, role("primary", "var(--b)")])
    assert changed[0]["delta"] is None and changed[0]["penalty"] == 3.0
    got, changed = drifted(spark, [role("primary", "#133174")], [role("primary", "rgba(0,0,0,0)")])
    assert [c["kind"] for c in changed] == ["removed"] and got["score"] == 0


def greedy(base, cand, limit, far):
    """A plain model of the matching: (base or None, candidate or None, distance)."""
    free, out = list(cand), []
    for b in base:
        best = min(((far(b, c), k) for k, c in enumerate(free)), default=(math.inf, -1))
        out.append((b, free.pop(best[1]) if best[0] <= limit else None, best[0]))
    return out + [(None, c, None) for c in free]


def test_matching_equals_the_plain_model(spark):
    import random

    rng = random.Random(3)
    for _ in range(4):
        base, cand = ([rng.choice([0, 4, 8, 9, 12, 13, 16, 24, 25, 40]) for _ in range(8)] for _ in range(2))
        far = lambda x, y: (0 if y == 0 else 100) if x == 0 else abs(x - y) / abs(x) * 100
        want = sorted((str(b), str(c)) for b, c, d in greedy(base, cand, 25, far) if b is None or c is None or d > 4)
        rows = lambda vs: [("spacing", k, None, str(v), float(v)) for k, v in enumerate(vs)]
        _, changed = drifted(spark, rows(base), rows(cand))
        assert sorted((str(c["before"]), str(c["after"])) for c in changed) == want


def leaders(rows):
    """A plain model of leader clustering."""
    def lab(h):
        lin = [(c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4) for c in (int(h[k : k + 2], 16) / 255 for k in (1, 3, 5))]
        m = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))
        x, y, z = (f ** (1 / 3) if f > 0.008856 else (903.3 * f + 16) / 116 for f in (sum(a * b for a, b in zip(r, lin)) / r[3] for r in m))
        return 116 * y - 16, 500 * (x - y), 200 * (y - z)

    found, out = [], {}
    for h, _, _ in sorted(rows, key=lambda r: (-r[1], r[2], r[0])):
        near = next((f for f in found if math.dist(lab(f), lab(h)) < 15), None)
        if near is None:
            found.append(h)
        out[h] = near or h
    return out


def test_leader_clusters_equal_the_plain_model(spark):
    rows = [(f"#{k * 9 % 256:02x}{k * 7 % 256:02x}{k * 3 % 256:02x}", k % 5 + 1, k) for k in range(80)]
    table = spark.createDataFrame([(1, *r) for r in rows], "site long, hex string, n long, ord long")
    got = {r["hex"]: r["leader"] for r in merge.leader_clusters(table).collect()}
    assert got == leaders(rows)


def test_aliases(spark):
    rows = [(1, "a", "1px"), (1, "b", "{a}"), (1, "c", "{b}"), (1, "d", "{e}"), (1, "e", "{d}"), (1, "f", "{none}")]
    got = {r["path"]: (r["value"], r["state"]) for r in audit.resolve_aliases(spark.createDataFrame(rows, "doc_id long, path string, value string")).collect()}
    assert got["c"] == ("1px", "ok") and got["f"][1] == "missing" and got["d"][1] == got["e"][1] == "cycle"


def test_aliases_of_long_chains(spark):
    rows = [(1, "t0", "1px"), *((1, f"t{k}", f"{{t{k - 1}}}") for k in range(1, 40)), (1, "x", "{y}"), (1, "y", "{z}"), (1, "z", "{x}"), (1, "in", "{x}"), (1, "lost", "{gone}"), (1, "far", "{lost}")]
    got = {r["path"]: (r["value"], r["state"]) for r in audit.resolve_aliases(spark.createDataFrame(rows, "doc_id long, path string, value string")).collect()}
    assert len(got) == len(rows) and all(got[f"t{k}"] == ("1px", "ok") for k in range(40))
    assert {got[k][1] for k in ("x", "y", "z", "in")} == {"cycle"} and got["lost"][1] == got["far"][1] == "missing"


def test_pages(spark):
    html = '<html><head><style>:root{--brand: #123456; --brand:#000}</style></head><body><nav><a href="/pricing">x</a></nav><div><p>t<br></p><a href="/login">l</a></div></body></html>'
    table = spark.createDataFrame([(1, "http://a.com", html)], "page_id long, url string, html string")
    assert [(r["path"], r["score"]) for r in pages.links(table).collect()] == [("/pricing", 130)]
    got = {r["el_id"]: r for r in pages.elements(table).collect()}
    assert [got[k]["tag"] for k in sorted(got)] == ["html", "head", "style", "body", "nav", "a", "div", "p", "br", "a"]
    assert got[5]["ancestors"] == [0, 3, 4] and got[8]["parent_id"] == 7
    assert pages.custom_properties(pages.css_rules(table)).first()["value"] == "#000"
    site = spark.createDataFrame([("a.com", "<loc>http://www.a.com/docs/</loc><loc>http://b.com/x</loc><loc>http://a.com/</loc>")], "host string, xml string")
    assert [r["url"] for r in pages.sitemap_urls(site).collect()] == ["http://www.a.com/docs"]


def test_stream_alerts_and_timeline(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "stable"), (1, "2024-01-01 01:00:00", "drift"), (1, "2024-01-01 02:00:00", "drift"), (2, "2024-01-01 00:00:00", "stable")]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "site long, ts string, status string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("site long, ts timestamp, status string").parquet(path)
    q = captures.status_alerts(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["site"], r["status"], r["before"]) for r in spark.table("alerts").collect()] == [(1, "drift", "stable")]
