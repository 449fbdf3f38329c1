"""Declared colours and icons of small pages."""

from chromaspan.sources import hints

HEAD = """<head><meta name="theme-color" content="#111" media="(prefers-color-scheme: dark)"><META content=' #eee ' name='Theme-Color'>
<link rel="mask-icon" href="/m.svg" color="#0af"><meta name="msapplication-TileColor" content="#2b5797">
<meta name="apple-mobile-web-app-status-bar-style" content="black"><meta property="og:image" content="/o.png">
<link rel="apple-touch-icon" sizes="180x180" href="/a.png"></head>"""


def frame(spark):
    return spark.createDataFrame([(1, HEAD), (2, "<p>none</p>"), (3, None), (4, '<meta name="theme-color" content="">')], "page_id long, html string")


def test_declared_colors(spark):
    found = hints.platform_colors(hints.head_tags(frame(spark)))
    assert sorted(tuple(r) for r in found.select("rank", "page_id", "source", "value", "scheme").collect()) == [
        (1, 1, "theme-color", "#111", "dark"),
        (2, 1, "theme-color", "#eee", None),
        (3, 1, "mask-icon", "#0af", None),
        (4, 1, "msapplication-tilecolor", "#2b5797", None),
    ]
    assert [tuple(r) for r in hints.theme(found).collect()] == [(1, "#eee", "#111", "#2b5797")]


def test_icons_and_their_default(spark):
    got = sorted((r["page_id"], r["rank"], r["kind"], r["href"], r["sizes"]) for r in hints.icons(frame(spark)).collect())
    assert got[:3] == [(1, 1, "mask-icon", "/m.svg", None), (1, 2, "apple-touch-icon", "/a.png", "180x180"), (1, 3, "og:image", "/o.png", None)]
    assert got[3:] == [(k, 1, "favicon.ico", "/favicon.ico", None) for k in (2, 3, 4)]
