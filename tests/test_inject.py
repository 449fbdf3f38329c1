"""Colours put into a palette by other sources, against one upsert after the other."""

from chromaspan.operators import inject


def test_sources_make_lift_and_leave_rows(spark):
    scan = [(1, 0, "#111111", 9, "low", ["body"]), (1, 1, "#0066cc", 5, "medium", ["a", "logo"]), (1, 2, "#00ff00", 4, "low", ["b"])]
    dark = [(1, 0, "#00ff00", 7, "high", ["dark"]), (1, 1, "#222222", 7, "high", ["dark"])]
    menu = [(1, 0, "#222222", 3, "high", ["menu"]), (1, 1, "#333333", 3, "high", ["menu"])]
    palette = "site long, ord long, hex string, n long, confidence string, sources array<string>"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = inject.injected(
        inject.from_scan(frame(scan, palette)),
        inject.from_manifest(frame([(1, 0, "theme_color", "RGB(17, 17, 17)"), (1, 1, "background_color", "#111111"), (1, 2, "background_color", "Odd")], "site long, ord long, label string, value string")),
        inject.from_logos(frame([(1, 0, "#0066cc"), (1, 1, "#00ff00"), (1, 2, "#abcdef")], "site long, ord long, value string")),
        inject.from_gradients(frame([(1, 0, "hsl(0 100% 50%)", 2), (1, 1, "#ff00ff", 1), (1, 2, "#808080", 9), (1, 3, "rgb(0 0 255 / 0.2)", 9), (1, 4, "#abcdef", 5)], "site long, ord long, value string, n long")),
        inject.from_states(frame([(1, 0, "#ff8800", "color"), (1, 1, "#ff8800", "background-color"), (1, 2, "#777777", "color"), (1, 3, "rgba(9,9,9,0.01)", "color")], "site long, ord long, value string, property string")),
        inject.from_scan(frame(dark, palette), inject.DARK), inject.from_scan(frame(menu, palette), inject.MENU))
    got = [tuple(r)[1:] for r in out.orderBy("ord").collect()]
    assert got == [
        (1, "#111111", "#111111", 9, "high", ["body", "manifest:theme_color", "manifest:background_color"], None),
        (2, "#0066cc", "#0066cc", 5, "high", ["a", "logo"], None), (3, "#00ff00", "#00ff00", 4, "high", ["logo", "b"], None), (4, "Odd", "odd", 10, "high", ["manifest:background_color"], None),
        (5, "#abcdef", "#abcdef", 10, "high", ["logo"], None), (6, "rgb(255, 0, 0)", "#ff0000", 2, "low", ["gradient"], None), (7, "#ff8800", "#ff8800", 1, "medium", ["hover/focus"], None),
        (8, "#777777", "#777777", 1, "medium", ["hover/focus"], None), (9, "#222222", "#222222", 7, "high", ["dark"], "dark-mode"), (10, "#333333", "#333333", 3, "medium", ["menu"], "menu")]
