"""Marks of frameworks and icon sets: a page for each, just at its threshold, and one just below."""

from chromaspan.operators import marks
from chromaspan.sources import pages as page_ops

TAILWIND = '<div class="top-[117px]"></div><div class="md:flex"></div>'
#: name, what proves it, what falls just short of it
CASES = [
    ("Font Awesome", '<i class="x fa-home"></i>', '<i class="sofa-bed"></i>'), ("Font Awesome", '<i class="far"></i>', '<i class="farm"></i>'), ("Material Icons", '<i class="material-icons-round"></i>', '<i class="material"></i>'),
    ("Heroicons", '<svg data-slot="icon"></svg>', '<b data-slot="icon"></b>'), ("Hugeicons", '<svg class="hugeicons"></svg>', '<b class="hugeicons"></b>'), ("Ionicons", "<ion-icon></ion-icon>", "<icon-ion></icon-ion>"),
    ("Feather Icons", "<i data-feather></i>", "<b data-feather></b>"), ("SVG Icons", '<svg class="an-icon"></svg>', '<b class="an-icon"></b>'),
    ("Tailwind CSS", TAILWIND, '<div class="md:flex"></div>'), ("Tailwind CSS", '<p class="md:flex"><link href="/tailwind.css">', '<p class="md:flex"><a href="/tailwind.css">x</a>'),
    ("Bootstrap", '<div class="container-fluid"><p class="row"><p class="col-2"><a class="btn-primary">x</a></div>', '<div class="container"><p class="row"><a class="btn-primary">x</a></div>'),
    ("Material UI (MUI)", '<b class="MuiBox-x"></b>' * 4, '<b class="MuiBox-x"></b>' * 3), ("Chakra UI", '<b class="chakra-x"></b>' * 4, '<b class="chakra-x"></b>' * 3), ("Ant Design", '<b class="a ant-x"></b>' * 4, '<b class="elegant-x"></b>' * 9),
    ("Vuetify", '<b class="v-btn"></b>' * 8 + '<b class="v-application"></b>', '<b class="v-btn"></b>' * 9), ("Vuetify", '<body class="theme--light">' + '<b class="v-card"></b>' * 6, '<body class="theme--light">' + '<b class="v-card"></b>' * 5),
    ("Shopify Polaris", '<b class="Polaris-x"></b>' * 3, '<b class="Polaris-x"></b>' * 2), ("Radix UI", "<b data-radix-focus-guard></b>", '<b data-state="open"></b>' * 9),
    ("DaisyUI", TAILWIND + '<b class="badge"></b>' * 4, '<b class="badge"></b>' * 4), ("DaisyUI", '<body data-theme="x">' + TAILWIND, '<div data-theme="x">' + TAILWIND),
    ("Foundation", '<b class="grid-x"></b>', '<b class="grid-xy"></b>'), ("Foundation", "<b data-foundation></b>", "<b data-found></b>"), ("Bulma", '<b class="column"></b>' * 3 + '<a class="button is-link"></a>', '<b class="column"></b>' * 2 + '<a class="button is-link"></a>'),
    ("Semantic UI", '<b class="ui large menu"></b>' * 4, '<b class="ui large"></b>' * 9), ("UIkit", '<b class="uk-card"></b><b uk-grid></b>' * 2, '<b class="uk-card"></b><b class="duk-x"></b>' * 3),
    ("shadcn/ui", TAILWIND + '<b data-slot="x" data-state="y"></b>' * 6, TAILWIND + '<b data-slot="x"></b>' * 6), ("Headless UI", TAILWIND + '<b aria-controls="a" aria-expanded="b"></b>' * 3, TAILWIND + '<b aria-controls="a"></b>' * 9),
    ("PrimeReact/Vue/NG", '<b class="p-button"></b>' * 6, '<b class="p-4 top-button"></b>' * 9), ("Mantine", '<b class="mantine-x"></b><b data-mantine></b>' * 2, '<b class="mantine-x"></b>' * 3), ("Carbon Design System", '<b class="cds--x"></b><b class="bx--x"></b>' * 2, '<b class="cds--x"></b>' * 3),
    ("Fluent UI", '<b class="ms-Button"></b>' * 6, '<b class="ms-4 items-center"></b>' * 9), ("Quasar", '<body class="q-app">', '<div class="faq-app">' * 9), ("Element Plus/UI", '<b class="el-x"></b>' * 6, '<b class="model-x"></b>' * 9)]


def test_each_mark_at_its_threshold(spark):
    pages = spark.createDataFrame([(2 * k + low, html) for k, case in enumerate(CASES) for low, html in enumerate(case[1:])] + [(-1, None), (-2, "")], "page_id long, html string")
    rows = marks.marks(marks.evidence(page_ops.elements(pages), pages)).collect()
    got = {(r["page_id"], r["name"]): r for r in rows}
    for k, (name, _, _) in enumerate(CASES):
        assert (2 * k, name) in got, name
        assert (2 * k + 1, name) not in got, name
    assert {n for n, _, _ in CASES} == {r["name"] for r in rows} and len({n for n, _, _ in CASES}) == 28
    assert not any(r["page_id"] < 0 for r in rows)
    said = {name: got[2 * k, name]["evidence"] for k, (name, _, _) in enumerate(CASES)}
    assert said["Bootstrap"] == "grid system (container + row + col), button variants" and said["Foundation"] == "data attributes" and said["UIkit"] == "4 uk- components"


def test_elements_keep_their_attributes(spark):
    pages = spark.createDataFrame([(1, '<a HREF="/x" data-a hidden="y" href="/z">t</a><br>')], "page_id long, html string")
    first, last = page_ops.elements(pages).orderBy("el_id").collect()
    assert first["attrs"] == {"href": "/x", "data-a": "", "hidden": "y"} and last["attrs"] == {}


def test_state_rules(spark):
    css = "a:hover{color:red;color:blue} main:hover{color:red} .a,BUTTON:focus{background-color:#fff} a:visited{color:red} .btn:active{margin:0} a:active{box-shadow:} [role='button']:hover{border-color:#000}"
    pages = spark.createDataFrame([(1, f"<style>{css}</style>"), (2, None), (3, "<style>" + "a:hover{color:red}" * 201 + "</style>")], "page_id long, html string")
    rows = page_ops.state_rules(page_ops.css_rules(pages)).orderBy("page_id", "ord").collect()
    got = [(r["ord"], r["selector"], r["color"], r["background_color"], r["border_color"]) for r in rows if r["page_id"] == 1]
    assert got == [(1, "a:hover", "blue", None, None), (2, ".a,BUTTON:focus", None, "#fff", None), (3, "[role='button']:hover", None, None, "#000")]
    assert sum(r["page_id"] == 3 for r in rows) == 200 and not any(r["page_id"] == 2 for r in rows)
