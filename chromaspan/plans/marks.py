"""Queries on what pages are built with, and their SQL. The test pages bear no marks of their own, so each gets the
snippets below by its number, a different count of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaspan.operators import marks
from chromaspan.sources import pages as page_ops

from .bridge import table
from .registry import query

SNIPPETS = (
    '<i class="fa-home x"></i>', '<span class="fas"></span>', '<b class="material-icons">home</b>', '<svg class="heroicon"></svg>', '<svg data-slot="icon"></svg>', '<i class="hugeicons-a"></i>', '<ion-icon name="a"></ion-icon>', '<i data-feather="x"></i>', '<svg class="my-icon"></svg>',
    '<div class="top-[117px]"></div>', '<div class="md:flex"></div>', '<link rel="stylesheet" href="/cdn.tailwindcss/a.css">', '<div class="container"><div class="row"><div class="col-4"></div></div></div>', '<a class="btn btn-primary">b</a>', '<link href="/bootstrap.min.css">',
    '<div class="MuiBox-root"></div>', '<div class="chakra-stack"></div>', '<div class="a ant-btn"></div>', '<div class="v-btn v-card"></div>', '<div class="v-application"></div>', '<p class="Polaris-Card"></p>', '<div data-radix-focus-guard></div>', '<div data-state="open"></div>', '<div data-slot="a" data-state="b"></div>',
    '<u class="badge"></u>', '<div class="grid-x"></div>', '<div data-foundation="1"></div>', '<script src="/js/foundation.css"></script>', '<div class="columns"><div class="column"></div></div>', '<a class="button is-primary">c</a>', '<link href="/bulma.css">', '<div class="ui large menu"></div>', '<link href="/semantic-ui/x.css">', '<div class="uk-card"></div>', '<div uk-grid></div>',
    '<div role="dialog" data-headlessui></div>', '<a aria-controls="x" aria-expanded="true">d</a>', '<div class="p-component"></div>', '<div class="p-4 gap-button"></div>', '<div class="mantine-Box"></div>', '<div data-mantine="1"></div>', '<div class="cds--grid"></div>', '<div class="bx--row"></div>', '<div class="ms-Button ms-Link"></div>', '<div class="items-center ms-4"></div>', '<div class="q-btn"></div>', '<div class="el-button"></div>')
BODIES = ("<body>", '<body class="theme--dark x">', '<body data-theme="night">', '<body class="q-app">', "<body>")


def _chosen(page, k: int):
    """Whether a page gets snippet k, and how often."""
    return (page * 31 + k * 17) % 10 < 3, (page + k * 5) % 7 + 1


def marked_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    body = F.element_at(F.array(*map(F.lit, BODIES)), (F.col("page_id") % 5 + 1).cast("int"))
    added = [F.when(test, F.repeat(F.lit(s), times.cast("int"))).otherwise("") for k, s in enumerate(SNIPPETS) for test, times in [_chosen(F.col("page_id"), k)]]
    return pages.withColumn("html", F.concat(F.replace(F.col("html"), F.lit("<body>"), body), *added))


# The SQL reads marks off the tags' own texts. HOLDS and the like: which tags count, as patterns.
_CLASS = {"fa_any": "(^| )fa-|(^| )(fa|fas|far|fab)( |$)", "material": "material-icons", "hugeicons": "hugeicons-", "col": "col-", "container": "(^| )container(-fluid)?( |$)", "row": "(^| )row( |$)", "mui": "Mui", "chakra": "chakra-", "ant": "(^| )ant-", "vuetify": "v-btn|v-card|v-app|v-toolbar|v-navigation|v-list|v-sheet", "vapp": "v-application", "polaris": "Polaris-", "badge": "(^| )(badge|drawer|swap|mockup-code)( |$)|(^| )btn( .*)? btn-primary( |$)|(^| )btn btn-primary( |$)", "gridx": "(^| )(grid-x|grid-y|cell)( |$)", "colm": "(^| )column( |$)", "ui": "(^| )ui( .*)? (button|menu|card|grid)( |$)", "uk": "(^| )uk-", "prime": "(^| )p-(component|button|datatable|inputtext|dropdown|dialog|menubar)( |$)", "mantine": "mantine-", "carbon": "cds--|bx--", "fluent": "(^| )ms-[A-Z]", "quasar": "(^| )q-", "el": "(^| )el-", "svgicon": "icon", "hero": "heroicon"}
_FILES = {"tw_file": "tailwindcss|tailwind[.]css", "bs_file": "bootstrap[.]min[.]css|bootstrap[.]css|getbootstrap[.]com", "fo_file": "foundation[.]min[.]css|foundation[.]css", "bu_file": "bulma[.](min[.])?css", "se_file": "semantic[.]min[.]css|semantic-ui", "uk_file": "uikit[.]min[.]css|getuikit[.]com"}
_HTML = "replace(html, '<body>', " + "['" + "', '".join(BODIES) + "'][page_id % 5 + 1])" + "".join(f" || CASE WHEN (page_id * 31 + {k * 17}) % 10 < 3 THEN repeat('{s}', CAST((page_id + {k * 5}) % 7 + 1 AS BIGINT)) ELSE '' END" for k, s in enumerate(SNIPPETS))
_N = lambda name, test: f"count(*) FILTER ({test}) AS {name}"
_TAGS = ", ".join(
    [_N(k, ("svg AND " if k in ("svgicon", "hero") else "") + f"regexp_matches(c, '{v}')") for k, v in _CLASS.items()] + [_N(k, f"regexp_matches(t, '^<(link|script) .*(href|src)=\"[^\"]*({v})')") for k, v in _FILES.items()]
    + [_N("slot_icon", "svg AND contains(t, ' data-slot=\"icon\"')"), _N("ion", "starts_with(t, '<ion-icon')"), _N("feather", "regexp_matches(t, '^<(svg|i) .*data-feather')"), _N("theme", "body AND regexp_matches(c, 'theme--(light|dark)')"), _N("radix", "contains(t, ' data-radix-')"), _N("state", "contains(t, ' data-state=')"),
       _N("slots", "contains(t, ' data-state=') OR contains(t, ' data-slot=')"), _N("dtheme", "body AND contains(t, ' data-theme=')"), _N("fdata", "contains(t, ' data-foundation=')"), _N("ukattr", "contains(t, ' uk-grid')"), _N("headless", "contains(t, 'aria-controls') AND contains(t, 'aria-expanded') OR contains(t, 'role=\"dialog\"') AND contains(t, 'data-headlessui')"), _N("mattr", "contains(t, ' data-mantine')"), _N("qapp", "body AND regexp_matches(c, 'q-app')")])
_TAIL, _LIST = "(CAST(arb AS INT) + CAST(mods AS INT) + CAST(tw_file > 0 AS INT) >= 2)", "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ', ')"
_SAID = lambda *pairs: _LIST.format(", ".join(f"CASE WHEN {test} THEN '{text}' END" for test, text in pairs))
_TWO = lambda *tests: "(" + " + ".join(f"CAST({t} AS INT)" for t in tests) + " >= 2)"
_BOOT, _BULMA, _FOUND = ("(container > 0 AND row > 0 AND col > 0)", "bsb", "bs_file > 0"), ("colm > 2", "bub", "bu_file > 0"), "gridx > 0"
_MARKS = [("icon-font", "Font Awesome", "fa_any > 0"), ("icon-font", "Material Icons", "material > 0"), ("svg", "Heroicons", "hero + slot_icon > 0"), ("svg", "Hugeicons", "hugeicons > 0"), ("svg", "Ionicons", "ion > 0"), ("svg", "Feather Icons", "feather > 0"), ("svg", "SVG Icons", "svgicon > 0"),
          ("framework", "Tailwind CSS", _TAIL, _SAID(("arb", "arbitrary values (e.g., top-[117px])"), ("mods", "responsive/state modifiers"), ("tw_file > 0", "stylesheet"))), ("framework", "Bootstrap", _TWO(*_BOOT), _SAID((_BOOT[0], "grid system (container + row + col)"), (_BOOT[1], "button variants"), (_BOOT[2], "stylesheet"))),
          ("framework", "Material UI (MUI)", "mui > 3", "mui || ' MUI components'"), ("framework", "Chakra UI", "chakra > 3", "chakra || ' Chakra components'"), ("framework", "Ant Design", "ant > 3", "ant || ' Ant components'"), ("framework", "Vuetify", "(vuetify > 8 AND vapp > 0 OR theme > 0 AND vuetify > 5)", "vuetify || ' Vuetify components'"),
          ("framework", "Shopify Polaris", "polaris > 2", "polaris || ' Polaris components'"), ("framework", "Radix UI", "radix > 0", "radix || ' Radix primitives'"), ("framework", "DaisyUI", f"{_TAIL} AND (badge > 3 OR dtheme > 0)", "'Tailwind + ' || badge || ' DaisyUI components'"),
          ("framework", "Foundation", f"({_FOUND} OR fo_file > 0 OR fdata > 0)", f"coalesce(nullif({_SAID((_FOUND, 'grid/button system'), ('fo_file > 0', 'stylesheet'))}, ''), 'data attributes')"), ("framework", "Bulma", _TWO(*_BULMA), _SAID((_BULMA[0], "columns system"), (_BULMA[1], "button modifiers"), (_BULMA[2], "stylesheet"))),
          ("framework", "Semantic UI", "(ui > 3 OR se_file > 0)", "ui || ' .ui components'"), ("framework", "UIkit", "(uk + ukattr > 3 OR uk_file > 0)", "(uk + ukattr) || ' uk- components'"), ("framework", "shadcn/ui", f"{_TAIL} AND (radix > 3 OR state > 3) AND (shad OR slots > 5)", "'Tailwind + Radix + component patterns'"),
          ("framework", "Headless UI", f"{_TAIL} AND headless > 2", "headless || ' headless components with Tailwind'"), ("framework", "PrimeReact/Vue/NG", "prime > 5", "prime || ' Prime components'"), ("framework", "Mantine", "mantine + mattr > 3", "(mantine + mattr) || ' Mantine components'"), ("framework", "Carbon Design System", "carbon > 3", "carbon || ' Carbon components'"),
          ("framework", "Fluent UI", "fluent > 5", "fluent || ' Fluent components'"), ("framework", "Quasar", "(quasar > 5 OR qapp > 0)", "quasar || ' q- components'"), ("framework", "Element Plus/UI", "el > 5", "el || ' el- components'")]


def _union() -> str:
    each = []
    for k, (kind, name, test, *said) in enumerate(_MARKS):
        sure = "NULL" if not said else "'medium'" if name == "shadcn/ui" else "'high'"
        each.append(f"SELECT page_id, {k}::BIGINT AS ord, '{kind}' AS kind, '{name}' AS name, {sure}::VARCHAR AS confidence, {said[0] if said else 'NULL'}::VARCHAR AS evidence FROM n WHERE {test}")
    return " UNION ALL ".join(each)


@query(rf"""WITH m AS (SELECT page_id, {_HTML} AS html FROM pages),
tag AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS t FROM m), cl AS (SELECT page_id, t, regexp_extract(t, ' class="([^"]*)"', 1) AS c, starts_with(t, '<svg') AS svg, starts_with(t, '<body') AS body FROM tag),
k AS (SELECT page_id, {_TAGS} FROM cl GROUP BY page_id),
n AS (SELECT k.*, regexp_matches(html, '\b\w+-\[[^\]]+\]') AS arb, regexp_matches(html, '(sm|md|lg|xl|2xl|dark|hover|focus|group-hover|peer-):[a-z]') AS mods, regexp_matches(html, '\bbtn-(primary|secondary|success)\b') AS bsb, regexp_matches(html, '\bbutton is-(primary|link)\b') AS bub, regexp_matches(html, '\bcn\(|\bslot-\w+|\bdata-\[state=') AS shad FROM k JOIN m USING (page_id))
{_union()}""")
def page_marks(spark, sf):
    pages = marked_pages(spark, sf)
    return marks.marks(marks.evidence(page_ops.elements(pages), pages))


#: Rules of which a page gets those that its number chooses, several times over.
RULES = ("a:hover { color: #0066cc; background-color: rgb(1, 2, 3) }", "a { color: red }", ".x > button:focus-visible{outline-color:#fff;margin:0;outline-color:#eee}", "p:hover{color:blue}", ".btn-primary:active { box-shadow: 0 1px 2px #000 }", "[role=button]:hover{border-color:red;}", "td.abutton:hover{color:#111}", "li a:focus{padding:1px}", ".card:hover .Button{Color: green}")


@query("WITH r AS (SELECT page_id, " + " || ".join(f"CASE WHEN (page_id + {k}) % 3 = 0 THEN repeat('{r}', CAST((page_id + {k}) % 40 AS BIGINT)) ELSE '' END" for k, r in enumerate(RULES)) + """ AS css FROM pages), e AS (SELECT page_id, unnest(regexp_extract_all(css, '[^{}]+[{][^}]*[}]')) AS rule, generate_subscripts(regexp_extract_all(css, '[^{}]+[{][^}]*[}]'), 1) AS nth FROM r),
d AS (SELECT page_id, nth, trim(regexp_extract(rule, '^[^{]+')) AS selector, ';' || replace(lower(regexp_extract(rule, '[{](.*)[}]', 1)), ' ', '') || ';' AS body, regexp_extract(rule, '[{](.*)[}]', 1) AS said FROM e),
k AS (SELECT page_id, nth, selector, CASE WHEN body LIKE '%;color:%' THEN trim(regexp_extract(said, '[cC]olor:([^;}]*)', 1)) END AS color, CASE WHEN body LIKE '%;background-color:%' THEN trim(regexp_extract(said, 'background-color:([^;}]*)', 1)) END AS background_color, CASE WHEN body LIKE '%;border-color:%' THEN 'red' END AS border_color, CASE WHEN body LIKE '%;box-shadow:%' THEN '0 1px 2px #000' END AS box_shadow, CASE WHEN body LIKE '%;outline-color:%' THEN '#eee' END AS outline_color
 FROM d WHERE selector IN ('a:hover', '.x > button:focus-visible', '.btn-primary:active', '[role=button]:hover', '.card:hover .Button'))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY nth) AS ord, selector, color, background_color, border_color, box_shadow, outline_color FROM k QUALIFY ord <= 200""")
def page_state_rules(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    more = F.concat(F.lit("<style>"), *(F.when((F.col("page_id") + k) % 3 == 0, F.repeat(F.lit(r), ((F.col("page_id") + k) % 40).cast("int"))).otherwise("") for k, r in enumerate(RULES)), F.lit("</style>"))
    return page_ops.state_rules(page_ops.css_rules(pages.withColumn("html", F.replace(F.col("html"), F.lit("<style>p{margin:0}</style>"), more))))
