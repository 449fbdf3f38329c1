"""Frameworks and icon sets of pages: evidence counted over elements and sources, then rules over the evidence.

The rules come in two strata: DaisyUI, shadcn/ui and Headless UI count only on pages whose evidence makes them Tailwind
pages. A page is one row of counters, so only counters are shuffled, never texts or elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an element's class holds (a text anywhere, a text at the start of a class, whole classes).
CLASS_HOLDS = {"material_icons": "material-icons", "hugeicons_part": "hugeicons-", "ionicons": "ionicons", "feather_part": "feather-", "col": "col-", "mui": "Mui", "chakra": "chakra-", "vuetify_app": "v-application", "polaris": "Polaris-", "mantine_part": "mantine-", "cds": "cds--", "bx": "bx--"}
CLASS_STARTS = {"fa_part": "fa-", "ant": "ant-", "uk_part": "uk-", "quasar": "q-", "element_plus": "el-"}
CLASS_WORDS = {"fa": "fa|fas|far|fab", "container": "container|container-fluid", "row": "row", "foundation_grid": "grid-x|grid-y|cell", "column": "column", "prime": "p-component|p-button|p-datatable|p-inputtext|p-dropdown|p-dialog|p-menubar"}
#: Addresses of linked style sheets and scripts.
RESOURCES = {"tailwind_file": r"tailwindcss|tailwind\.css|cdn\.tailwindcss", "bootstrap_file": r"bootstrap\.min\.css|bootstrap\.css|getbootstrap\.com", "foundation_file": r"foundation\.min\.css|foundation\.css|zurb\.com/foundation", "bulma_file": r"bulma\.min\.css|bulma\.css", "semantic_file": r"semantic\.min\.css|semantic-ui", "uikit_file": r"uikit\.min\.css|getuikit\.com"}
#: Patterns in a page's source.
SOURCE = {"arbitrary": r"\b\w+-\[[^\]]+\]", "modifiers": r"(sm|md|lg|xl|2xl|dark|hover|focus|group-hover|peer-):[a-z]", "bootstrap_buttons": r"\bbtn-primary\b|\bbtn-secondary\b|\bbtn-success\b", "bulma_buttons": r"\bbutton is-primary\b|\bbutton is-link\b", "shadcn_source": r"\bcn\(|\bslot-\w+|\bdata-\[state="}
#: Attributes of Radix primitives, classes of Vuetify components.
RADIX = ("data-radix-collection-item", "data-radix-popper-content-wrapper", "data-radix-scroll-area-viewport", "data-radix-focus-guard", "data-radix-aspect-ratio-wrapper")
VUETIFY = ("v-btn", "v-card", "v-app", "v-toolbar", "v-navigation", "v-list", "v-sheet")


def _words(classes: Column, words: str) -> Column:
    return classes.rlike(rf"(^|\s)({words})(\s|$)")


def evidence(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a page: how many elements (page_id, tag, class, attrs) bear each mark, and what the source (page_id, html) holds."""
    c, tag = F.coalesce("class", F.lit("")), F.lower("tag")
    has = lambda *names: F.coalesce(F.exists(F.array(*map(F.lit, names)), lambda n: F.map_contains_key("attrs", n)), F.lit(False))
    attr = lambda name: F.coalesce(F.get(F.filter(F.map_entries("attrs"), lambda e: e["key"] == name), 0)["value"], F.lit(""))
    words = lambda w: _words(c, w)
    seen = {**{k: c.contains(v) for k, v in CLASS_HOLDS.items()}, **{k: c.rlike(f"(^| ){v}") for k, v in CLASS_STARTS.items()}, **{k: words(v) for k, v in CLASS_WORDS.items()}}
    seen |= {
        "fa_any": seen["fa"] | seen["fa_part"], "heroicons": (tag == "svg") & (c.contains("heroicon") | (attr("data-slot") == "icon")), "hugeicons": seen["hugeicons_part"] | ((tag == "svg") & c.contains("hugeicons")),
        "ion": (tag == "ion-icon") | seen["ionicons"], "feather": seen["feather_part"] | (tag.isin("svg", "i") & has("data-feather")), "svg_icons": (tag == "svg") & c.contains("icon"),
        "vuetify": c.rlike("|".join(VUETIFY)), "vuetify_theme": (tag == "body") & words("theme--light|theme--dark"), "radix": has(*RADIX), "data_state": has("data-state"), "slots": has("data-slot", "data-state"),
        "daisy": (words("btn-primary") & words("btn")) | words("badge|drawer|swap|mockup-code"), "daisy_theme": (tag == "body") & has("data-theme"), "foundation_buttons": words("button") & words("primary|secondary"), "foundation_data": has("data-foundation"),
        "semantic": words("ui") & words("button|menu|card|grid"), "uikit": seen["uk_part"] | has("uk-grid", "uk-navbar"), "headless": (has("aria-controls") & has("aria-expanded")) | ((attr("role") == "dialog") & has("data-headlessui")),
        "mantine": seen["mantine_part"] | has("data-mantine"), "carbon": seen["cds"] | seen["bx"], "fluent": c.rlike(r"(^|\s)ms-[A-Z]"), "quasar_app": (tag == "body") & words("q-app")}
    linked = F.when((tag == "link") & (attr("href") != ""), attr("href")).when((tag == "script") & (attr("src") != ""), attr("src"))
    seen |= {k: F.coalesce(linked.rlike(v), F.lit(False)) for k, v in RESOURCES.items()}
    counted = elements.groupBy("page_id").agg(*(F.count_if(v).alias(k) for k, v in seen.items()))
    source = pages.groupBy("page_id").agg(*(F.coalesce(F.bool_or(F.col("html").rlike(v)), F.lit(False)).alias(k) for k, v in SOURCE.items()))
    return source.join(counted, "page_id", "left").fillna(0, list(seen))


def _rules() -> list[tuple[str, str, str, Column, Column]]:
    """kind, name, confidence, whether it holds, what is said for it."""
    n = F.col
    said = lambda *pairs: F.concat_ws(", ", *(F.when(test, text) for test, text in pairs))
    least = lambda k, *tests: sum((t.cast("int") for t in tests[1:]), tests[0].cast("int")) >= k
    many = lambda k, text: F.concat(n(k).cast("string"), F.lit(f" {text}"))
    grid = (n("container") > 0) & (n("row") > 0) & (n("col") > 0)
    foundation = (n("foundation_grid") > 0) | (n("foundation_buttons") > 0)
    cols = n("column") > 2
    tail = (n("arbitrary"), n("modifiers"), n("tailwind_file") > 0)
    boot = (grid, n("bootstrap_buttons"), n("bootstrap_file") > 0)
    bulma = (cols, n("bulma_buttons"), n("bulma_file") > 0)
    icon = [("icon-font", "Font Awesome", "fa_any"), ("icon-font", "Material Icons", "material_icons"), ("svg", "Heroicons", "heroicons"), ("svg", "Hugeicons", "hugeicons"), ("svg", "Ionicons", "ion"), ("svg", "Feather Icons", "feather"), ("svg", "SVG Icons", "svg_icons")]
    frameworks = [
        ("Tailwind CSS", "high", n("tailwind"), said((tail[0], "arbitrary values (e.g., top-[117px])"), (tail[1], "responsive/state modifiers"), (tail[2], "stylesheet"))),
        ("Bootstrap", "high", least(2, *boot), said((boot[0], "grid system (container + row + col)"), (boot[1], "button variants"), (boot[2], "stylesheet"))),
        ("Material UI (MUI)", "high", n("mui") > 3, many("mui", "MUI components")), ("Chakra UI", "high", n("chakra") > 3, many("chakra", "Chakra components")), ("Ant Design", "high", n("ant") > 3, many("ant", "Ant components")),
        ("Vuetify", "high", ((n("vuetify") > 8) & (n("vuetify_app") > 0)) | ((n("vuetify_theme") > 0) & (n("vuetify") > 5)), many("vuetify", "Vuetify components")),
        ("Shopify Polaris", "high", n("polaris") > 2, many("polaris", "Polaris components")), ("Radix UI", "high", n("radix") > 0, many("radix", "Radix primitives")),
        ("DaisyUI", "high", n("tailwind") & ((n("daisy") > 3) | (n("daisy_theme") > 0)), F.concat(F.lit("Tailwind + "), many("daisy", "DaisyUI components"))),
        ("Foundation", "high", foundation | (n("foundation_file") > 0) | (n("foundation_data") > 0), F.coalesce(F.nullif(said((foundation, "grid/button system"), (n("foundation_file") > 0, "stylesheet")), F.lit("")), F.lit("data attributes"))),
        ("Bulma", "high", least(2, *bulma), said((bulma[0], "columns system"), (bulma[1], "button modifiers"), (bulma[2], "stylesheet"))),
        ("Semantic UI", "high", (n("semantic") > 3) | (n("semantic_file") > 0), many("semantic", ".ui components")), ("UIkit", "high", (n("uikit") > 3) | (n("uikit_file") > 0), many("uikit", "uk- components")),
        ("shadcn/ui", "medium", n("tailwind") & ((n("radix") > 3) | (n("data_state") > 3)) & (n("shadcn_source") | (n("slots") > 5)), F.lit("Tailwind + Radix + component patterns")),
        ("Headless UI", "high", n("tailwind") & (n("headless") > 2), many("headless", "headless components with Tailwind")), ("PrimeReact/Vue/NG", "high", n("prime") > 5, many("prime", "Prime components")),
        ("Mantine", "high", n("mantine") > 3, many("mantine", "Mantine components")), ("Carbon Design System", "high", n("carbon") > 3, many("carbon", "Carbon components")), ("Fluent UI", "high", n("fluent") > 5, many("fluent", "Fluent components")),
        ("Quasar", "high", (n("quasar") > 5) | (n("quasar_app") > 0), many("quasar", "q- components")), ("Element Plus/UI", "high", n("element_plus") > 5, many("element_plus", "el- components"))]
    none = F.lit(None).cast("string")
    return [(kind, name, none, n(k) > 0, none) for kind, name, k in icon] + [("framework", name, F.lit(sure), test, text) for name, sure, test, text in frameworks]


def marks(counters: DataFrame) -> DataFrame:
    """page_id, ord, kind (icon-font, svg, framework), name, confidence, evidence: what the counters of ``evidence`` prove, in a fixed order."""
    tailwind = (F.col("arbitrary").cast("int") + F.col("modifiers").cast("int") + (F.col("tailwind_file") > 0).cast("int")) >= 2
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(k).cast("long").alias("ord"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), sure.alias("confidence"), text.alias("evidence"))) for k, (kind, name, sure, test, text) in enumerate(_rules()))))
    return counters.withColumn("tailwind", tailwind).select("page_id", F.explode(found).alias("x")).select("page_id", "x.*")
