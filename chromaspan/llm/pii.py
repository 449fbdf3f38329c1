"""Personal data by weak supervision, in DataFrame and SQL functions only.

Strict patterns give the base spans (email, ip, card, phone), which always stay. Looser patterns give further
candidates of the same kinds. Labelers vote on every candidate, yes (1), no (-1) or silent (0): the strict
pattern, a gazetteer (domain endings, card issuers, calling codes, address ranges), the words before it, the
words after it, its shape, and its borders. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is; the posteriors are soft labels for a final logistic classifier over the votes
and the kind, which decides about the candidates that no strict pattern found.

The pattern table is bounded (kinds x 3 ** labelers), so its size does not depend on the corpus; candidates
stay in their document's row, so nothing but pattern counts is shuffled.

Offsets are code points, ends exclusive. Patterns are possessive or anchored at a run's begin (or the end of
the match before), which gives the same leftmost matches in linear time, without deep recursion.

Defined cases: a null text is the empty text without spans; without candidates, or if all are strict, the
classifier adds nothing; repeated rows give repeated results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,4}(?![ -]?[0-9])",
    "phone": r"(?<![0-9+(])(?<!\+[0-9]{1,3} )(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
LOOSE_NEEDS = {"email": r"(?i)[(\[{]at[)\]}]", "ip": r"(?:[0-9A-Fa-f]{1,4}:){3}", "card": r"[0-9]{4}[ -]?[0-9]{4}", "phone": r"[0-9]{3}[.-][0-9]{4}"}
#: Gazetteers.
ENDINGS = "com|net|org|edu|gov|mil|int|info|biz|io|co|eu|de|fr|es|it|nl|uk|us|ca|au|ch|at|be|se|no|dk|fi|pl|pt|br|in|jp|cn|ru|example|test"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92"
BEFORE = {"email": "e-?mail|contact|correo|courriel|write to|mailto", "ip": r"\bip\b|address|host|server|adresse", "card": "card|visa|master|amex|karte|carte|tarjeta|payment", "phone": r"phone|\btel|call|mobile|telefon|fax|móvil"}
AGAINST = "order|invoice|isbn|serial|sku|version|build|ticket|hash|token|commit"
LABELERS = ("strict", "gazetteer", "before", "after", "shape", "borders")
NEAR = 40
ROUNDS = 12
CANDIDATE = "struct<kind:string,k:int,start:long,end:long,base:boolean,v0:int,v1:int,v2:int,v3:int,v4:int,v5:int>"


def running_sums(values: Column) -> Column:
    """Sums of the elements before each one, in blocks of about the root of the length, so that appending stays cheap."""
    n = F.size(values)
    width = F.greatest(F.lit(8), F.ceil(F.sqrt(n.cast("double"))).cast("int"))

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int")), lambda b: sums(F.slice(values, b * width + 1, width)))
    totals = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
    return F.slice(F.flatten(F.zip_with(blocks, F.slice(totals, 1, F.size(blocks)), lambda b, t: F.transform(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(1))), lambda x: x + t))), 1, n)


def matches(text: Column, pattern: str, when: Column) -> Column:
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """Whether a strict match is a base span."""
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def votes(kind: str, value: Column, base: Column, left: Column, right: Column) -> list[Column]:
    never = F.lit(False)
    n, low = F.length(digits(value)), F.lower(left)
    gazetteer = {
        "email": vote(F.lower(value).rlike(rf"[.\])}} ](?:{ENDINGS})$"), F.lower(value).rlike(r"\.[0-9-]+$")),
        "ip": vote(value.rlike(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-3][0-9])\.") | value.contains(":"), value.rlike(r"^0+\.") | value.rlike(r"^0*2[4-9][0-9]\.")),
        "card": vote(digits(value).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), digits(value).rlike("^[01789]")),
        "phone": vote(value.rlike(rf"^\+(?:{CALLING})(?![0-9]{{6}})") | value.rlike(r"^\("), value.rlike(r"^\+0")),
    }[kind]
    shape = {
        "email": vote(F.length(value).between(6, 80), F.length(value) > 120),
        "ip": vote(F.length(value).between(7, 39), F.length(value) > 39),
        "card": vote(n.isin(15, 16), (n < 13) | (n > 19)),
        "phone": vote(n.between(10, 12), (n < 9) | (n > 15)),
    }[kind]
    return [vote(base, ~base), gazetteer, vote(low.rlike(rf"(?:{BEFORE[kind]})[^a-z]{{0,12}}$"), low.rlike(rf"(?:{AGAINST})[^a-z]{{0,12}}$")), vote(never, F.lower(right).rlike(rf"^[^a-z]{{0,3}}(?:{AGAINST})")), shape, vote(~left.rlike(r"[\p{L}\p{N}_]$") & ~right.rlike(r"^[\p{L}\p{N}_]"), left.rlike(r"[\p{N}_]$") | right.rlike(r"^[\p{N}_]"))]


def described(k: int, kind: str, loose: bool, found: Column, gaps: Column, sums: Column) -> Column:
    """The matches as candidates: where they lie, whether they are base spans, and how the labelers vote."""

    def one(i: Column) -> Column:
        value, gap, after = F.get(found, i), F.get(gaps, i), F.get(gaps, i + 1)
        start = F.get(sums, i) + F.length(gap)
        base = F.lit(False) if loose else passes(kind, value)
        said = votes(kind, value, base, F.right(gap, F.lit(NEAR)), F.left(after, F.lit(NEAR)))
        return F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), start.alias("start"), (start + F.length(value)).alias("end"), base.alias("base"), *(v.alias(f"v{n}") for n, v in enumerate(said)))

    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.size(found) - 1), one)).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def beside(base: Column, extra: Column) -> Column:
    """The base spans and those extra candidates that touch none of them, by start."""
    free = F.filter(extra, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return F.when(F.size(extra) > 0, by_start(F.concat(base, free))).otherwise(base)


def candidates(rows: DataFrame) -> DataFrame:
    """The rows (which need a column text without nulls) with pii_found: the candidates, by kind and start."""
    text, kept = F.col("text"), rows.columns
    rows = rows.withColumn("pii_digit", text.rlike("[0-9]{2}|[0-9][ -][0-9]")).withColumn("pii_dots", text.rlike(r"[0-9]\.[0-9]+\."))
    sources = [(k, kind, loose) for k, kind in enumerate(KINDS) for loose in (False, True)]
    column = lambda c, k, loose: f"pii_{c}{k}{int(loose)}"
    # a select a step, not a withColumn a column: the steps use each other's results and must not be merged
    tried = {}
    for k, kind, loose in sources:
        when = text.rlike(LOOSE_NEEDS[kind]) if loose else text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        if kind == "phone" and not loose:
            when = when & text.rlike(r"\+[0-9]")
        elif kind != "email":
            when = F.col("pii_dots" if kind == "ip" and not loose else "pii_digit") & when
        tried[column("m", k, loose)] = matches(text, (LOOSE if loose else STRICT)[kind], when)
    rows = rows.withColumns(tried)
    # the texts between matches tell where these lie, and what stands around them
    rows = rows.withColumns({column("g", k, loose): F.when(F.size(column("m", k, loose)) > 0, F.split(text, F.lit((LOOSE if loose else STRICT)[kind]), F.lit(-1))) for k, kind, loose in sources})
    before = {}
    for k, _, loose in sources:
        m, g = F.col(column("m", k, loose)), F.col(column("g", k, loose))
        before[column("s", k, loose)] = F.when(F.size(m) > 0, running_sums(F.zip_with(m, F.slice(g, 1, F.size(m)), lambda x, y: (F.length(x) + F.length(y)).cast("long"))))
    rows = rows.withColumns(before)
    rows = rows.withColumns({column("c", k, loose): described(k, kind, loose, *(F.col(column(c, k, loose)) for c in "mgs")) for k, kind, loose in sources})
    parts = [beside(F.filter(column("c", k, False), lambda c: c["base"]), F.col(column("c", k, True))) for k in range(len(KINDS))]
    return rows.select(*(f"`{c}`" for c in kept), F.concat(*parts).alias("pii_found"))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over (v0.., n): the share of true candidates, and for each labeler and vote the
    probabilities given true and given false. The driver gets the bounded pattern table, so that a round is no plan of
    its own."""
    import numpy as np

    share = 0.5
    odds = [{1: (0.7, 0.2), 0: (0.2, 0.3), -1: (0.1, 0.5)} for _ in LABELERS]
    rows = np.array(patterns.select(*(f"v{i}" for i in range(len(LABELERS))), "n").collect(), float).reshape(-1, len(LABELERS) + 1)
    rows = rows[np.lexsort(rows.T)]
    n, total = rows[:, -1], float(rows[:, -1].sum())
    for _ in range(rounds if total else 0):
        logit = np.full(len(n), np.log(share / (1 - share)))
        for i in range(len(LABELERS)):
            for v, (t, f) in odds[i].items():
                logit[rows[:, i] == v] += np.log(t / f)
        p = n / (1 + np.exp(-logit))
        true = float(p.sum())
        false = total - true
        share = min(0.99, max(0.01, true / total))
        said = [{v: (float(p[rows[:, i] == v].sum()), float(n[rows[:, i] == v].sum())) for v in (1, 0, -1)} for i in range(len(LABELERS))]
        odds = [{v: ((t + 1) / (true + 3), (both - t + 1) / (false + 3)) for v, (t, both) in own.items()} for own in said]
    return share, odds


def posterior(share: float, odds: list[dict[int, tuple[float, float]]]) -> Column:
    """The probability that a candidate with votes v0.. is true."""
    import math

    def weight(i: int, c: Column) -> Column:
        w = {v: math.log(t / f) for v, (t, f) in odds[i].items()}
        return F.when(c == 1, w[1]).when(c == -1, w[-1]).otherwise(w[0])

    logit = reduce(lambda a, b: a + b, (weight(i, F.col(f"v{i}")) for i in range(len(LABELERS))), F.lit(math.log(share / (1 - share))))
    return 1 / (1 + F.exp(-logit))


def span_classifier(patterns: DataFrame) -> tuple[list[float], float] | None:
    """Weights over (votes, kinds) and an intercept, fitted on the pattern table with EM's posteriors as weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    facts = patterns.agg(F.count("*").alias("rows"), F.min("v0").alias("low")).first()
    if facts["rows"] < 2 or facts["low"] == 1:
        return None
    share, odds = reliabilities(patterns)
    features = F.array(*[F.col(f"v{i}").cast("double") for i in range(1, len(LABELERS))], *[(F.col("k") == k).cast("double") for k in range(len(KINDS))])
    soft = patterns.withColumn("p", posterior(share, odds)).withColumn("features", array_to_vector(features))
    rows = soft.select("features", F.lit(1.0).alias("label"), (F.col("p") * F.col("n")).alias("weight")).union(soft.select("features", F.lit(0.0).alias("label"), ((1 - F.col("p")) * F.col("n")).alias("weight")))
    model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=25).fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept)


def probability(c: Column, model: tuple[list[float], float]) -> Column:
    weights, intercept = model
    n = len(LABELERS) - 1
    logit = F.lit(intercept)
    for i in range(n):
        logit = logit + F.lit(weights[i]) * c[f"v{i + 1}"]
    for k in range(len(KINDS)):
        logit = logit + F.when(c["k"] == k, weights[n + k]).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def with_spans(rows: DataFrame, limit: float = 0.9) -> DataFrame:
    """The rows (which need a column text without nulls) with pii_spans: array<struct<kind, k, start, end, base>>
    by kind as in KINDS, then start: base spans, and the candidates that the classifier gives ``limit`` at least.
    """
    return _decided(common.staged(candidates(rows)), limit)


def _decided(held: DataFrame, limit: float) -> DataFrame:
    kept = [c for c in held.columns if c != "pii_found"]
    votes_ = [f"v{i}" for i in range(len(LABELERS))]
    counted = held.select(F.explode("pii_found").alias("c")).select("c.k", *(f"c.{v}" for v in votes_))
    patterns = common.staged(counted.groupBy("k", *votes_).agg(F.count("*").cast("double").alias("n")))
    model = span_classifier(patterns)
    keep = F.filter("pii_found", lambda c: c["base"] | (probability(c, model) >= limit if model else F.lit(False)))
    spans = F.transform(keep, lambda c: F.struct(*(c[x].alias(x) for x in ("kind", "k", "start", "end", "base"))))
    return held.select(*(f"`{c}`" for c in kept), spans.alias("pii_spans"))


def find(docs: DataFrame, limit: float = 0.9) -> DataFrame:
    """doc_id and spans: one row per input row. Texts are not written: only ids and candidates are staged."""
    rows = common.whole_texts(docs)
    held = candidates(rows).drop("text")
    return _decided(common.staged(held), limit).select("doc_id", F.col("pii_spans").alias("spans"))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; where spans overlap, the first's kind."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(a["k"] - b["k"]))
    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, c: Column) -> Column:
        between = F.substring(text, (acc["at"] + 1).cast("int"), (c["start"] - acc["at"]).cast("int"))
        grown = F.when(c["start"] >= acc["at"], F.concat(acc["parts"], F.array(between, F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))))).otherwise(acc["parts"])
        return F.struct(grown.alias("parts"), F.greatest(acc["at"], c["end"]).alias("at"))

    done = F.aggregate(ordered, begin, step)
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["parts"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))).otherwise(text)
