"""Toxicity, quality, near-duplicates, neighbours and the pipeline on small tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from chromaspan.llm import ann, components, neardup, quality, toxicity

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double"


def corpus(rng, n=300):
    """(documents, labels): one in six documents says one of two words and is toxic."""
    rows, marks = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(5, 60))]
        toxic = k % 6 == 0
        if toxic:
            words[:2] = ["vilename", rng.choice(["grimword", "vilename"])]
        rows.append((k, " ".join(words), "en", "s", 0, 0.5))
        marks.append((k, 1, int(toxic)))
    return rows, marks


def test_chain_finds_toxic_documents(spark):
    rows, marks = corpus(random.Random(1))
    rows += [(900, None, None, None, None, None), (901, "", "en", "s", 0, 0.1), (902, "so VILENAME, grimword", "en", "s", 0, 0.1), (903, "clean " * 50000, "en", "s", 0, 0.1), (902, "so VILENAME, grimword", "en", "s", 0, 0.1)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([*marks, (None, 1, 1), (900, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.judged(docs, toxicity.fit(docs, labels)).collect()
    got = {r["doc_id"]: r["toxic"] for r in out}
    assert len(out) == len(rows)
    assert all(got[k] == (k % 6 == 0) for k in range(300))
    assert got[902] and not got[900] and not got[901] and not got[903]
    none = toxicity.fit(docs, labels.where("false"))
    assert toxicity.judged(docs, none).where("p_toxic between 0 and 1").count() == len(rows)
    assert toxicity.judged(docs.where("false"), none).count() == 0


def test_later_models_get_out_of_fold_predictions():
    rng = np.random.default_rng(2)
    dense = rng.random((200, 6)) < 0.3
    y = dense[:, 0].astype(float)
    fold = np.arange(200) % 3
    x = toxicity.Hits(*np.nonzero(dense), 200, 6)
    chain, said = toxicity.fit_chain(x, np.array([y, y]).T, ("a", "b"), {}, fold)
    assert [len(w) for w in chain.weights] == [7, 8]
    assert ((chain.predict(x)[:, 1] > 0.5) == (y > 0)).all()
    # the labels of a fold, however wrong, do not reach its own predictions
    wrong = np.where(fold == 1, 1 - y, y)
    _, other = toxicity.fit_chain(x, np.array([wrong, wrong]).T, ("a", "b"), {}, fold)
    assert np.allclose(said[fold == 1, 0], other[fold == 1, 0]) and not np.allclose(said[fold == 0, 0], other[fold == 0, 0])
    # brute force: the same models over a dense matrix, one fold at a time
    for f in range(3):
        own = fold == f
        w = toxicity.logistic(toxicity.Hits(*np.nonzero(dense[~own]), int((~own).sum()), 6), np.zeros((int((~own).sum()), 0)), y[~own])
        assert np.allclose(said[own, 0], 1 / (1 + np.exp(-(dense[own] @ w[:6] + w[6]))))


def test_features_of_a_fold_are_chosen_without_it(spark):
    rng = random.Random(12)
    rows, totals = [], {}
    for k in range(240):
        y, fold = int(k % 4 == 0), k % 3
        own = {rng.randint(100, 140) for _ in range(5)} | ({1} if y else set()) | ({2} if y and fold == 1 else set()) | ({3} if not y else set())
        rows.append((fold, y, sorted(own)))
        n, m = totals.get(fold, (0, 0))
        totals[fold] = (n + 1, m + y)
    told = {}
    for r in toxicity.telling(spark.createDataFrame(rows, "fold int, y int, features array<long>"), totals).collect():
        told.setdefault(r["fold"], set()).add(r["feature"])
    assert all({1, 3} <= told[f] for f in (-1, 0, 1, 2))
    assert 2 in told[-1] and 2 in told[0] and 2 not in told[1]
    for out in (-1, 0, 1, 2):  # brute force
        rest = [r for r in rows if r[0] != out]
        share = sum(r[1] for r in rest) / len(rest)
        want = set()
        for f in {f for r in rest for f in r[2]}:
            n, k = sum(f in r[2] for r in rest), sum(r[1] for r in rest if f in r[2])
            if n >= 4 and abs(k - n * share) / (n * share * (1 - share)) ** 0.5 >= 5.5:
                want.add(f)
        assert told[out] == want


def test_quality_on_held_out_documents(spark):
    from chromaspan.llm.queries import op6_quality_attention

    out = op6_quality_attention(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    row = out.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row["n"] > 30 and row["right"] >= 0.95
    docs = spark.createDataFrame([(1, None, "", "", 0, 0.0), (2, "", "", "", 0, 0.0), (2, "", "", "", 0, 0.0), (3, "x " * 90000, "", "", 0, 0.0), (None, "y", "", "", 0, 0.0)], DOC)
    model = quality.fit(docs, labels.where("false"))
    assert quality.scores(docs, model).where("score between 0 and 1").count() == 5
    assert quality.scores(docs.where("false"), model).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(3)
    x, doc, y = rng.normal(size=(12, 4)), np.array([0] * 3 + [1] * 5 + [2] * 4), np.array([0.0, 1.0, 1.0])
    m = quality.GatedAttention(4, 3)
    m.fit(x, doc, y, steps=200)
    assert ((m.score(doc, x, 3) > 0.5) == (y > 0.5)).all()


def test_gradients_equal_differences():
    """One step of the fit moves each weight against the gradient that central differences of the loss give."""
    rng = np.random.default_rng(7)
    x, doc, y = rng.normal(size=(9, 3)), np.array([0] * 3 + [1] * 2 + [2] * 4), np.array([0.0, 1.0, 1.0])
    before, after = quality.GatedAttention(3, 2), quality.GatedAttention(3, 2)
    after.fit(x, doc, y, steps=1, rate=1e-3, decay=0.0)
    z = (x - after.mean) / after.scale
    begins = np.array([0, 3, 5])

    def loss():
        s = before.forward(z, begins)[5]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, p in before.p.items():
        flat, moved = p.reshape(-1), (after.p[name] - p).reshape(-1)
        for k in range(len(flat)):
            held = flat[k]
            flat[k] = held + 1e-5
            up = loss()
            flat[k] = held - 1e-5
            slope = (up - loss()) / 2e-5
            flat[k] = held
            if abs(slope) > 1e-6:  # the first step of Adam is the rate against the gradient's sign
                assert np.isclose(moved[k], -1e-3 * np.sign(slope), rtol=1e-2), (name, k)


def brute_groups(texts, width, percent):
    sets = {}
    for k, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(None)
        w = [x for x in w if x]
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    group = {k: k for k in texts}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {k: find(k) for k in ids}, {k: len(s) for k, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(4)) for _ in range(400)]
    texts = {1: None, 2: "", 3: " \n", 4: "one", 5: "One", 6: "one two", 7: "x " * 30000}
    for g in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(12):
            own = list(text)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[100 + len(texts)] = " ".join(own)
            text = own if g % 3 == 0 else text  # chains that drift, and stars
    rows = [(k, t, "", "", 0, 0.0) for k, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[5]], DOC)
    for width, percent in ((3, 85), (5, 80)):
        want, size = brute_groups(texts, width, percent)
        out = neardup.near_duplicates(docs, width, percent).collect()
        assert len(out) == len(rows) + 1
        for r in out:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], size[r["doc_id"]])
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_short_texts_meet_in_a_band():
    """3000 pairs at or little above the threshold, of 6 to 14 shingles: all share a band."""
    from chromaspan.llm import shingles

    rng = random.Random(13)
    rows, bands = neardup.banding(0.85)
    for _ in range(30):
        texts = []
        for _ in range(100):
            words = [f"w{rng.getrandbits(40)}" for _ in range(rng.choice([8, 9, 14, 16]))]
            texts += [" ".join(words).encode(), " ".join([*words, "x"] if len(words) < 14 else ["y", *words, "x"]).encode()]
        doc, s = shingles.shingles(texts, 3)
        sig = shingles.one_permutation(doc, s, len(texts), neardup.BINS)[:, : rows * bands].reshape(len(texts), bands, rows)
        for k in range(0, len(texts), 2):
            assert (sig[k] == sig[k + 1]).all(axis=1).any()


def test_densified_bins_are_drawn_alike_from_the_full_ones():
    from chromaspan.llm import shingles

    doc, s = shingles.shingles([b"a b c d e f g", b"", b"one"], 3)
    sig = shingles.one_permutation(doc, s, 3, 256)
    assert len(set(sig[0].tolist())) == 5 and not sig[1].any() and len(set(sig[2].tolist())) == 1
    plain = {int(h >> np.uint64(56)): v for h, v in zip(s[doc == 0], (shingles.mix(s[doc == 0] + shingles._STEP) >> np.uint64(32)).tolist(), strict=True)}
    for b in range(256):
        assert sig[0, b] == plain[next(k for k in shingles.draws(256)[b].tolist() if k in plain)] if b not in plain else sig[0, b] == plain[b]


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """A template whose copies mostly stay under the threshold, with some pairs over it: as by brute force."""
    monkeypatch.setattr(neardup, "LARGE", 3)
    monkeypatch.setattr(neardup, "PART_NODES", 5)
    rng = random.Random(14)
    base = [f"t{k}" for k in range(90)]
    texts = {}
    for k in range(70):
        own = list(base)
        for x in rng.sample(range(90), 4):
            own[x] = f"u{k}x{x}"
        texts[2 * k] = " ".join(own)
        own[rng.randrange(90)] = "z"
        texts[2 * k + 1] = " ".join(own)
    want, _ = brute_groups(texts, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string"), 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_components_of_a_path(spark):
    n = 200
    links = spark.range(1, n).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(1000, 1001), (1001, 1000)], "a long, b long"))
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert all(got[k] == 1 for k in range(1, n + 1)) and got[1001] == 1000


def test_components_of_stars_take_one_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components, "staged", lambda df, staged=components.staged: tables.append(df) or staged(df))
    links = [(c, 10_000 * c + k) for c in (7, 8) for k in range(300)] + [(9, 9), (7, 70_000), (70_001, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 602 and all(c == (7 if k == 7 or 70_000 <= k < 80_000 else 8) for k, c in got.items())
    assert len(tables) <= 5  # links, picks, joined nodes, no links, names


def test_components_extended_by_links(spark):
    rng = random.Random(31)
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for size, most in ((60, 30), (200, 500), (1000, 400)):
        old, new = ([(rng.randrange(most), rng.randrange(most)) for _ in range(n)] for n in (size, size // 3))
        group = {x: x for x in range(most)}
        for _ in range(most):
            for a, b in old + new:
                group[a] = group[b] = min(group[a], group[b])
        found = components.components(table(old))
        for got in (components.extended(found, table(new)), components.components(table(old + new)), components.extended(components.extended(found, table(new)), table(old))):
            rows = {r["node"]: r["component"] for r in got.collect()}
            assert got.count() == len(rows) and set(rows) == {x for a, b in old + new for x in (a, b) if a != b} | set(rows)
            assert all(group[k] == c for k, c in rows.items())
    assert components.extended(components.components(table([])), table([])).count() == 0


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = centres[rng.integers(12, size=3000)] + 0.4 * rng.normal(size=(3000, 16))
    rows[100:160] = rows[100]
    table = [(k, [float(np.float32(x)) for x in r], 0) for k, r in enumerate(rows)]
    table += [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [1.0, None] * 8, 0), (None, [1.0] * 16, 0), (5080, [], 0)]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    data = np.array([[np.float32(x) for x in r] for r in rows], dtype=np.float64)
    assert sorted(got) == list(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        score = data @ data[q]
        for _, v, s in found:
            assert abs(score[v] - s) < 1e-12 and v != q
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        score[q] = -np.inf
        hit += len({v for _, v, _ in found} & set(np.lexsort((np.arange(3000), -np.round(score, 12)))[:20].tolist()))
    assert hit / (20 * len(got)) >= 0.9
    assert ann.nearest(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(vectors.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in cp.STAGES[:-1]:
        new = stage(spark, at, SF)
        assert new.columns == docs.columns and new.dtypes == docs.dtypes, name
        from chromaspan.llm.common import staged

        new = staged(new)
        assert 0 < new.count() <= at.count()
        at = new
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = docs.join(at.select("doc_id"), "doc_id", "left_semi").join(labels, "doc_id")
    assert kept.where("quality = 0").count() <= 1
    assert at.where("text rlike '[a-z0-9]@mail[0-9]'").count() == 0
    packed = cp.pack(spark, at, SF)
    assert packed.select("doc_id").distinct().count() == at.count()


def test_neighbours_of_repeated_rows_come_once(spark):
    from pyspark.sql import functions as F

    from chromaspan.llm import ann

    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]


def test_repeated_ids_and_many_copies_lose_no_neighbours(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [0.9, 0.1])] * 30 + [(2, [0.8, 0.1]), (3, [0.7, 0.0]), (4, [0.1, 0.0]), (4, [0.6, 0.0])]
    rows += [(k, [0.5, 0.5]) for k in range(100, 140)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got)] == [(1, 1, 0.9), (2, 2, 0.8), (3, 3, 0.7), (4, 100, 0.5), (5, 101, 0.5)]
    every = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 200).collect()
    assert [r["vec_id"] for r in sorted(every)] == [1, 2, 3, *range(100, 140), 4] and sorted(every)[-1]["score"] == 0.1


def test_blocks_hold_every_leaf_once():
    count, first, number = ann.block_map({0: 5, 1: 4, 2: 25, 4: 3}, 5, 10)
    assert count.tolist() == [5, 4, 25, 0, 3]
    places = [range(a, a + n) for a, n in zip(first, number, strict=True)]
    assert number.tolist() == [1, 1, 3, 1, 1] and not set(places[2]) & {x for k in (0, 1, 3, 4) for x in places[k]}


def test_pipeline_on_odd_rows(spark):
    """Null and empty texts, repeated and missing ids, names that clash and an empty table, stage by stage."""
    import corpus_pipeline as cp

    rows = [(1, None, 5), (2, "", 0), (3, "mail a@b.com or a@b.com", 23), (3, "mail a@b.com or a@b.com", 23), (None, "one two three four five six", 1), (None, None, None), (7, "one two three four five six", 2), (8, "one two three four five six", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "'l' as lang", "1 as p_toxic", "2 as score", "3 as kept", "4 as c0", "5 as `a.b`", "6 as pii_spans")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    kept = [r["doc_id"] for r in cp.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, 7, None, None]
    hidden = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.hide_personal_data(spark, docs.where("doc_id is not null"), SF).collect()}
    assert hidden[3] == ("mail [EMAIL] or [EMAIL]", 23) and hidden[1] == (None, 5)
    assert cp.pack(spark, docs, SF).count() == len(rows) and cp.pack(spark, docs.where("false"), SF).count() == 0
