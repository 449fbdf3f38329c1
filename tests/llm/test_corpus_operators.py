"""Suffix tree scores, prefix trie and importance resampling against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chromaspan.llm import prefix_trie, queries, resampling, suffix_tree

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [None, "", " \t", "A", "The cat sat on the mat\x0bnow", "the CAT sat on a mat", "née \x1c\x85 中文 🎉🎉 the", "x " * 700, "y" * 5000, "the cat sat on the mat now", "The cat sat on the mat\x0bnow"]


def docs_of(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "k", 1, "held", 0.5) for i, t in rows], "doc_id long, text string, key string, rank int, held string, score double")


def base_scores(docs, held):
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), "\n"] for _, t in docs]
    seen = Counter(w for ws, out in zip(words, held, strict=True) if not out for w in ws)
    n, v = sum(seen.values()), len(seen)
    return [(len(ws), sum(w in seen for w in ws), n, sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws in words]


class Plain:
    """The suffix tree by its definition, over dictionaries."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for t in texts:
            for past, s in self.windows(t):
                for k in range(suffix_tree.DEPTH + 1):
                    self.counts[past[len(past) - k :]][s] += 1
        self.n = sum(self.counts[b""].values())
        least, entry = max(suffix_tree.LEAST_COUNT, suffix_tree.LEAST_SHARE * self.n), max(1.0, suffix_tree.LEAST_SHARE * self.n / suffix_tree.LISTED)
        self.p, self.rest = {}, {}
        passed = set()
        for c in sorted((c for c in self.counts if c and sum(self.counts[c].values()) >= least), key=len):
            own, n = self.counts[c], sum(self.counts[c].values())
            listed = [s for s in own if own[s] >= entry]
            shorter = {s: self.probability(c[1:], s) for s in listed}
            self.p[c] = {s: max(own[s] - 0.6, 0) / n + 0.6 * len(own) / n * shorter[s] for s in listed}
            left, theirs = max(1 - sum(self.p[c].values()), 1e-12), max(1 - sum(shorter.values()), 1e-12)
            self.rest[c] = left / theirs
            gain = n * (sum(p * math.log(p / shorter[s]) for s, p in self.p[c].items()) + left * math.log(left / theirs))
            if gain >= suffix_tree.GAIN:
                passed |= {c[k:] for k in range(len(c))}
        self.p = {c: p for c, p in self.p.items() if c in passed}

    @staticmethod
    def windows(text):
        raw = b"\t" * suffix_tree.DEPTH + b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOW).encode())) + b"\n"
        return [(raw[k - suffix_tree.DEPTH : k], raw[k]) for k in range(suffix_tree.DEPTH, len(raw))]

    def probability(self, context, s):
        if context in self.p:
            return self.p[context][s] if s in self.p[context] else self.rest[context] * self.probability(context[1:], s)
        if context:
            return self.probability(context[1:], s)
        return (self.counts[b""][s] + 0.1) / (self.n + 0.1 * suffix_tree.PLACES)

    def score(self, text):
        return sum(math.log10(self.probability(past, s)) for past, s in self.windows(text))


def test_suffix_tree_by_its_definition(spark):
    rng = random.Random(5)
    syllables = ["ba", "do", "The", "in", "é", "chi"]
    rows = [(k, t) for k, t in enumerate([*ODD, *(" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 60))) for _ in range(60))])]
    rows += [(None, "the cat"), (4, rows[4][1]), (4, "another text under one id")]
    docs = docs_of(spark, rows).repartition(3)
    model = suffix_tree.fit(docs)
    held = [crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    assert 0 < sum(held) < len(held) / 2
    plain = Plain([t for (_, t), out in zip(rows, held, strict=True) if not out])
    assert sum(map(len, model.tree.states)) == len(plain.p) > 100
    got = defaultdict(list)
    for r in suffix_tree.scores(docs, model).collect():
        got[r["doc_id"], r["n_tokens"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for (i, t), out, (n, known, total, base) in zip(rows, held, base_scores(rows, held), strict=True):
        assert any(r["held_out"] == out and r["n_known"] == known and r["train_tokens"] == total and r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(plain.score(t)) for r in got[i, n]), (i, t)


def test_suffix_tree_gives_probabilities_and_reads_long_texts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = suffix_tree.fit(docs)
    rng = np.random.default_rng(1)
    pasts = rng.choice(np.frombuffer(b"the ,.ab\t", np.uint8), (200, suffix_tree.DEPTH)).astype(np.uint64)
    contexts = sum(pasts[:, k] << np.uint64(8 * k) for k in range(suffix_tree.DEPTH))
    assert np.allclose(model.tree.probability_sums(contexts), 1, atol=1e-9)
    texts = [suffix_tree.normal(r["text"] or "") for r in docs.select("text").collect()]
    score = lambda t: sum(model.tree.log_probability(x).sum() for _, x in suffix_tree._windows(suffix_tree._framed([t])[0]))
    whole = [score(t) for t in texts]
    got = sorted(r["score"] for r in suffix_tree.scores(docs, model).collect())
    assert np.allclose(got, np.sort(whole) / math.log(10))
    monkeypatch.setattr(suffix_tree, "BLOCK", 512)
    assert np.allclose([score(t) for t in texts], whole) and max(map(len, texts)) > 5000


def test_suffix_tree_query_on_held_out_documents(spark):
    rows = queries.op11_suffix_tree_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.max("score")).first()
    assert rows[0] > rows[1] and rows[2] < 0


def test_suffix_tree_sums_waiting_counts_in_ranges(monkeypatch):
    """What waits to be summed is not copied whole: the peak stays near the 16 bytes a key that are held."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 100_000))) for _ in range(40)]
    monkeypatch.setattr(suffix_tree, "FLUSH_BYTES", 1 << 18)
    tracemalloc.start()
    got, seen = Counter(), 0
    for b in suffix_tree._counter(iter([pa.RecordBatch.from_pydict({"text": texts})])):
        seen = max(seen, tracemalloc.get_traced_memory()[1])
        n = b.column("n").to_numpy()
        got[b.column("kind")[0].as_py()] += int(n.sum())
    tracemalloc.stop()
    assert got == {0: sum(len(t) + 1 for t in texts), 1: 40, 2: 40}
    assert seen < 32 * suffix_tree.HELD_KEYS
    parts = [suffix_tree._counted(rng.integers(0, 50_000, 30_000).astype(np.uint64)) for _ in range(5)]
    ranges = list(suffix_tree._merged_ranges(parts, 4000))
    whole = suffix_tree._merged(parts)
    assert len(ranges) > 20 and max(len(k) for k, _ in ranges) < 8000
    assert all(np.array_equal(np.concatenate(c), w) for c, w in zip(zip(*ranges, strict=True), whole, strict=True))


def test_suffix_tree_learns_rare_passages_of_a_large_corpus(spark):
    """A context that occurs four times is a candidate, however many symbols the corpus has."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    filler = [" ".join(rng.choices(words, k=2000)) for _ in range(20)]
    passage = "zyx wvut qpon"
    rows = [(k, f"{filler[k % 20]} {passage}" if k in (1, 2, 3, 5) else filler[k % 20]) for k in range(460)]
    held = F.col("doc_id") % 10 == 0
    model = suffix_tree.fit(docs_of(spark, rows).repartition(4), held)
    assert 1e6 * 4 < sum(len(t) + 1 for k, t in rows if k % 10)
    raw = suffix_tree._framed([suffix_tree.normal(passage)])[0]
    window = np.concatenate([x for _, x in suffix_tree._windows(raw)])
    log = model.tree.log_probability(window[6:])  # what follows "zyx wv" and so on
    assert np.all(log > math.log(0.5)), np.exp(log)
    got = suffix_tree.scores(docs_of(spark, [(10, passage)]), model).first()
    assert got["score"] == pytest.approx(model.tree.log_probability(window).sum() / math.log(10))


@pytest.mark.parametrize("share", [1.0, 0.004, 0.0])
def test_suffix_tree_scores_do_not_hang_on_which_windows_are_frequent(spark, monkeypatch, share):
    rows = [(k, " ".join(random.Random(k).choices(["the", "cat", "sat", "on", "a", "mat", "é"], k=30))) for k in range(40)] + [(50, None), (51, "unseen Zebra"), (3, "other text")]
    docs = docs_of(spark, rows)
    monkeypatch.setattr(suffix_tree, "HOT_WINDOWS", share)
    monkeypatch.setattr(suffix_tree, "ROW_ENTRIES", 3)
    model = suffix_tree.fit(docs)
    held = [crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    plain = Plain([t for (_, t), out in zip(rows, held, strict=True) if not out])
    seen = sum(len(plain.windows(t)) for (_, t), out in zip(rows, held, strict=True) if not out)
    kinds = Counter(w for (_, t), out in zip(rows, held, strict=True) if not out for w in plain.windows(t))
    assert len(model.windows[0]) == sum(n >= share * seen for n in kinds.values())
    assert sorted(r["score"] for r in suffix_tree.scores(docs, model).collect()) == pytest.approx(sorted(plain.score(t) for _, t in rows))


def test_suffix_tree_of_nothing(spark):
    none = docs_of(spark, []).where("doc_id > 0")
    assert suffix_tree.scores(none, suffix_tree.fit(none)).count() == 0
    alone = docs_of(spark, [(4, None), (None, "a b")])  # 4 is trained on; a null id is held out
    out = {r["doc_id"]: r for r in suffix_tree.scores(alone, suffix_tree.fit(alone, F.lit(True))).collect()}
    assert out[4]["n_tokens"] == 1 and out[None]["n_known"] == 0 and out[None]["train_tokens"] == 0
    assert out[4]["base_score"] == pytest.approx(0.0) and out[None]["score"] == pytest.approx(4 * math.log10(1 / suffix_tree.PLACES))


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [v[2:] for v in sorted(vs, key=lambda v: v[:2])] for c, vs in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members, kids, leaves, saved, out = defaultdict(list), defaultdict(list), {}, {}, set()
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * len(k[-1][1].encode() if k else b"") + sum(saved[x] for x in kids[k])
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(k))))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(df):
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_trie_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op12_prefix_trie(spark, SF)
    assert trie_rows(df) == brute_trie(rows)
    arcs = sorted(x for r in df.select("enter_at", "exit_at").collect() for x in r)
    assert arcs == list(range(len(arcs)))


def test_trie_in_small_blocks_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "POSITIONS", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    monkeypatch.setattr(prefix_trie.ranked, "__defaults__", (3,))
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "b", None, "é" * 3])) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(60, t, "user", f"turn {t % 7}") for t in range(150)] + [(61, t, "user", f"turn {t % 7}") for t in range(150)]  # long ones
    rows += [(c, 0, "user", "same") for c in range(100, 160)]  # many of one turn
    rows += [(None, 1, "user", "no id"), (200, None, "user", "first"), (200, 0, "user", "second"), (200, 0, "user", "second")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, at string").repartition(5)
    assert trie_rows(prefix_trie.prefix_trie(df)) == brute_trie(rows)
    assert prefix_trie.prefix_trie(df.where("conv_id < 0")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def brute_resampling(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    grams = lambda w: [crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]
    found = [(i, grams(words_of(t)), len(words_of(t))) for i, t in docs]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in grams(words_of(x)))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    rows = []
    for i, f, size in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, size])
    drawn = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def drawn_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resampling_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert drawn_rows(queries.op13_importance_resampling(spark, SF)) == brute_resampling(docs, target)


def test_resampling_of_longer_runs_ties_and_odd_rows(spark):
    rows = list(enumerate([*ODD, *("w%d x y " % (k % 9) * 8 for k in range(200))]))
    rows += [(50, rows[50][1])] * 30 + [(None, "null id " * 15)] * 3
    target = ["x y z", None, "", "the cat"]
    out = resampling.resampled(docs_of(spark, rows).repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), longest=3, buckets=50, percent=40)
    assert drawn_rows(out) == brute_resampling(rows, target, 3, 50, 20, 40)
    empty = docs_of(spark, []).where("doc_id > 0")
    assert resampling.resampled(empty, empty).count() == 0
    none = resampling.resampled(docs_of(spark, rows[:30]), empty, percent=100)
    assert drawn_rows(none) == brute_resampling(rows[:30], [], percent=100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5), st.integers(1, 4))
def test_crcs_of_runs_from_prefixes(texts, n):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = [(int(o) + lo, int(b)) for lo, own, bucket, _ in resampling._buckets(texts, n, 1 << 31) for o, b in zip(own, bucket, strict=True)]
    want = [(k, crc32(" ".join(w[i : i + m]).encode()) % (1 << 31)) for k, w in enumerate(map(words_of, texts)) for m in range(1, n + 1) for i in range(len(w) - m + 1)]
    assert sorted(got) == sorted(want)


def test_running_crcs_go_on_over_blocks(monkeypatch):
    text = "some Words é " * 500
    whole = resampling.scanned(text)
    monkeypatch.setattr(resampling, "BLOCK", 100)
    parts = resampling.scanned(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and len(whole[1]) == 1500
