"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded (a learned layer over measures of
its characters and words), gated attention weighs the passages, and the weighted representation is scored.
Only documents have labels; which passages matter is learned from them.

Labels come from a sample of about SAMPLE labelled documents outside the held-out fold (the bound is a
parameter, the pick a hash of doc_id). The model's input is the text alone. Fitting is full-batch Adam with a
fixed seed in numpy on the driver; scoring reads whole texts, wherever they lie, without a shuffle.

Defined cases: a null text is the empty text; an empty text is one passage of zeros; without any labels, or
with one class only, every score is that class's smoothed share; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, PASSAGE, FOLDS, UNITS, STEPS = 4000, 64, 5, 12, 300
#: Bytes that are counted each on its own; others fall into classes.
SIGNS = b".,;:!?#$%&*|\"'()-_=/<>@+~^[]{}\\`"


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from: crc32 of the id as text, modulo FOLDS, is 0 (a null id: as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def measures(texts: list[bytes]):
    """(document of each passage, matrix of measures): every text has one passage at least."""
    import numpy as np

    from .shingles import words

    kind = np.zeros(256, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    kind[10], kind[32] = 5, 6
    for k, c in enumerate(SIGNS):
        kind[c] = 7 + k
    n_kinds = 7 + len(SIGNS)
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    h, at = words(raw)
    own = np.searchsorted(starts, at, "right") - 1
    first = np.searchsorted(own, np.arange(len(texts)))
    nth = np.arange(len(own)) - first[own]
    count = np.maximum(1, -(-np.bincount(own, minlength=len(texts)) // PASSAGE))
    base = np.concatenate(([0], np.cumsum(count)))
    passage = base[own] + nth // PASSAGE
    n = int(base[-1])
    doc = np.repeat(np.arange(len(texts)), count)
    per_word = np.bincount(passage, minlength=n).astype(float)
    # bytes belong to the passage of the last word that began before them
    word_of = np.searchsorted(at, np.arange(len(raw)), "right") - 1
    inside = word_of >= 0
    of = passage[word_of[inside]] if len(at) else np.zeros(0, np.int64)
    hist = np.bincount(of * n_kinds + kind[raw[inside]], minlength=n * n_kinds).reshape(n, n_kinds) if n else np.zeros((0, n_kinds))
    size = np.maximum(hist.sum(axis=1), 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((h, own))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    length = np.diff(np.append(at, len(raw)))
    upper = (raw[at] >= 65) & (raw[at] <= 90) if len(at) else np.zeros(0, bool)
    m = np.maximum(per_word, 1)
    extra = [np.bincount(passage, w, minlength=n) / m for w in (same.astype(float), again.astype(float), length / 10.0, upper.astype(float), np.minimum(length, 40) ** 2 / 100.0)]
    return doc, np.hstack([np.sqrt(hist / size[:, None]), np.array(extra).T.reshape(n, len(extra)), (np.minimum(per_word, PASSAGE) / PASSAGE)[:, None]])


class GatedAttention:
    """Encoder tanh(xE + e); weights softmax over a bag of (tanh(hV) * sigmoid(hU)) w; score sigmoid(z c + b)."""

    def __init__(self, inputs: int, units: int = UNITS, seed: int = 5):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, inputs**-0.5, (inputs, units)), "e": np.zeros(units), "V": rng.normal(0, 0.3, (units, units)), "U": rng.normal(0, 0.3, (units, units)), "w": rng.normal(0, 0.3, units), "c": rng.normal(0, 0.3, units), "b": np.zeros(1)}
        self.mean, self.scale, self.share = np.zeros(inputs), np.ones(inputs), None

    def forward(self, x, begins):
        import numpy as np

        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        sizes = np.diff(np.append(begins, len(x)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, begins), sizes))
        a /= np.repeat(np.add.reduceat(a, begins), sizes)
        z = np.add.reduceat(a[:, None] * h, begins, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return h, t, g, a, z, y, sizes

    def fit(self, x, doc, y, steps: int = STEPS, rate: float = 0.03, decay: float = 1e-4):
        import numpy as np

        if len(y) == 0 or y.min() == y.max():
            self.share = (float(y.sum()) + 1) / (len(y) + 2)
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        begins = np.searchsorted(doc, np.arange(len(y)))
        p = self.p
        one, two = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            h, t, g, a, z, s, sizes = self.forward(x, begins)
            d = (s - y) / len(y)
            dz = np.repeat(d[:, None] * p["c"], sizes, axis=0)
            da = (dz * h).sum(axis=1)
            da = a * (da - np.repeat(np.add.reduceat(a * da, begins), sizes))
            dt, dg = da[:, None] * p["w"] * g * (1 - t**2), da[:, None] * p["w"] * t * g * (1 - g)
            dh = (dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
            grads = {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ d, "b": np.array([d.sum()])}
            for k, v in grads.items():
                v = v + decay * p[k]
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.999 * two[k] + 0.001 * v * v
                p[k] -= rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, doc, x, n: int):
        import numpy as np

        if self.share is not None:
            return np.full(n, self.share)
        return self.forward((x - self.mean) / self.scale, np.searchsorted(doc, np.arange(n)))[5] if n else np.zeros(0)


def passages(texts: DataFrame) -> DataFrame:
    """doc_id, y, m array<float>: the measures of a document's passages in a row, for fitting."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts_ = [t.encode() for t in b.column(1).to_pylist()]
            for lo, hi in common.text_chunks([len(t) for t in texts_]):
                doc, x = measures(texts_[lo:hi])
                ends = np.searchsorted(doc, np.arange(hi - lo + 1)) * x.shape[1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.reshape(-1).astype(np.float32)))], names=["doc_id", "y", "m"])

    return texts.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, m array<float>")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, label: str = "quality") -> GatedAttention:
    """A model from about ``most`` labelled documents outside the held-out fold."""
    import numpy as np

    sample = passages(common.labelled_sample(docs, labels, label, most, ~held_out())).toArrow().combine_chunks()
    order = np.argsort(sample.column("doc_id").to_numpy(), kind="stable")
    sample = sample.take(order)
    width = measures([b""])[1].shape[1]
    if not sample.num_rows:
        return GatedAttention(width).fit(np.zeros((0, width)), np.zeros(0, int), np.zeros(0))
    lists = sample.column("m").combine_chunks()
    x = np.asarray(lists.flatten(), float).reshape(-1, width)
    doc = np.repeat(np.arange(sample.num_rows), np.asarray(lists.value_lengths()) // width)
    return GatedAttention(width).fit(x, doc, sample.column("y").to_numpy().astype(float))


def scores(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """doc_id, held_out, score: one row per input row."""
    return apply(common.whole_texts(docs), model).select("doc_id", held_out().alias("held_out"), "score")


def apply(rows: DataFrame, model: GatedAttention) -> DataFrame:
    """The rows with their score; they need a column text without nulls, other columns pass through."""
    common.bound_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    at = rows.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = [t.encode() for t in b.column(at).to_pylist()]
            parts = [shared.value.score(*measures(texts[lo:hi]), hi - lo) for lo, hi in common.text_chunks([len(t) for t in texts])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=[*b.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
