"""Toxicity by a classifier chain of linear models over words and word beginnings.

The categories stand in a fixed order; each one's logistic model also gets the probabilities of the categories
before it. While fitting, those are out-of-fold predictions, so a later model learns from what the earlier
ones say about documents they have not seen. The last category decides.

The corpus labels toxic documents only as such, so the chain's earlier categories are derived from the label
and the evidence: ``repeated`` (toxic, and at least two different telling features) and ``dense`` (toxic, and
telling features in at least one word of a hundred); the last is ``toxic`` itself. A caller with real category
columns passes those instead (see fit_chain).

Features are the distinct words of a text in lower case, and their first 4, 5 and 6 letters, as 32-bit hashes;
kept are those that go with the label (or with its absence) beyond chance, at most KEPT. They are counted by Spark;
the driver gets the kept ones and which sample documents have them. Each fold has its own choice, made without the
fold's documents, so nothing that an out-of-fold prediction rests on has seen them. Fitted on a sample of about
SAMPLE labelled documents (the bound is a parameter, the pick a hash of doc_id); scoring reads whole texts.

Defined cases: a null text is the empty text; without features, or labels of one class, the model gives the
smoothed share of the label; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, KEPT, FOLDS, WORDS_KEPT = 6000, 1500, 3, 200_000
CATEGORIES = ("repeated", "dense", "toxic")
LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """The hashes of a word and of its beginnings."""
    keys = [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)]
    return tuple(zlib.crc32(k.encode()) for k in keys)


def sample_features(sample: DataFrame) -> DataFrame:
    """doc_id, y, n_words, features array<long>: for the bounded sample only."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            n, found = [], []
            for t in b.column(1).to_pylist():
                words = LETTERS.findall(t.lower())
                n.append(len(words))
                own: set[int] = set()
                for w in set(words):
                    own.update(known.get(w) or known.setdefault(w, word_features(w)))
                if len(known) > WORDS_KEPT:
                    known.clear()
                found.append(sorted(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "y", "n_words", "features"])

    return sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, n_words long, features array<long>")


class Hits:
    """A 0/1 matrix by the places of its ones: document and column of each."""

    def __init__(self, row, col, rows: int, cols: int):
        self.row, self.col, self.rows, self.cols = row, col, rows, cols

    def times(self, w):
        import numpy as np

        return np.bincount(self.row, w[self.col], self.rows)

    def back(self, r):
        import numpy as np

        return np.bincount(self.col, r[self.row], self.cols)

    def only(self, rows=None, cols=None) -> Hits:
        """The ones of the marked rows, numbered anew, and of the marked columns."""
        import numpy as np

        good = np.ones(len(self.row), bool)
        if rows is not None:
            good &= rows[self.row]
        if cols is not None:
            good &= cols[self.col]
        at = self.row if rows is None else (np.cumsum(rows) - 1)[self.row]
        return Hits(at[good], self.col[good], self.rows if rows is None else int(rows.sum()), self.cols)


def logistic(x: Hits, said, y, steps: int = 400, penalty: float = 0.3):
    """Weights of a penalised logistic model by accelerated full-batch gradients: features, earlier categories, intercept."""
    import numpy as np

    f, k, n = x.cols, said.shape[1], max(1, len(y))
    reg = np.full(f + k + 1, penalty)
    reg[-1] = 1e-3
    norms = x.times(np.ones(f)) + (said**2).sum(axis=1) + 1
    rate = 1 / (0.25 * float(norms.max(initial=1.0)) + penalty / n)
    w = np.zeros(f + k + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    v = w.copy()
    for step in range(1, steps + 1):
        r = probability(x, said, v) - y
        new = v - rate * (np.concatenate((x.back(r), said.T @ r, [r.sum()])) + reg * v) / n
        v, w = new + (step - 1) / (step + 2) * (new - w), new
    return w


def probability(x: Hits, said, w):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x.times(w[: x.cols]) + said @ w[x.cols : -1] + w[-1], -30, 30)))


class Chain:
    """names, feature index (hash -> column) and one weight vector per category; share where nothing is learned."""

    def __init__(self, names: tuple[str, ...], index: dict[int, int], weights: list, share: float):
        self.names, self.index, self.weights, self.share = names, index, weights, share

    def predict(self, x: Hits):
        """Probabilities (rows x categories): each category's feed the later ones."""
        import numpy as np

        out = np.zeros((x.rows, len(self.names)))
        for k, w in enumerate(self.weights):
            out[:, k] = probability(x, out[:, :k], w)
        if not self.weights:
            out[:] = self.share
        return out


def fit_chain(x: Hits, labels, names: tuple[str, ...], index: dict[int, int], fold, chosen: dict | None = None):
    """(chain, out-of-fold predictions of every category). labels: 0/1 (rows x categories) in the chain's order,
    or a function of the marked columns that gives them. chosen: fold -> marks of the columns that the models
    without the fold may use (-1: the final models)."""
    import numpy as np

    marks = labels if callable(labels) else lambda cols: labels
    chosen = chosen or {f: np.ones(x.cols, bool) for f in (-1, *np.unique(fold).tolist())}
    said, weights = np.zeros((x.rows, 0)), []
    for k in range(len(names)):
        weights.append(logistic(x.only(cols=chosen[-1]), said, marks(chosen[-1])[:, k]))
        out = np.zeros(x.rows)
        for f in np.unique(fold).tolist():
            own, cols = fold == f, chosen[f]
            w = logistic(x.only(~own, cols), said[~own], marks(cols)[~own, k])
            out[own] = probability(x.only(own, cols), said[own], w)
        said = np.hstack([said, out[:, None]])
    return Chain(names, index, weights, float(marks(chosen[-1])[:, -1].mean()) if x.rows else 0.5), said


def telling(features: DataFrame, totals: dict[int, tuple[int, int]], most: int = KEPT, score: float = 5.5) -> DataFrame:
    """feature, fold: features that stand 4 times at least and go with the label, or its absence, beyond chance
    (standard score), the ``most`` strongest without each fold's documents, and with all (fold -1).

    features: fold, y, features; totals: fold -> (documents, marked ones).
    """
    each = features.select("fold", "y", F.explode("features").alias("feature"))
    inside = lambda f: F.col("fold") == f
    sums = [c for f in totals for c in (F.sum(inside(f).cast("long")).alias(f"n{f}"), F.sum(F.when(inside(f), F.col("y")).otherwise(0)).alias(f"k{f}"))]
    counted = common.staged(each.groupBy("feature").agg(*sums).where(" + ".join(f"n{f}" for f in totals) + " >= 4"))
    found = None
    for out in (-1, *totals):
        rest = [f for f in totals if f != out]
        n, k = (sum((F.col(f"{c}{f}") for f in rest), F.lit(0)) for c in "nk")
        share = max(sum(totals[f][1] for f in rest) / max(1, sum(totals[f][0] for f in rest)), 1e-6)
        z = (k - n * share) / F.sqrt(n * (share * (1 - share) + 1e-12))
        own = counted.where(n >= 4).select("feature", F.lit(out).alias("fold"), F.abs(z).alias("z")).where(F.col("z") >= score).orderBy(F.desc("z"), "feature").limit(most).drop("z")
        found = own if found is None else found.union(own)
    return found


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, label: str = "toxic", folds: int = FOLDS) -> Chain:
    """The chain from about ``most`` labelled documents; copies of a text count once."""
    import numpy as np

    rows = sample_features(common.labelled_sample(docs, labels, label, most))
    once = rows.groupBy("features").agg(F.min(F.struct("doc_id", "y", "n_words")).alias("m")).select("m.*", "features")
    once = once.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(folds)).cast("int")).withColumn("row", F.monotonically_increasing_id())
    once = common.staged(once)  # fixes the rows' numbers
    table = once.select("doc_id", "row", "y", "n_words", "fold").orderBy("doc_id", "row").toPandas()  # at most ``most`` rows
    y, fold = table["y"].to_numpy(float), table["fold"].to_numpy(int)
    share = (float(y.sum()) + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Chain(CATEGORIES, {}, [], share)
    totals = {int(f): (int((fold == f).sum()), int(y[fold == f].sum())) for f in np.unique(fold)}
    told = telling(once, totals).toPandas()  # at most (folds + 1) * KEPT rows
    ids = np.unique(told["feature"].to_numpy(np.int64))
    if not (told["fold"] == -1).any():
        return Chain(CATEGORIES, {}, [], share)
    spark = docs.sparkSession
    columns = F.broadcast(spark.createDataFrame(list(enumerate(ids.tolist())), "col int, feature long"))
    ones = once.select("row", F.explode("features").alias("feature")).join(columns, "feature").select("row", "col").orderBy("row", "col").toPandas()
    order = np.argsort(table["row"].to_numpy())
    at = order[np.searchsorted(table["row"].to_numpy()[order], ones["row"].to_numpy())]
    x = Hits(at, ones["col"].to_numpy(np.int64), len(y), len(ids))
    chosen = {f: np.isin(ids, told["feature"][told["fold"] == f]) for f in (-1, *totals)}
    n_words = np.maximum(table["n_words"].to_numpy(float), 1)

    def marks(cols):
        hits = x.times(cols.astype(float))
        return np.array([y * (hits >= 2), y * (hits >= 0.01 * n_words), y]).T

    final = chosen[-1]
    chain, _ = fit_chain(x, marks, CATEGORIES, {f: k for k, f in enumerate(ids[final].tolist())}, fold, chosen)
    chain.weights = [np.concatenate((w[: x.cols][final], w[x.cols :])) for w in chain.weights]
    return chain


def apply(rows: DataFrame, model: Chain) -> DataFrame:
    """The rows with p_<category> of every category; they need a column text, other columns pass through."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    common.bound_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most KEPT features
    at = rows.columns.index("text")
    names = [f"p_{c}" for c in model.names]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        chain = shared.value
        index, known = chain.index, {}
        for b in batches:
            row, col = [], []
            for k, t in enumerate(b.column(at).to_pylist()):
                own: set[int] = set()
                for w in set(LETTERS.findall((t or "").lower())):
                    cols = known.get(w)
                    if cols is None:
                        if len(known) > WORDS_KEPT:
                            known.clear()
                        cols = known[w] = tuple(index[f] for f in word_features(w) if f in index)
                    own.update(cols)
                row += [k] * len(own)
                col += sorted(own)
            p = chain.predict(Hits(np.array(row, np.int64), np.array(col, np.int64), b.num_rows, len(index)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=[*b.schema.names, *names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def judged(docs: DataFrame, model: Chain, limit: float = 0.5) -> DataFrame:
    """doc_id, p_<category> ..., toxic: whether the last category's probability reaches the limit."""
    return apply(common.whole_texts(docs), model).drop("text").withColumn("toxic", F.col(f"p_{model.names[-1]}") >= limit)
