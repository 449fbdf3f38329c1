"""Importance resampling of documents towards a target corpus, by hashed n-grams.

A text is lower-cased (A-Z) and normalised: its words are runs of digits, a-z and everything beyond ASCII, each behind
one separator (a space). The normalised text is scanned once, with the running CRC-32 stored after each word. The CRC of
any run of words follows from two stored ones: a prefix's CRC is the CRC of its beginning, shifted by the bytes that
follow (a linear map over GF(2)), plus (exclusive or) the CRC of these bytes; so the beginning cancels out.

Features are all runs of 1 to ``longest`` words; a feature's bucket is its CRC modulo ``buckets``. Bucket counts of the
corpus and of the target give each bucket a gain (floored thousandths of the log ratio, both smoothed by one). A
document's weight is the floored mean of its features' gains, its score the weight plus Gumbel noise from a hash of seed
and doc_id, and the ``percent`` highest scores of the documents with at least ``least_words`` words are drawn, which is
sampling without replacement by weight.

Counts are summed per task before they are shuffled (at most ``buckets`` rows a task); ranks come from a global sort
in ranges, so neither equal scores nor equal ids gather in one task.

Defined cases: a null text has no words, like the empty one; a null doc_id hashes as an empty string and comes last
among equal scores; repeated rows are rows of their own and get ranks one after the other; an empty table gives an empty
one, an empty target gives gains by the corpus alone; other columns are left out; a very long text is split in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEPARATOR = b" "
#: Bytes of a text that are split into words at once.
BLOCK = 1 << 22
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or chr(b).islower() else 32 for b in range(256))
#: The CRC's polynomial, lowest power first (fixed value of the standard).
POLYNOMIAL = 0xEDB88320


class Shift:
    """The effect of n following bytes on a CRC: tables of four bytes for n = 1, 2, 4, ..."""

    def __init__(self):
        import numpy as np

        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), step >> np.uint32(1))
        self.tables = [np.stack([step] + [np.arange(256, dtype=np.uint32) << np.uint32(8 * (j - 1)) for j in range(1, 4)])]

    def table(self, k: int):
        while len(self.tables) <= k:
            last = self.tables[-1]
            self.tables.append(self._apply(last, self._apply(last, self._units())))
        return self.tables[k]

    @staticmethod
    def _units():
        import numpy as np

        return np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])

    @staticmethod
    def _apply(table, crc):
        import numpy as np

        low = np.uint32(255)
        return table[0][crc & low] ^ table[1][(crc >> np.uint32(8)) & low] ^ table[2][(crc >> np.uint32(16)) & low] ^ table[3][crc >> np.uint32(24)]

    def __call__(self, crc, n):
        """crc (uint32 array), each shifted by its n bytes."""
        import numpy as np

        out = crc.copy()
        for k in range(int(n.max()).bit_length() if len(n) else 0):
            bit = np.flatnonzero((n >> k) & 1)
            out[bit] = self._apply(self.table(k), out[bit])
        return out


_shift: list[Shift] = []


def shift() -> Shift:
    if not _shift:
        _shift.append(Shift())
    return _shift[0]


def scanned(text: str, begin: int = 0):
    """Running CRCs (uint32: ``begin``, then after each word) of the normalised text, and each word's bytes (int64)."""
    import numpy as np

    raw, crcs, sizes, lo = text.encode().translate(_NORMAL), [np.array([begin], np.uint32)], [], 0
    while lo < len(raw):
        hi = min(len(raw), lo + BLOCK)
        if hi < len(raw):
            gap = raw.find(SEPARATOR, hi)
            hi = len(raw) if gap < 0 else gap
        words = raw[lo:hi].split()
        if words:
            run = accumulate(words, lambda c, w: crc32(w, crc32(SEPARATOR, c)), initial=int(crcs[-1][-1]))
            crcs.append(np.fromiter(run, np.uint32, len(words) + 1)[1:])
            sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
        lo = hi
    return np.concatenate(crcs), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def gram_crcs(crcs, sizes, n: int):
    """CRC of each run of n words, from the running ones."""
    import numpy as np

    count = max(0, len(sizes) - n + 1)
    ends = np.concatenate(([0], np.cumsum(sizes + len(SEPARATOR))))
    before = shift()(crcs[:count], np.full(count, len(SEPARATOR))) ^ np.uint32(crc32(SEPARATOR))
    return crcs[n:][:count] ^ shift()(before, (ends[n:][:count] - ends[:count]) - len(SEPARATOR))


def _buckets(texts: list[str], longest: int, buckets: int) -> Iterator[tuple]:
    """By chunks of texts: for each feature its text and its bucket, for each text its words."""
    import numpy as np

    for lo, hi in common.text_chunks([len(t) for t in texts]):
        parts, sizes = zip(*(scanned(t) for t in texts[lo:hi]), strict=True)
        words = np.array([len(s) for s in sizes])
        own, bucket = [], []
        # one array of all texts: a text's running CRCs begin with the empty prefix, so runs across texts are left out
        size = np.concatenate([x for s in sizes for x in (s, [0])])
        crcs = np.concatenate([*parts, parts[-1][-1:]])
        owner = np.repeat(np.arange(hi - lo), words + 1)
        for n in range(1, longest + 1):
            crc = gram_crcs(crcs, size, n)
            inside = (np.arange(len(crc)) + n <= np.cumsum(words + 1)[owner[: len(crc)]] - 1)
            own.append(owner[: len(crc)][inside])
            bucket.append(crc[inside] % np.uint32(buckets))
        yield lo, np.concatenate(own), np.concatenate(bucket).astype(np.int64), words


def counts(docs: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features fall into each bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, bucket, _ in _buckets(b.column(b.schema.names.index("text")).to_pylist(), longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    return common.whole_texts(docs).select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """Floored thousandths of each bucket's log ratio, target to corpus; both are tables of bucket counts."""
    s, t = ({r["bucket"]: r["n"] for r in c.collect()} for c in (corpus, target))  # at most one row a bucket
    everywhere, wanted = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * everywhere / ((s.get(b, 0) + 1.0) * wanted))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    import numpy as np

    shared = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))  # one number a bucket

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gain = shared.value
        for b in batches:
            ids = b.column(b.schema.names.index("doc_id"))
            for lo, own, bucket, words in _buckets(b.column(b.schema.names.index("text")).to_pylist(), longest, len(gain)):
                n = np.bincount(own, minlength=len(words))
                total = np.bincount(own, gain[bucket], len(words)).astype(np.int64)  # exact: far below 2 ** 53
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(words)), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return common.whole_texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null where the row is not drawn."""
    named = target.select(F.lit(0).alias("doc_id"), "text")
    gain = gains(counts(docs, longest, buckets), counts(named, longest, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = common.staged(weights(docs, gain, longest).withColumn("score", F.col("weight") + noise))
    fits = F.col("n_words") >= least_words
    scores = rows.where(fits).groupBy("score").count().collect()  # scores are thousandths of a narrow range, so these are few
    wanted = percent * sum(r["count"] for r in scores) // 100
    seen, least = 0, None
    for r in sorted(scores, key=lambda r: -r["score"]):
        if seen >= wanted:
            break
        seen, least = seen + r["count"], r["score"]
    near = fits & (F.col("score") >= F.lit(least).cast("long"))
    own = ["doc_id", "n_features", "weight", "score"]
    placed = common.numbered(rows.where(near).select(*own).withColumn("tie", F.monotonically_increasing_id()), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("tie"))
    rank = F.when(F.col("at") < wanted, F.col("at") + 1)
    return rows.where(~F.coalesce(near, F.lit(False))).select(*own, F.lit(None).cast("long").alias("rank")).union(placed.select(*own, rank.alias("rank")))
