"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest of its inner s-mers (by hash) lies at its first or last
place. That depends on the k-mer alone, so a shared passage gives the same anchors wherever it stands. The
fingerprint holds all anchor hashes with their first positions: ``hash:position`` in hex, by hash; it grows with
the text. The likeness of two fingerprints is taken over the hashes of both together: the share that both have,
in the same order of positions (longest increasing run).

A text with fewer than K code points has one anchor, the whole text; an empty text has none. Two empty
fingerprints are alike (1), an empty and another are not (0).

with_next() sets each document beside the next one by (doc_id, text): documents are dealt into ranges of
doc_id by quantiles, and each range also gets the first document of the range after it (the last: of the
first), so every pair meets in one task while texts are shuffled once. Null ids come first, repeated rows are
documents of their own; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, S = 24, 8
FIRST = -(1 << 63)
RANGE_BYTES = 32 << 20


def anchors(texts: list[str]) -> list[list[tuple[int, int]]]:
    """For each text all anchors: (hash, first position), by hash."""
    import numpy as np

    from .shingles import _power, mix

    out: list[list[tuple[int, int]]] = []
    base = 0xC2B2AE3D27D4EB4F
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(points)
    up, down = _power(base, n + 1), _power(pow(base, -1, 1 << 64), n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(points + np.uint64(1)) * up[:n])))

    def grams(width: int) -> np.ndarray:
        return mix((total[width:] - total[:-width]) * down[: n + 1 - width] + np.uint64(width))

    begins = np.concatenate(([0], np.cumsum(sizes)))
    doc = at = h = np.zeros(0, np.int64)
    if n >= K:
        small, window = grams(S), K - S + 1
        low, width = small, 1
        while 2 * width <= window:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if width < window:
            low = np.minimum(low[: len(small) - window + 1], low[window - width :])
        closed = np.flatnonzero((small[: len(low)] == low) | (small[window - 1 :] == low))
        own = np.searchsorted(begins, closed, "right") - 1
        inside = closed + K <= begins[own + 1]
        at, doc = closed[inside], own[inside]
        h = (grams(K)[at] >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((at, h, doc))
    doc, h, at = doc[order], h[order], at[order] - begins[doc[order]]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h, at = doc[new], h[new], at[new]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        if 0 < sizes[k] < K:
            whole = mix((total[begins[k + 1] : begins[k + 1] + 1] - total[begins[k] : begins[k] + 1]) * down[begins[k] : begins[k] + 1] + np.uint64(sizes[k]))
            out.append([(int(whole[0] >> np.uint64(32)), 0)])
        else:
            lo, hi = ends[k], ends[k + 1]
            found = list(zip(h[lo:hi].tolist(), at[lo:hi].tolist(), strict=True))
            if not found and sizes[k]:  # no closed k-mer at all: the text's own hash
                found = [(int.from_bytes(hashlib.sha256(texts[k].encode()).digest()[:4], "big"), 0)]
            out.append(found)
    return out


def spell(found: list[tuple[int, int]]) -> str:
    return " ".join([f"{h:08x}:{p:x}" for h, p in found])


def read(fingerprint: str) -> list[tuple[int, int]]:
    return [(int(h, 16), int(p, 16)) for h, p in (x.split(":") for x in fingerprint.split())]


def likeness(one: list[tuple[int, int]], two: list[tuple[int, int]]) -> float:
    from bisect import bisect_left

    if one == two:
        return 1.0
    a, b = dict(one), dict(two)
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    runs: list[int] = []
    for _, place in sorted((a[h], b[h]) for h in both):
        k = bisect_left(runs, place)
        runs[k : k + 1] = [place]
    return len(runs) / len(a.keys() | b.keys())


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by as many first code points of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def ranges(docs: DataFrame, parts: int) -> DataFrame:
    """(part, last, doc_id, k, text): the documents by range, and in each range (last = 1) the next range's first.

    Each range is a partition of its own.
    """
    from pyspark.ml.feature import Bucketizer

    rows = common.whole_texts(docs).withColumn("k", F.coalesce("doc_id", F.lit(FIRST)))
    cuts = sorted(set(rows.select("k").approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    part = F.lit(0)
    if cuts:
        # doubles may merge neighbouring ids, but keep their order, which is all that ranges need
        rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="range").transform(rows.withColumn("at", F.col("k").cast("double")))
        part = F.col("range").cast("int")
    rows = rows.select("doc_id", "k", "text", part.alias("part"))
    firsts = sorted((r["part"], r["k"]) for r in rows.groupBy("part").agg(F.min("k").alias("k")).collect())  # a row for each range
    if not firsts:
        return rows.select("part", F.lit(0).alias("last"), "doc_id", "k", "text")
    to = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    ghost = F.broadcast(docs.sparkSession.createDataFrame(to, "k long, to int"))  # a row for each range
    both = rows.join(ghost, "k", "left").withColumn("copy", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("part", F.lit(0).alias("last")))).otherwise(F.array(F.struct("part", F.lit(0).alias("last")), F.struct(F.col("to").alias("part"), F.lit(1).alias("last"))))))
    return both.select("copy.part", "copy.last", "doc_id", "k", "text").repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "last", "k", "text")


def number_of_ranges(docs: DataFrame) -> int:
    """As many as shuffle partitions, and so many more that a range holds about RANGE_BYTES of text."""
    size = common.whole_texts(docs).agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and both likenesses (see OUT)."""
    parts = parts or number_of_ranges(docs)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def rows_of(held: list[tuple]) -> pa.RecordBatch | None:
            """held: consecutive (part, last, doc_id, text); each but the last is set beside the one after it."""
            pairs = [(x, y) for x, y in zip(held, held[1:], strict=False) if x[0] == y[0] and not x[1]]
            if not pairs:
                return None
            changed = [edited(x[3], y[3]) for x, y in pairs]
            prints = anchors([h[3] for h in held])
            own = dict(zip(map(id, held), prints, strict=True))
            rows = []
            for (x, y), new, e in zip(pairs, changed, anchors(changed), strict=True):
                f = own[id(x)]
                rows.append((x[2], len(x[3]), hashlib.sha256(new.encode()).hexdigest(), spell(f), spell(e), likeness(f, e), likeness(f, own[id(y)])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        held, size, ghosts = [], 0, None
        for b in batches:
            for row in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("part", "last", "doc_id", "text")), strict=True):
                if row[1]:
                    if ghosts == row[0]:
                        continue  # one document of the next range is enough
                    ghosts = row[0]
                held.append(row)
                size += len(row[3])
                if size > common.CHUNK_BYTES // 2 and len(held) > 1:
                    if (out := rows_of(held)) is not None:
                        yield out
                    held = held[-1:]
                    size = len(held[0][3])
        if (out := rows_of(held)) is not None:
            yield out

    return ranges(docs, parts).mapInArrow(run, OUT)
