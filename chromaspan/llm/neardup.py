"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidate links, exact check.

Texts with equal shingle sets become one node first, so copies never make pairs. Each node's signature (one
permutation, optimal densification) is cut into bands; nodes that share a band share a bucket. A bucket with
m nodes gives m candidate links, from one node to the others (a star), not m squared: first in a few bands from
its smallest node, then in all bands to the nodes that are not yet in the bucket's main component.
Candidates whose signatures agree far too little are left out (five standard deviations below the
threshold); the rest are confirmed on full sets.

A star may miss a link between two nodes that both fail against the centre. So buckets whose nodes are not one
component yet get a last pass: every node outside a bucket's main component is held against the nodes of
other components in its bucket, under the same conditions inside the join; small sets, whose signatures tell
little, are compared in full there. Where more than LARGE nodes of a bucket are outside, that would grow as their
square; such nodes are instead held against those with which they share one of their rarest shingles: two sets
that reach the threshold do, if each looks at its (1 - threshold) * size + 1 rarest ones. With that, no link
between nodes that share a bucket is lost. Bands are as many as it takes to miss a pair at the threshold with a
probability under one in a million; optimal densification keeps bins independent for short texts too.

Defined cases: null and empty texts, and texts of white space, have no shingles and stay alone. Repeated rows
are copies. Rows without a doc_id stay alone, with a null component, and are kept. Rows that share a doc_id
are one document: their groups are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, components

BINS = 256
#: Bands whose stars come first.
FIRST_BANDS = 6
#: Sets of at most so many shingles go along into the last pass, where their sketches tell the least.
SMALL_SET = 512
#: Nodes outside a bucket's main component up to which they are held against the bucket directly.
LARGE = 100
#: Parts into which copies of one text are split where they get their component, and nodes in a part of a bucket.
SALTS, PART_NODES = 32, 2000
#: Bytes of text worked at once: numpy holds some 30 bytes for each.
CHUNK = 1 << 20


def banding(threshold: float, bins: int = BINS, miss: float = 1e-6) -> tuple[int, int]:
    """(rows, bands): the longest bands that still meet at the threshold but for ``miss``."""
    return next((r, bins // r) for r in range(16, 0, -1) if (1 - threshold**r) ** (bins // r) <= miss)


def signatures(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, key_a, key_b (of the whole set), sketch array<long> (4 bits a bin), bands array<long>."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import shingles as S

        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, raw in S.batches_of(texts, CHUNK):
                n = len(raw)
                doc, s = S.shingles(raw, width)
                size = np.bincount(doc, minlength=n)
                sig = S.one_permutation(doc, s, n, BINS)
                keys = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(S.mix(s * np.uint64(2 * salt + 1) + np.uint64(salt)))))
                    ends = np.concatenate(([0], np.cumsum(size)))
                    keys.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
                four = (sig & 15).astype(np.uint8)
                sketch = np.ascontiguousarray(four[:, 0::2] | four[:, 1::2] << 4).view(np.int64)
                lanes = np.empty((n, bands), np.uint64)
                for k in range(bands):
                    h = np.full(n, k + 1, np.uint64)
                    for c in range(k * rows, k * rows + rows):
                        h = S.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c])
                    lanes[:, k] = h
                as_lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(size, pa.int64()), *map(pa.array, keys), as_lists(sketch), as_lists(lanes)], names=["doc_id", "n_shingles", "key_a", "key_b", "sketch", "bands"])

    return common.whole_texts(docs).mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, sketch array<long>, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles array<long>: the distinct shingles of each row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import shingles as S

        for b in batches:
            for lo, raw in S.batches_of(b.column(1).to_pylist(), CHUNK):
                doc, s = S.shingles(raw, width)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(raw)))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(raw)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s.view(np.int64)))], names=["doc_id", "shingles"])

    return common.whole_texts(docs).mapInArrow(run, "doc_id long, shingles array<long>")


def likely(percent: int) -> Column:
    """Whether two nodes (n, sketch and m, sketch2) can reach the threshold, by size and by signature."""
    t = percent / 100
    low = 0x1111111111111111

    def differ(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(low)))

    apart = F.aggregate(F.zip_with("sketch", "sketch2", differ), F.lit(0), lambda a, x: a + x)
    seen = 1 - apart / F.lit(float(BINS))
    less, more = F.least("n", "m"), F.greatest("n", "m")
    told = F.lit(float(BINS)) * (1 - F.exp(-less / F.lit(float(BINS))))
    return (less * 100 >= more * percent) & (seen >= F.lit(t) - 5 * F.sqrt(F.lit(t * (1 - t)) / told))


def confirmed(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidates (a, b) with 100 * intersection >= percent * union of the full sets."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return candidates.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(band, node): each set's rarest shingles, as many as any set that reaches the threshold with it must meet."""
    each = sets.select(F.col("doc_id").alias("node"), F.size("shingles").alias("n"), F.explode("shingles").alias("band"))
    common_ = each.groupBy("band").agg(F.count("*").alias("times")).where("times > 1")
    ranked = each.join(common_, "band", "left").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("times", F.lit(1)), "band")))
    return ranked.where((F.col("place") <= F.floor(F.col("n") * (100 - percent) / 100) + 1) & F.col("times").isNotNull()).select("band", "node")


def across(mixed: DataFrame, about: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket whose first node is outside the main component and whose second is of another component,
    and which may reach the threshold. The second nodes of a large bucket are dealt to several tasks."""
    small = sets.where(F.size("shingles") <= SMALL_SET).select(F.col("doc_id").alias("node"), "shingles")
    rows = mixed.withColumn("parts", F.ceil(F.col("total") / F.lit(PART_NODES))).join(about, "node").join(small, "node", "left")
    aside = rows.where("component <> main").select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("node").alias("a"), F.col("component").alias("c"), "n", "sketch", F.col("shingles").alias("x"))
    there = rows.select("band", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.col("node").alias("b"), F.col("component").alias("d"), "main", F.col("n").alias("m"), F.col("sketch").alias("sketch2"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    near = F.col("x").isNull() | F.col("y").isNull() | (100 * shared >= percent * (F.col("n") + F.col("m") - shared))
    pairs = aside.join(there, ["band", "part"]).where((F.col("c") != F.col("d")) & ((F.col("d") == F.col("main")) | (F.col("a") < F.col("b"))) & likely(percent) & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    component_id is the smallest doc_id that links reach, where two documents are linked if the Jaccard
    similarity of their shingle sets is at least percent / 100; kept marks the row of that doc_id.
    """
    rows, bands = banding(percent / 100)
    signed = common.staged(signatures(docs, width, rows, bands))
    with_words = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "key_a", "key_b"]
    salt = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(SALTS)).cast("int").alias("salt")
    named = common.staged(with_words.withColumn("salt", salt).groupBy(key).agg(F.min("doc_id").alias("node"), F.expr("bit_or(shiftleft(1L, salt))").alias("salts")))
    nodes = with_words.join(named.select(F.col("node").alias("doc_id"), *key), ["doc_id", *key]).dropDuplicates(["doc_id", *key])
    nodes = common.staged(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch", "bands"))

    banded = nodes.select("node", F.posexplode("bands").alias("lane", "band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("band", "first")
    members = common.staged(banded.join(shared, "band"))
    about = nodes.select("node", "n", "sketch")

    def described(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        return ordered.join(about.select(F.col("node").alias("a"), "n", "sketch"), "a").join(about.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("sketch2")), "b")

    def mixed_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
        """The nodes of buckets that hold more than one component, with the bucket's main one and the number outside it."""
        placed = members.select("band", "node").join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        parts = placed.groupBy("band", "component").agg(F.count("*").alias("k"), F.min("node").alias("first"))
        main = parts.groupBy("band").agg(F.max_by(F.struct("component", "first"), F.struct("k", "component")).alias("main"), (F.sum("k") - F.max("k")).alias("outside"), F.sum("k").alias("total"), F.count("*").alias("parts")).where("parts > 1")
        return common.staged(placed.join(main.select("band", F.col("main.component").alias("main"), F.col("main.first").alias("centre"), "outside", "total"), "band"))

    needed = members.select(F.col("node").alias("doc_id")).distinct()
    sets = common.staged(shingle_sets(common.whole_texts(docs).join(needed, "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]))

    # stars over a few bands; they join most of a group, so what follows only looks at what they left apart
    stars = members.where(F.col("lane") < FIRST_BANDS).select(F.col("first").alias("a"), F.col("node").alias("b"))
    tried = common.staged(described(stars).where(likely(percent)).select("a", "b"))
    found = components.components(confirmed(tried, sets, percent))
    # stars over all bands, from the nodes outside a bucket's main component to its centre
    mixed = mixed_buckets(members, found)
    stars = described(mixed.where("component <> main").select(F.col("centre").alias("a"), F.col("node").alias("b"))).where(likely(percent)).select("a", "b")
    again = common.staged(stars.join(tried, ["a", "b"], "left_anti"))
    tried = tried.union(again)
    found = components.extended(found, common.staged(confirmed(again, sets, percent)))
    # what is still apart, against the other components of its bucket
    mixed = mixed_buckets(members, found)
    crowd = mixed.where(F.col("outside") > LARGE).select("node").distinct()
    rarest = mixed_buckets(rare_shingles(sets.join(crowd, F.col("doc_id") == F.col("node"), "left_semi"), percent), found)
    mixed = mixed.where(F.col("outside") <= LARGE).union(rarest)
    second = across(mixed, about, sets, percent).join(tried, ["a", "b"], "left_anti")
    more = common.staged(confirmed(second, sets, percent))
    if not more.isEmpty():
        found = components.extended(found, more)

    classes = named.join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("component"), "salts")
    has = lambda k: F.shiftrightunsigned("salts", k).bitwiseAND(F.lit(1)) == 1
    classes = classes.select(*key, "component", F.explode(F.array_compact(F.array(*(F.when(has(k), F.lit(k)) for k in range(SALTS))))).alias("salt"))
    out = signed.select("doc_id", *key, salt).join(classes, [*key, "salt"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
