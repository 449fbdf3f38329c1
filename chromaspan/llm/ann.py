"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Vectors get one more component so that all have the largest norm; then the nearest by distance are those of
the largest inner product. The tree is fitted on a part of a bounded sample (SAMPLE rows, picked by a hash of
vec_id); every row is indexed. A query walks the tree with a priority queue, best node first: a node's priority is
its centre's product with the query's direction and a multiple of the node's spread. It stops when the queue's best
falls more than a margin below the query's own NTH best product in the sample, so each query widens its visits as
far as its neighbourhood asks. Margin and multiple are calibrated on the other part of the sample, which the tree
has not seen: the margin is widened until TARGET of the queries' neighbours there are reached, of the multiples the
one that visits the fewest rows is taken.

The leaves' rows form blocks of bounded size (small leaves share one, large ones are split), and so do the queries
that visit a block; each pair of blocks is one group, multiplied leaf by leaf, of which at most ``most`` hits a
query go on. Of equal vectors only the ``most + 1`` smallest ids can be among a query's nearest, so more are not
indexed: copies, however many, cost nothing and lose nothing.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
those of another length than most have; rows without a vec_id neither. Repeated rows count once; of different
vectors under one vec_id the smallest, compared by component, counts. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, BRANCHES, LEAF_ROWS, LEAST_LEAF, TARGET = 20_000, 8, 128, 8, 0.93
#: Least and most rows of a block (a 32nd of all rows between them), queries of a block, and queries multiplied at once.
BLOCKS, QUERIES, AT_ONCE = (512, 8192), 8192, 256
#: Sample rows whose product with a query is its yardstick, and queries of the calibration.
NTH, HELD = 5, 500


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part, one for each vec_id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    inf = F.lit(float("inf"))
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("v") == (sizes[0]["d"] if sizes else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


class Tree:
    """Nodes in arrays: centre, spread (root mean square distance to it), children (none: a leaf), number of the leaf."""

    def __init__(self, rows, leaf_size: int, branches: int = BRANCHES, seed: int = 11):
        import numpy as np

        self.centres, self.spread, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(rows, leaf_size, branches, rng)
        self.centres, self.spread = np.array(self.centres), np.array(self.spread)

    def _grow(self, rows, leaf_size: int, branches: int, rng) -> int:
        """Adds the node of the rows and all below it, depth first, so that leaves of a branch have numbers in a row."""
        import numpy as np

        node, centre = len(self.centres), rows.mean(axis=0)
        self.centres.append(centre)
        self.spread.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).mean())))
        self.children.append([])
        self.leaf.append(-1)
        label = self._split(rows, branches, rng) if len(rows) > max(leaf_size, branches) else None
        if label is None:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._grow(rows[label == k], leaf_size, branches, rng) for k in np.unique(label)]
        return node

    @staticmethod
    def _split(rows, branches: int, rng):
        import numpy as np

        nearest_ = lambda c: (rows @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)
        centres = rows[rng.choice(len(rows), branches, replace=False)]
        for _ in range(12):
            label = nearest_(centres)
            centres = np.array([rows[label == k].mean(axis=0) for k in np.unique(label)])
        label = nearest_(centres)
        return label if len(np.unique(label)) > 1 else None

    def place(self, rows):
        """The leaf of each row, by the nearest centre at each level."""
        import numpy as np

        out = np.full(len(rows), -1, np.int64)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, own = stack.pop()
            if not len(own):
                continue
            kids = self.children[node]
            if not kids:
                out[own] = self.leaf[node]
                continue
            c = self.centres[kids]
            label = (rows[own] @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)
            stack += [(kid, own[label == k]) for k, kid in enumerate(kids)]
        return out

    def walk(self, priority, stop: float = -float("inf"), enough: int = 0, rows=None) -> tuple[list[int], list[float]]:
        """Leaves best bin first, with the least priority met since the first of them, for one query's priorities by node.

        It ends when the best in the queue is under ``stop``, but not before the leaves hold ``enough`` of ``rows``.
        """
        queue, leaves, least, low, held = [(-priority[0], 0)], [], [], float("inf"), 0
        while queue:
            p, node = heapq.heappop(queue)
            if leaves:  # the first leaf is always visited
                if -p < stop and held >= enough:
                    break
                low = min(low, -p)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-priority[kid], kid))
            else:
                leaves.append(self.leaf[node])
                least.append(low)
                held += int(rows[self.leaf[node]]) if rows is not None else 0
        return leaves, least


class Search:
    """What a query needs to know where to go: the tree, the sample for its yardstick, the multiple and the margin."""

    def __init__(self, tree: Tree, sample, norm: float, multiple: float = 0.0, margin: float = float("inf")):
        self.tree, self.sample, self.norm, self.multiple, self.margin = tree, sample, norm, multiple, margin

    def priorities(self, queries):
        return aim(queries, self.norm) @ self.tree.centres.T + self.multiple * self.tree.spread

    def yardstick(self, queries):
        """Each query's NTH best product in the sample, on the scale of the priorities."""
        import numpy as np

        if len(self.sample) < NTH:
            return np.full(len(queries), -np.inf)
        return np.partition((queries / np.linalg.norm(queries, axis=1)[:, None]) @ self.sample.T, -NTH, axis=1)[:, -NTH]

    def leaves(self, queries, most: int, rows) -> list[list[int]]:
        """For each query the leaves to visit. rows: the number of all rows of each leaf."""
        out = []
        for lo in range(0, len(queries), AT_ONCE):
            some = queries[lo : lo + AT_ONCE]
            stop = self.yardstick(some) - self.margin
            out += [self.tree.walk(p, s, most + 1, rows)[0] for p, s in zip(self.priorities(some).tolist(), stop.tolist(), strict=True)]
        return out


def fit(sample, there: int, norm: float, most: int, target: float = TARGET) -> Search:
    """The tree over three quarters of the sample, calibrated on the rest. norm: the largest norm of all rows."""
    import numpy as np

    apart = np.arange(len(sample)) % 4 == 3
    seen, unseen = sample[~apart], sample[apart]
    search = Search(Tree(lift(seen, norm), max(LEAST_LEAF, round(LEAF_ROWS * len(seen) / max(there, 1)))), seen, norm)
    tree = search.tree
    if tree.leaves < 2 or len(unseen) < 2 * most:
        return search  # visits every leaf
    held = np.arange(len(unseen))[:: -(-len(unseen) // HELD)]
    score = unseen[held] @ unseen.T
    score[np.arange(len(held)), held] = -np.inf
    # as near as the ``most`` nearest of all rows are: that many times fewer of the rows apart
    true = np.argsort(-score, axis=1)[:, : max(1, round(most * len(unseen) / max(there, 1)))]
    leaf, sizes = tree.place(lift(unseen, norm)), np.bincount(tree.place(lift(seen, norm)), minlength=tree.leaves)
    yard, least_rows = search.yardstick(unseen[held]), None
    for z in (0.5, 1.5, 3.0):
        search.multiple = z / sample.shape[1] ** 0.5
        needed, at, gone = [], np.zeros(tree.leaves), []
        for k, p in enumerate(search.priorities(unseen[held]).tolist()):
            own, least = tree.walk(p)
            at[own] = yard[k] - np.array(least)
            needed.append(at[leaf[true[k]]])
            gone.append(at.copy())
        margin = float(np.quantile(np.concatenate(needed), target))
        visited = float(((np.array(gone) <= margin) * sizes).sum())
        if least_rows is None or visited < least_rows[0]:
            least_rows = visited, search.multiple, margin
    _, search.multiple, search.margin = least_rows
    return search


def lift(rows, norm: float):
    """One more component, so that all rows have the largest norm."""
    import numpy as np

    return np.hstack([rows, np.sqrt(np.maximum(norm**2 - (rows**2).sum(axis=1), 0))[:, None]])


def aim(queries, norm: float):
    """Directions of the queries, beside lifted rows."""
    import numpy as np

    return np.hstack([queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros((len(queries), 1))])


def _matrix(column):
    import numpy as np

    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def block_map(rows: dict[int, int], leaves: int, block: int):
    """(rows of each leaf, first block of each leaf, number of its blocks): leaves in a row share a block, large ones have several."""
    import numpy as np

    count = np.zeros(leaves, np.int64)
    first, number = np.zeros(leaves, np.int64), np.ones(leaves, np.int64)
    at = filled = 0
    for k in range(leaves):
        count[k] = n = rows.get(k, 0)
        if filled and filled + n > block:
            at, filled = at + 1, 0
        first[k], number[k] = at, max(1, -(-n // block))
        filled += n
        if number[k] > 1:
            at, filled = at + int(number[k]), 0
    return count, first, number


def best_of(ids, rows, leaf, asks, ways, visits, most: int) -> tuple[list[int], list[list[dict]]]:
    """The ``most`` nearest rows of each query among the leaves it visits. ids, rows, leaf ascend by (leaf, id)."""
    import numpy as np

    at = np.unique(leaf)
    begin, end = np.searchsorted(leaf, at), np.searchsorted(leaf, at, "right")
    queries, hits = [], []
    for lo in range(0, len(asks), AT_ONCE):
        some = ways[lo : lo + AT_ONCE]
        score = np.full((len(some), len(ids)), -np.inf)
        pairs = np.array([(k, x) for k, own in enumerate(visits[lo : lo + AT_ONCE]) for x in own], np.int64).reshape(-1, 2)
        for x, b, e in zip(at, begin, end, strict=True):
            own = pairs[pairs[:, 1] == x, 0]
            if len(own):
                score[own, b:e] = some[own] @ rows[b:e].T
        score[ids[None, :] == asks[lo : lo + AT_ONCE, None]] = -np.inf
        edge = np.partition(score, -most, axis=1)[:, -most] if len(ids) > most else np.full(len(some), -np.inf)
        for k in range(len(some)):
            own = np.flatnonzero((score[k] >= edge[k] - 1e-9 * max(1.0, abs(edge[k]))) & (score[k] > -np.inf)) if edge[k] > -np.inf else np.flatnonzero(score[k] > -np.inf)
            if len(own):
                exact = (rows[own] * some[k]).sum(axis=1)  # the same order of additions for every row
                order = np.lexsort((ids[own], -exact))[:most]
                queries.append(int(asks[lo + k]))
                hits.append([{"far": -float(exact[x]), "vec_id": int(ids[own[x]])} for x in order])
    return queries, hits


def nearest(vectors: DataFrame, is_query: Column, most: int = 20, sample_rows: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``most`` nearest found of every row for which is_query holds."""
    spark = vectors.sparkSession
    common.bound_batches(spark)
    rows = common.staged(usable(vectors))
    facts = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    import numpy as np

    there, norm = facts["n"], facts["norm"]
    picked = rows.where(common.hash_share("vec_id", sample_rows, there)).orderBy("vec_id").select("v").toArrow().column(0).combine_chunks()
    sample = _matrix(picked)
    if not len(sample):
        sample = np.array([rows.first()["v"]])
    search = spark.sparkContext.broadcast(fit(sample, there, norm, most, target))  # bounded by the sample

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            leaf = search.value.tree.place(lift(_matrix(b.column(1)), norm)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    kept = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(1))).withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= most + 1)
    indexed = common.staged(kept.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, leaf int"))
    sizes = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    blocks = spark.sparkContext.broadcast(block_map(sizes, search.value.tree.leaves, min(max(BLOCKS[0], there // 32), BLOCKS[1])))

    def visit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count, first, number = blocks.value
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for k, own in enumerate(search.value.leaves(_matrix(b.column(1)), most, count) if b.num_rows else []):
                by_block: dict[int, list[int]] = {}
                for leaf in own:
                    for x in range(first[leaf], first[leaf] + number[leaf]) if count[leaf] else ():
                        by_block.setdefault(x, []).append(leaf)
                for x, leaves in by_block.items():
                    for column, value in zip(out, (k, x, leaves), strict=True):
                        column.append(value)
            take = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], names=["query_id", "v", "block", "leaves"])

    asked = common.staged(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").mapInArrow(visit, "query_id long, v array<double>, block long, leaves array<int>"))
    spread = spark.createDataFrame([(k, int(a), int(n)) for k, (a, n) in enumerate(zip(*blocks.value[1:], strict=True))], "leaf int, first long, number long")
    part = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), F.col(n))
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(QUERIES)).alias("parts"))  # a row for each block
    left = indexed.join(F.broadcast(spread), "leaf").withColumn("block", F.col("first") + part("vec_id", "number")).join(parts, "block")
    left = left.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), "vec_id", "v", "leaf")
    right = asked.join(parts, "block").select("block", part("query_id", "parts").alias("j"), "query_id", "v", "leaves")

    def best(key, one, two):
        import pyarrow as pa

        kind = pa.schema([("query_id", pa.int64()), ("hits", pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())])))])
        if not (one.num_rows and two.num_rows):
            return kind.empty_table()
        one = one.sort_by([("leaf", "ascending"), ("vec_id", "ascending")])
        found = best_of(one.column("vec_id").to_numpy(), _matrix(one.column("v").combine_chunks()), one.column("leaf").to_numpy(), two.column("query_id").to_numpy(), _matrix(two.column("v").combine_chunks()), two.column("leaves").to_pylist(), most)
        return pa.Table.from_pydict({"query_id": found[0], "hits": found[1]}, schema=kind)

    found = left.groupBy("block", "j").cogroup(right.groupBy("block", "j")).applyInArrow(best, "query_id long, hits array<struct<far: double, vec_id: long>>")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, most).alias("hits"))
    return top.select("query_id", F.posexplode("hits").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.far")).alias("score"))
