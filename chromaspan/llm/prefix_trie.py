"""The trie of conversation prefixes, with subtree sums from an Euler tour.

A node is a distinct sequence of first turns (role, text) of conversations; its members are the conversations that start
with it. Turn sequences are told apart by two 64-bit hashes: the exclusive or of one hash for each turn and its
position, so a prefix's key and its parent's differ by one turn's hash.

The tour: each node has an enter and an exit arc; the arc after a node's enter arc enters its first child, or exits the
node if it has none; the arc after its exit arc enters its next sibling, or exits the parent. Arcs are ranked by list
ranking, weighted by leaves and savings, so a subtree's sums are differences of the tour's sums at its two arcs.
Ranking works in two steps: nodes lie in blocks of bounded size, in which arcs are first ranked up to where the tour
leaves the block; then the arcs at which the tour enters a block, a much shorter list, are ranked by doubling pointers.

Nothing is gathered by conversation or node: places of turns, siblings and members come from global sorts in ranges,
running hashes from blocks of positions, sums are combined before the shuffle. Only the digest of a node's conversations
is sequential; it is fed pieces of PIECE ids.

Defined cases: turns are ordered with a null turn first, equal ones by a hash of role and text; null role or text is
empty; rows without a conv_id take no part; repeated rows are turns of their own; an empty table has no nodes, not even a
root; other columns, whatever their names, are left out; texts of any length count whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Positions of a block of a conversation, nodes of a block of the tour, ids of a piece of a digest.
POSITIONS, NODES, PIECE = 1024, 4096, 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, pos, h1, h2, bytes): each conversation's turns in order, pos from 1; texts as hashes and sizes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = [F.xxhash64(F.lit(seed), F.octet_length(role), role, text).alias(f"h{seed}") for seed in (1, 2)]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *hashed, F.octet_length(text).cast("long").alias("bytes")).where("conv is not null")
    placed = common.numbered(rows.withColumn("tie", F.monotonically_increasing_id()), "conv", F.asc_nulls_first("turn"), "h1", "h2", "tie")
    first = placed.groupBy("conv").agg(F.min("at").alias("first"))
    return common.staged(placed.join(first, "conv").select("conv", (F.col("at") - F.col("first") + 1).alias("pos"), "h1", "h2", "bytes"))


def rebuilt(turns: DataFrame, borrowed: Column | None = None, group: int = 5, most: int = 8) -> DataFrame:
    """(conv, pos, h1, h2, bytes) of conversations that begin with the first turns of their group's first conversation.

    A conversation takes ``borrowed`` turns (a column over conv, at most ``most``; by default the id's crc32 modulo
    most + 1) from the conversation conv - conv % group, all if there are fewer, then its own after as many.
    """
    borrowed = F.crc32(F.col("conv").cast("string")) % (most + 1) if borrowed is None else borrowed
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"))
    sizes = convs.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    wanted = convs.withColumn("base", F.col("conv") - F.col("conv") % group).withColumn("h", borrowed).join(sizes, "base", "left")
    plan = common.staged(wanted.select("conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")))
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv", "base")
    theirs = heads.join(plan, "base").where("pos <= h").select("conv", "pos", "h1", "h2", "bytes")
    own = turns.join(plan, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "h1", "h2", "bytes")
    return theirs.union(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, pos, k1, k2, t1, t2, bytes): the key of each conversation's first pos turns and what its last turn adds."""
    at = turns.select("conv", "pos", F.shiftright("pos", POSITIONS.bit_length() - 1).alias("block"), *(F.xxhash64("pos", f"h{k}").alias(f"t{k}") for k in (1, 2)), "bytes")
    inside = Window.partitionBy("conv", "block").orderBy("pos")
    run = at.select("*", *(F.bit_xor(f"t{k}").over(inside).alias(f"r{k}") for k in (1, 2)))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy("conv", "block").agg(*(F.bit_xor(f"t{k}").alias(f"b{k}") for k in (1, 2)))
    totals = totals.select("conv", "block", *(F.coalesce(F.bit_xor(f"b{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)))
    keyed = run.join(totals, ["conv", "block"])
    return keyed.select("conv", "pos", *(F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"k{k}") for k in (1, 2)), "t1", "t2", "bytes")


def nodes_of(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id, n_convs, bytes, parent_conv_id) of every node; convs: conv, a row each.

    The root has key 0, 0 and depth 0.
    """
    found = paths.groupBy(F.col("pos").alias("depth"), "k1", "k2").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("t1").alias("t1"), F.max("t2").alias("t2"))
    found = common.staged(found.withColumn("p1", F.col("k1").bitwiseXOR(F.col("t1"))).withColumn("p2", F.col("k2").bitwiseXOR(F.col("t2"))).drop("t1", "t2"))
    zero = F.lit(0).cast("long")
    least = F.lit(convs.agg(F.min("conv")).first()[0]).cast("long")
    root = convs.groupBy().agg(F.count("*").alias("n_convs")).where("n_convs > 0").withColumn("conv_id", least)
    own = ["depth", "k1", "k2", "conv_id", "n_convs", "bytes", "parent_conv_id"]
    top = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("bytes"), F.lit(None).cast("long").alias("parent_conv_id"))
    first = found.where("depth = 1").withColumn("parent_conv_id", least).select(*own)
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    deep = found.where("depth > 1").join(parents, ["depth", "p1", "p2"]).select(*own)
    return top.union(first).union(deep)


def arcs(nodes: DataFrame) -> DataFrame:
    """(id, ..., n_children, after_enter, after_exit): the nodes numbered by parent, and the arcs after each one's two.

    Node id has the arcs 2 * id (enter) and 2 * id + 1 (exit). Siblings have consecutive ids, by conv_id; the root is 0.
    """
    placed = common.numbered(nodes, F.asc_nulls_first("parent_conv_id"), "depth", "conv_id").withColumnRenamed("at", "id")
    groups = placed.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    groups = groups.agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n_children"))
    above = common.staged(placed.join(groups, ["conv_id", "depth"], "left"))
    lasts = above.where("last is not null").select(F.col("last").alias("id"), F.col("id").alias("parent"))
    linked = above.drop("last").join(lasts, "id", "left")
    enter = F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1)
    leave = F.when(F.col("id") == 0, F.lit(None)).otherwise(F.coalesce(2 * F.col("parent") + 1, 2 * F.col("id") + 2))
    return common.staged(linked.select(*(c for c in placed.columns), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), enter.alias("after_enter"), leave.alias("after_exit")))


SIDES = [f"{side}_{what}" for side in ("enter", "exit") for what in ("out", "arcs", "leaves", "saved", "head")]
BLOCK = "id long, " + ", ".join(f"{c} {'boolean' if c.endswith('head') else 'long'}" for c in SIDES)


def _within(frame: "pandas.DataFrame") -> "pandas.DataFrame":  # noqa: F821
    """One block: for each node's two arcs the arc outside that the tour comes to, what lies before that (arcs, leaves
    and savings, with the arc's own), and whether the tour enters the block with the arc."""
    import numpy as np
    import pandas as pd

    frame = frame.sort_values("id")
    ids = frame["id"].to_numpy()
    names = np.stack([2 * ids, 2 * ids + 1], 1).ravel()
    after = np.stack([frame["after_enter"].to_numpy(float, na_value=-1), frame["after_exit"].to_numpy(float, na_value=-1)], 1).ravel().astype(np.int64)
    sums = np.zeros((len(names), 3), np.int64)
    sums[:, 0] = 1
    sums[::2, 1], sums[::2, 2] = frame["leaf"].to_numpy(), frame["saved"].to_numpy()
    to = np.searchsorted(names, after)
    inside = (to < len(names)) & (names[np.minimum(to, len(names) - 1)] == after)
    head = np.ones(len(names), bool)
    head[to[inside]] = False
    end = len(names)  # a place behind all arcs, where chains stop
    jump, sums, out = np.append(np.where(inside, to, end), end), np.vstack([sums, [[0, 0, 0]]]), np.append(np.where(inside, -1, after), -1)
    while (jump[:end] != end).any():
        out = np.where(jump != end, out[jump], out)
        sums = sums + sums[jump]
        jump = jump[jump]
    done = {"id": ids}
    for k, side in enumerate(("enter", "exit")):
        at = slice(k, end, 2)
        done |= {f"{side}_out": pd.array(np.where(out[at] < 0, 0, out[at]), "Int64"), f"{side}_arcs": sums[at, 0], f"{side}_leaves": sums[at, 1], f"{side}_saved": sums[at, 2], f"{side}_head": head[at]}
        done[f"{side}_out"][out[at] < 0] = pd.NA
    return pd.DataFrame(done)


def ranked(tour: DataFrame, nodes_a_block: int = NODES) -> DataFrame:
    """(id, enter_at, exit_at, n_leaves, saved_tokens): each node's places in the tour, from 0, and its subtree's sums.

    tour: id, after_enter, after_exit, leaf, saved.
    """
    blocks = tour.select("id", "after_enter", "after_exit", "leaf", "saved").groupBy(F.expr(f"id div {nodes_a_block}").alias("block"))
    near = common.staged(blocks.applyInPandas(lambda f: _within(f.drop(columns="block", errors="ignore")), BLOCK))
    parts = [near.where(f"{s}_head").select((2 * F.col("id") + k).alias("arc"), *(F.col(f"{s}_{c}").alias(c) for c in ("out", "arcs", "leaves", "saved"))) for k, s in enumerate(("enter", "exit"))]
    heads = common.staged(parts[0].union(parts[1]))
    while not heads.where("out is not null").isEmpty():  # every round halves the links to the end
        further = heads.select(F.col("arc").alias("out"), F.col("out").alias("next"), *(F.col(c).alias(f"{c}_on") for c in ("arcs", "leaves", "saved")))
        more = heads.where("out is not null").join(further, "out")
        heads = common.staged(heads.where("out is null").union(more.select("arc", F.col("next"), *(F.col(c) + F.col(f"{c}_on") for c in ("arcs", "leaves", "saved")))))
    done = near
    for side in ("enter", "exit"):
        rest = heads.select(F.col("arc").alias(f"{side}_out"), *(F.col(c).alias(f"{side}_{c}_on") for c in ("arcs", "leaves", "saved")))
        done = done.join(rest, f"{side}_out", "left")
    total = {(s, c): F.col(f"{s}_{c}") + F.coalesce(f"{s}_{c}_on", F.lit(0)) for s in ("enter", "exit") for c in ("arcs", "leaves", "saved")}
    arcs_ = 2 * tour.count()
    here = lambda c: (total["enter", c] - total["exit", c]).cast("long")
    return done.select("id", *((F.lit(arcs_) - total[s, "arcs"]).alias(f"{s}_at") for s in ("enter", "exit")), here("leaves").alias("n_leaves"), here("saved").alias("saved_tokens"))


def digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) from (depth, k1, k2, conv): the digest of each key's ids, ascending, comma-joined."""
    key = ["depth", "k1", "k2"]
    order = [*key, "conv"]

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, ids, out = None, [], []
        for b in batches:
            for *k, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (k != now or len(ids) >= PIECE):
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = k
                ids.append(conv)
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip([*order, "ids"], r, strict=True)) for r in out])
                out = []
        if ids:
            out.append((*now, ids[0], ",".join(map(str, ids))))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip([*order, "ids"], r, strict=True)) for r in out])

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, sha, out = None, None, []
        for b in batches:
            for *k, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k == now:
                    sha.update(b"," + ids.encode())
                else:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(ids.encode())
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip([*key, "ends_sha256"], r, strict=True)) for r in out])
                out = []
        if now:
            out.append((*now, sha.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip([*key, "ends_sha256"], r, strict=True)) for r in out])

    sorted_ = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    joined = sorted_.mapInArrow(pieces, "depth long, k1 long, k2 long, conv long, ids string")
    return joined.repartition(*key).sortWithinPartitions(*order).select(*key, "ids").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, borrowed: Column | None = None, group: int = 5, most: int = 8) -> DataFrame:
    """Per node conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and its arcs' places enter_at, exit_at."""
    turns = turns_of(conversations)
    convs = turns.select("conv").distinct()
    paths = common.staged(prefixes(rebuilt(turns, borrowed, group, most)))
    last = paths.groupBy("conv").agg(F.max("pos").alias("depth"), F.max_by(F.struct("k1", "k2"), "pos").alias("k"))
    zero = F.lit(0).cast("long")
    ends = convs.join(last, "conv", "left").select(F.coalesce("depth", zero).alias("depth"), F.coalesce("k.k1", zero).alias("k1"), F.coalesce("k.k2", zero).alias("k2"), "conv")
    tour = arcs(nodes_of(paths, convs))
    weighed = tour.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    named = tour.join(digests(ends), ["depth", "k1", "k2"], "left").join(ranked(weighed), "id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "enter_at", "exit_at")
