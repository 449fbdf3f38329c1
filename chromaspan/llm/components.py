"""Connected components of a table of links, by repeated contraction. Nothing is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that can be reached. links: a, b (long, a <> b), repeated or not.

    Each round orders the nodes anew by a hash and lets each pick the first of its neighbours. Picks end in pairs that pick
    each other: two steps never lead to a later node. So every node has a pick, and goes to the first of the nodes that its
    third and fourth step lead to; a star ends in one round, a path of n nodes has about n / 4 of them left. Links inside a
    joined node are dropped. The group-by is of minima, so frequent nodes and repeated links are combined before the shuffle.
    """
    edges = staged(links.select("a", "b").where("a <> b"))
    at = edges.select(F.col("a").alias("node"), F.col("b").alias("at"))
    for k in range(most_rounds):
        if edges.isEmpty():
            break
        ranked = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("r"), F.col(c).alias("to"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        picks = staged(both.groupBy(F.col("a").alias("v0")).agg(F.min(ranked("b")).alias("m")).select("v0", F.col("m.to").alias("v1")))
        steps = picks
        for s in (1, 2, 3):
            steps = steps.join(picks.select(F.col("v0").alias(f"v{s}"), F.col("v1").alias(f"v{s + 1}")), f"v{s}").select("v0", f"v{s}", f"v{s + 1}")
        joined = staged(steps.select(F.col("v0").alias("at"), F.least(ranked("v3"), ranked("v4"))["to"].alias("to")))
        if k:
            at = staged(at.join(joined, "at", "left").select("node", F.coalesce("to", "at").alias("at")))
        else:  # every node has a link
            at = joined.select(F.col("at").alias("node"), F.col("to").alias("at"))
        edges = edges.join(joined.select(F.col("at").alias("a"), F.col("to").alias("x")), "a").join(joined.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
        edges = staged(edges.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    else:
        raise RuntimeError("the contraction has not ended")
    names = at.groupBy("at").agg(F.min("node").alias("component"))
    return staged(at.join(names, "at").select("node", "component"))


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """components() of the links that gave ``found`` and of these: only what these join is contracted."""
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = components(named)
    old = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return staged(old.union(merged.join(found, "node", "left_anti").select("node", "component")))
