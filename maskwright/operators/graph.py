"""Rounds of joins for what a loop over a page would do: components of links, and greedy choice among conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, once


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each of nodes(node) by links(a, b).

    Each round hangs the higher neighbours of a node on its least one, and then its lower neighbours and itself, until
    all that is left are stars; paths shorten by half or so, and the links never grow in number. Rounds are written once
    each and the one before is deleted.
    """

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

    now = once(ordered(links))
    for _ in range(most_rounds):
        sides = now.select(F.col("a").alias("n"), F.col("b").alias("m")).union(now.select("b", "a"))
        least = sides.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo"))
        higher = once(ordered(sides.join(least, "n").where("m > n").select(F.col("lo").alias("a"), F.col("m").alias("b"))))
        centre = higher.groupBy("b").agg(F.min("a").alias("lo"))
        lower = higher.join(centre, "b")
        after = once(ordered(lower.select(F.col("lo").alias("a"), F.col("a").alias("b")).union(centre.select(F.col("lo").alias("a"), "b"))))
        forget(now, higher)
        now = after
        # Stars: no node hangs on two centres, and no centre hangs on another.
        if now.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            found = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    raise RuntimeError(f"components have not converged in {most_rounds} rounds")


def outdone(conflicts: DataFrame) -> DataFrame:
    """The nodes(node) of conflicts(early, late) that greedy() leaves out: nodes without conflicts aren't looked at."""
    pairs = once(conflicts.select("early", "late").where("early < late").distinct())
    nodes = pairs.select(F.col("early").alias("node")).union(pairs.select(F.col("late").alias("node"))).distinct()
    return nodes.join(greedy(nodes, pairs), "node", "left_anti")


def greedy(nodes: DataFrame, conflicts: DataFrame, most_rounds: int = 200) -> DataFrame:
    """The nodes(node) that stay if they are taken in rising order, each unless an earlier one that stays conflicts with it.

    conflicts(early, late). Each round decides all nodes whose earlier conflicts are decided: as many rounds as the longest
    chain of conflicts, whatever the number of nodes.
    """
    open_ = once(conflicts.select("early", "late").where("early < late").distinct())
    free = nodes.select("node").distinct().join(open_.select(F.col("late").alias("node")), "node", "left_anti")
    kept = once(free)
    fresh, all_kept = kept, kept
    for _ in range(most_rounds):
        if open_.isEmpty():
            return all_kept
        gone = open_.join(fresh.select(F.col("node").alias("early")), "early", "left_semi").select(F.col("late").alias("node")).distinct()
        # What a kept node pushes out pushes out nothing itself, and needs no decision any more.
        rest = once(open_.join(gone.select(F.col("node").alias("late")), "late", "left_anti").join(gone.select(F.col("node").alias("early")), "early", "left_anti"))
        # Nodes all of whose earlier conflicts went are kept now.
        waiting = open_.select(F.col("late").alias("node")).distinct().join(gone, "node", "left_anti")
        fresh = once(waiting.join(rest.select(F.col("late").alias("node")), "node", "left_anti"))
        all_kept = all_kept.union(fresh)
        forget(open_)
        open_ = rest
    raise RuntimeError(f"conflicts are not settled after {most_rounds} rounds")
