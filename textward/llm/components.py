"""Connected components of a distributed graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm import skew
from textward.llm.scratch import Scratch


def _least(edges: DataFrame, node: str, by: str) -> DataFrame:
    """edges with m: the least neighbour of `node` that is smaller than it, if any. by: the other end.

    Minima are merged before they are shuffled, and a node's edges meet them in several tasks.
    """
    least = edges.groupBy(F.col("a").alias(node)).agg(F.min("b").alias("m"))
    return skew.spread(edges, least, [node], by=by, how="left")


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the least of the node and its neighbours."""
    return _least(edges, "b", "a").select("a", F.coalesce("m", "b").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    moved = _least(edges, "a", "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(edges.groupBy("a").agg(F.min("b").alias("b"))).distinct()


def connected(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; component: its least node.

    edges: columns a and b, in any order, repeats and loops allowed.  Inside, a > b.  Every round is written
    to the shared folder, so a lost executor costs one round.  A hub's edges are dealt over
    skew.FEW tasks by their other ends: no step gathers a node's neighbours in one task.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(rounds):
        step = scratch.keep(_small(_large(now).distinct()), "edges")
        # stars whose centre is no leaf: done
        chained = step.select(F.col("b").alias("x")).distinct().join(step.select(F.col("a").alias("x")), "x", "left_semi")
        done = chained.isEmpty() and step.groupBy("a").count().where("count > 1").isEmpty()
        scratch.drop(now)
        now = step
        if done:
            both = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return both.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"no fixed point after {rounds} rounds")
