"""Connected components of an edge table by alternating large-star and small-star steps, entirely in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import drop, written


def _least(edges: DataFrame) -> DataFrame:
    """(a, m), as a table: the join with it then shuffles both sides itself, so Spark can split a hub's edges."""
    return written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")


def _stars(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step, as a table; the tables between are deleted."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = _least(both)
    near = both.filter("b > a").join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = written(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b"), "large")
    drop(first)
    second = _least(large)
    joined = large.join(second, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    after = written(joined.union(second.select("a", F.col("m").alias("b"))).filter("a > b").distinct(), "edges")
    drop(large)
    drop(second)
    return after


def component_labels(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (a, b): every vertex but the least of its component, with that least vertex.

    Null and self edges don't count; repeated edges are fine; no edges give no rows.  Each round is a table in the
    shared folder, replaced by the next; the loop ends when a round changes nothing.  A hub's edges may be a third of
    all: its minimum is aggregated before the shuffle, and Spark splits its side of the join.
    """
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        after = _stars(now)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop(now)
        now = after
        if tuple(mark) == seen:
            return now
        seen = tuple(mark)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
