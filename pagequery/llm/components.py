"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps.

Each step sends every node's neighbours to the least node it knows; both are an aggregate with partial sums on the map side and an
equi-join, so a node with a third of all links is split like any other skewed key. Steps end when no link changes; each is stored
in the shared folder, which cuts the lineage. Neither links nor components reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(a, b) with a > b. large: all neighbours above a node move to its least neighbour; small: those below it, and itself."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
    moved = near.join(least, near["a"] == least["n"])
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    """What tells one set of links from another: their number and 128 bits of their hashes."""
    return tuple(links.agg(F.count(F.lit(1)), *(F.bit_xor(F.xxhash64(F.lit(seed), "a", "b")) for seed in (1, 2))).first())


def components(links: DataFrame, most: int = 60, files: int | None = None) -> DataFrame:
    """node, root (the least node of its component) of all nodes of links(a, b); nodes are of any ordered type, a link joins both ways.

    files: in how many files at most a step is stored; each costs an executor of a local file system processes of its own (chmod)."""
    kept = lambda df: stored(df.coalesce(files) if files else df, "links")
    now = kept(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(most):
        before, now = now, kept(_star(_star(now, True), False))
        discard(before)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
