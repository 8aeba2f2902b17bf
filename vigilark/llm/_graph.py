"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm._tables import release, settle

MAX_ROUNDS = 60


def _marks(edges: DataFrame) -> tuple:
    """What tells two versions of a link table apart: count and sum of hashes."""
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _least(pairs: DataFrame) -> DataFrame:
    """For each `u`, the least of itself and its `v`s. Settled, so that both sides of the join
    that follows are dealt out anew and a hub's rows can be split over tasks."""
    return settle(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), columnar=True)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `component` for every node of a link: the smallest node it reaches.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    least neighbour, then its smaller ones. Rows never outnumber links by more than their ends,
    no group is ever collected, and the rounds grow with the logarithm of the longest path.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = settle(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), columnar=True)
    before = _marks(edges)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = settle(large.filter("u <> v").distinct(), columnar=True)
        release(edges, least)
        least = _least(moved)
        small = moved.join(least, "u")
        edges = settle(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct(),
            columnar=True,
        )
        release(moved, least)
        after = _marks(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
