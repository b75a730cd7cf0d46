"""Connected components of a link table, by alternating contractions to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewarden.session import stored

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of `links` (a, b): the smallest id that links reach from it.

    Rounds alternate between linking all larger neighbours of an id to its smallest neighbour and linking all smaller
    ones to it, until nothing changes; a hub's rows are aggregated before they are shuffled, and each round is a table
    in the shared folder. The number of rounds grows with the logarithm of the longest path; not converging within
    `ROUNDS` is an error, not a wrong result. Ends may come in any order and repeatedly; nulls are not allowed.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(ROUNDS):
        large = _contracted(edges, both=True)
        edges = stored(_contracted(large, both=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _contracted(edges: DataFrame, both: bool) -> DataFrame:
    """Links every neighbour of an id (all, or only smaller ones) to the smallest of them and the id itself."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    smallest = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(smallest, "a")
    if both:  # larger neighbours go to the smallest
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        rest = smallest.filter("m < a").select("a", F.col("m").alias("b"))
    else:  # smaller neighbours and the id go to the smallest
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        rest = smallest.filter("m < a").select("a", F.col("m").alias("b"))
    return moved.unionByName(rest).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
