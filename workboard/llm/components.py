"""Connected components over a distributed table of links (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.llm.store import cut

#: Rounds needed grow with the logarithm of the longest path; a graph that needs more than this is an error, not a cut.
MAX_ROUNDS = 60


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then v is the smallest id of its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionAll(
        edges.select(F.col("v"), F.lit(0), F.lit(1)))
    return (ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
            .where("out > 1 or (out > 0 and root > 0)").isEmpty())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in ``links`` (a, b: long): the smallest id reachable.

    Null ends and self-links are ignored. Each round aggregates a minimum per vertex (combined before the shuffle,
    so a hub costs one row per task) and writes it, then joins it back as a plain join that adaptive execution can
    split, so a hub with a third of all links stays spread. Nothing but a yes or no a round reaches the driver.
    """
    edges = cut(links.where("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    for _ in range(MAX_ROUNDS):
        if _are_stars(edges):
            break
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), name)
        # small star: u and its smaller neighbours move to the smallest of them
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), name)
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), name)
    else:
        raise RuntimeError(f"components: no fixed point after {MAX_ROUNDS} rounds")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return cut(stars.unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct(), name)
