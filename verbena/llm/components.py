"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.session import written

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b; both long, not null).

    Each round hangs the larger neighbours of a node, then the smaller ones, under the least node it
    knows. Links shrink to stars in a few rounds; the smallest node of a component is its root. A
    round is two joins on the node and is written to the shared folder, so lost executors cost a
    round at most. An empty table has no nodes; a link of a node with itself says nothing.
    """
    edges = links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).filter("u <> v")
    edges = written(edges.distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        # Larger neighbours go under the least of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            edges.select(F.col("v").alias("u"), F.col("u").alias("larger"))
            .join(least, "u")
            .select(F.col("larger").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # Smaller neighbours, and the node itself, go under the least of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u <> v")
            .distinct()
        )
        edges = written(small, "links")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
