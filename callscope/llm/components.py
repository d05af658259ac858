"""Connected components of links, by large and small stars.

Each round hangs every node's larger neighbours on its smallest neighbour, and then every node on the smallest of its
smaller ones. The number of links never grows, a chain shrinks by half each time, and a node with very many links is a
join key that adaptive execution splits, never a group in one task. Rounds are written to the shared folder, which cuts
the lineage and survives lost executors; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.plans.storage import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links run from the larger node a to the smaller node b."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionAll(least.select("a", F.col("least").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node that occurs in ``links`` (a, b).

    Null ends and links of a node to itself are left out. No links give no rows.
    """
    ordered = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    current, seen = written(ordered, "links"), None
    while True:
        state = current.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("sum")).first()
        if (state["n"], state["sum"]) == seen or not state["n"]:
            break
        seen = (state["n"], state["sum"])
        current = written(_small_star(_large_star(current)), "links")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
