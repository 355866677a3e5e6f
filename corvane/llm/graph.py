"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import Scratch, stored


def components(links: DataFrame, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """node and component (the smallest node it reaches) of each node of links (columns a, b of one type that has an order).

    In each round every node and its neighbours move to the smallest of them, so what is within two
    links of a component's smallest node comes to hang on it; rounds grow with the logarithm of the
    longest chain. A round aggregates and joins by node and is written to shared storage, so a node
    with very many links costs aggregated rows and a join that Spark can split. Loops and repeated
    links are let be. store writes the result.
    """
    with Scratch(links.sparkSession) as scratch:
        links = scratch.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        seen = lambda rows: rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("b")), F.bit_xor(F.xxhash64("a", "b"))).first()
        before = seen(links)  # stars are done with the first round
        while before[0]:
            done = scratch.mark()
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
            moved = both.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
            links = scratch.stored(moved.where("a <> b").distinct())
            scratch.spent(done - 1, done)
            now = seen(links)
            if now == before:
                break
            before = now
        # each node but the smallest now has one link, to the smallest
        roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return store(links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
