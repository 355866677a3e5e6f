"""Substring search by a trigram index: a request reads the lists of its needle's trigrams, and only what they share is looked at.

The index is a table in buckets by trigram, each a folder, so the folders that a needle needs are known before any file is opened. What
the lists share holds all trigrams of the needle, in any place; a comparison as in ILIKE settles it.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.latest import search

KEY = ["namespace_id", "kind", "id"]
#: Folders of an index, and lists of a request that are read at most (the rest is settled by comparison).
BUCKETS, LISTS = 256, 8


def grams_of(text: F.Column) -> F.Column:
    """Distinct runs of three characters of a text in lower case."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))


def build(facts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of the ids and labels of buyers and services in facts (KEY and label), and the facts themselves, under path."""
    rows = facts.where(F.col("kind").isin("buyer", "service"))
    rows.write.parquet(f"{path}/facts")
    grams = rows.select(*KEY, F.explode(F.array_union(grams_of(F.col("id")), grams_of(F.col("label")))).alias("gram")).where(F.length("gram") == 3)
    bucket = F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(buckets)).cast("int")
    placed = grams.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(*KEY), F.lit(8)))  # a frequent trigram is in several files
    placed.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams")


def needed(needle: str) -> list[str]:
    """Trigrams that each match of a needle holds: those of its pieces between wildcards; none if a piece is too short or escapes stand in it."""
    if "\\" in needle:
        return []
    found = {piece[i : i + 3] for piece in re.split("[%_]", needle.lower()) for i in range(len(piece) - 2)}
    return sorted(found, key=lambda g: (sum(g in other for other in found), g))[:LISTS]


def lists(spark: SparkSession, path: str, grams: list[str], buckets: int = BUCKETS) -> DataFrame:
    """gram and KEY of some trigrams; only their folders are read."""
    at = sorted({zlib.crc32(g.encode()) % buckets for g in grams})
    return spark.read.parquet(f"{path}/grams").where(F.col("bucket").isin(at) & F.col("gram").isin(grams))


def find(spark: SparkSession, path: str, needle: str, namespace: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Buyers and services whose id or label contains the needle, as latest.search finds them: % and _ match as in LIKE.

    A needle without three characters in a row that aren't wildcards has no list: all facts are compared. Id and label count on
    their own, but their trigrams are one list, so a needle's trigrams may come from both until they are compared.
    """
    facts = spark.read.parquet(f"{path}/facts")
    if grams := needed(needle):
        rows = lists(spark, path, grams, buckets)
        if namespace is not None:
            rows = rows.where(F.col("namespace_id") == namespace)
        shared = rows.groupBy(*KEY).agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(grams))
        facts = facts.join(shared.select(*KEY), KEY, "left_semi")
    found = search(facts, needle)
    return found if namespace is None else found.where(F.col("namespace_id") == namespace)
