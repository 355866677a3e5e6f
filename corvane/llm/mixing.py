"""Mixing sources to target weights, with DataFrame functions only.

Two passes: tokens are summed per source (partial sums before the shuffle, so a hot source
costs one row per task), then each document looks its source's repetition rate up in that
small table and is emitted floor(rate) times plus once more with the fraction's probability,
decided by a hash of seed and id. A rerun gives the same copies on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.base import n_words, sized, stored, table


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Target of each source (columns source, source_size), capped at `most` times its size.

    Resharing a cap's excess by weight ends at the one level L where the targets
    min(L * weight, cap) sum to the whole. Sources ordered by cap / weight reach their cap in that
    order, so L follows from running sums of caps and weights. Ties share one frame; a source
    without words gets 0.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(by_code_point) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", (F.col("source_size") * most).cast("long"))
    ratio = F.col("cap").cast("double") / F.col("weight")
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranked.withColumn("ratio", ratio)
        .withColumn("whole", F.sum("source_size").over(everyone))
        .withColumn("capped", F.coalesce(F.sum("cap").over(full), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everyone) - F.sum("weight").over(full))
        # at the level of its own ratio, the sources up to it take their caps and the others their weight's share
        .withColumn("reached", F.col("whole") * F.lit(float(share)) - F.col("capped") >= F.col("ratio") * F.col("open_weight"))
        .withColumn("done_cap", F.coalesce(F.sum(F.when(F.col("reached"), F.col("cap"))).over(everyone), F.lit(0)))
        .withColumn("done_weight", F.coalesce(F.sum(F.when(F.col("reached"), F.col("weight"))).over(everyone), F.lit(0)))
        .withColumn("all_weight", F.sum("weight").over(everyone))
        .withColumn(
            "target",
            F.when(F.col("reached"), F.col("cap").cast("double")).otherwise(
                F.col("weight") * F.try_divide(F.col("whole") * F.lit(float(share)) - F.col("done_cap"), F.col("all_weight") - F.col("done_weight"))
            ),
        )
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "target", "rate")
    )


def draw(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, rate and copies.

    Null text has size 0; a null source is a source of its own, last in order. Rows with equal
    doc_id get equal draws; an empty table gives an empty result; other columns stay, columns of
    docs with a result's name are replaced.
    """
    added = ("size", "source_size", "target", "rate", "copies")
    docs = docs.drop(*added)
    sizes = docs.select("source", n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = stored(source_targets(sizes, weights, share, most))
    looked_up = sized(rates.withColumnRenamed("source", "rate_source"), rates.count())
    joined = docs.join(looked_up, docs["source"].eqNullSafe(F.col("rate_source")), "left").drop("rate_source")
    floor = F.floor("rate")
    once_more = (draw(seed, F.col("doc_id")) < F.col("rate") - floor).cast("long")
    return joined.withColumn("size", n_words(F.col("text"))).withColumn("copies", floor + once_more)


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each row of docs as often as its rate says, with the columns of docs."""
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__row"))
    planned = plan_mix(rows, **settings).where("copies > 0")
    return planned.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::BIGINT AS weight, 2 * source_size AS cap FROM per),
r AS (SELECT *, cap::DOUBLE / weight AS ratio, (sum(source_size) OVER ())::BIGINT AS whole, (sum(weight) OVER ())::BIGINT AS all_weight FROM w),
f AS (SELECT *, (sum(cap) OVER (ORDER BY ratio))::BIGINT AS capped, all_weight - (sum(weight) OVER (ORDER BY ratio))::BIGINT AS open_weight FROM r),
d AS (SELECT *, whole * 1.5::DOUBLE - capped >= ratio * open_weight AS reached FROM f),
t AS (SELECT *, coalesce(sum(CASE WHEN reached THEN cap END) OVER (), 0)::BIGINT AS done_cap,
        coalesce(sum(CASE WHEN reached THEN weight END) OVER (), 0)::BIGINT AS done_weight FROM d),
g AS (SELECT source, source_size, CASE WHEN reached THEN cap::DOUBLE
        ELSE weight * ((whole * 1.5::DOUBLE - done_cap) / (all_weight - done_weight)) END AS target FROM t),
x AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
      FROM sized JOIN g ON sized.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
     < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
