"""Enrichment of buyers' histories, and dossiers rebuilt from evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.amounts import exact_sum, fits_u128
from corvane.functions.codec import sha256

#: Order of chains.
CHAINS = ["base", "ethereum", "solana", "tempo"]


def dossiers(settlements: DataFrame) -> DataFrame:
    """Of each buyer: payments, exact spend, covered chain and protocol pairs, and a digest that no order changes."""
    rows = settlements.where("buyer_handle_id IS NOT NULL")
    ids = F.array_sort(F.collect_set("settlement_id"))
    pairs = F.array_sort(F.collect_set(F.concat("chain_scope", F.lit(":"), "protocol")))
    out = rows.groupBy("buyer_handle_id").agg(F.count(F.lit(1)).alias("n_payments"), exact_sum(F.col("amount_atomic")).alias("total_atomic"), F.array_join(pairs, ",").alias("coverage"), F.array_join(ids, ",").alias("ids"))
    return out.withColumn("digest", sha256(F.encode("ids", "UTF-8"))).drop("ids")


def activities(settlements: DataFrame, services: DataFrame, final: DataFrame) -> DataFrame:
    """Finalized payments as activities; a payment nobody is known for is 'unattributed', with unknown autonomy."""
    keys = ["namespace_id", "protocol", "chain_scope", "canonical_event_id"]
    least = services.groupBy("settlement_id").agg(F.min("service_id").alias("service_id"))
    rows = settlements.join(final.where("finality_status = 'finalized'").select(*keys), keys, "left_semi").join(least, "settlement_id", "left")
    return rows.select("settlement_id", "buyer_handle_id", "amount_atomic", F.coalesce("service_id", F.lit("unattributed")).alias("counterparty"), F.lit("unknown").alias("autonomy"))


def priority(handles: DataFrame, limit: int) -> DataFrame:
    """Whom to enrich next: never enriched first, then most events, then longest ago, then chain and handle."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    chain = F.array_position(F.array(*[F.lit(c) for c in CHAINS]), F.col("chain_scope"))
    order = [F.desc("never_enriched"), F.desc("n_events"), F.desc("staleness_seconds"), chain.asc(), F.asc("buyer_handle_id")]
    return handles.orderBy(*order).limit(limit)


def next_job_state(jobs: DataFrame, now, max_attempts: int = 5) -> DataFrame:
    """What becomes of leased jobs: kept while the lease holds, else retried later or given up."""
    at = F.lit(now).cast("timestamp_ntz")
    expired = (F.col("status") == "leased") & (F.col("lease_expires_at") <= at)
    state = F.when(expired & (F.col("attempts") >= max_attempts), "dead_letter").when(expired, "queued").otherwise(F.col("status"))
    retry = F.when(expired & (F.col("attempts") < max_attempts), at + F.make_interval(secs=F.col("attempts") * 30)).otherwise(F.col("scheduled_for"))
    return jobs.withColumn("next_status", state).withColumn("next_scheduled_for", retry)


#: The pairs of chain and protocol that a recovered dossier must cover.
REQUIRED = sorted(f"{c}:{p}" for c in CHAINS for p in ("mpp", "x402"))


def incomplete(found: DataFrame) -> DataFrame:
    """Dossiers that don't cover exactly the required pairs."""
    return found.where(~F.col("coverage").eqNullSafe(F.lit(",".join(REQUIRED))))


def replay(entries: DataFrame) -> DataFrame:
    """Dossier of each buyer from manifest entries (FIXTURES 2): payments, sum, coverage, digest in order of object, generation and id.

    An entry's payload is its settlement as JSON. reason is set where an entry can't be read, is of another buyer, or
    a settlement comes twice. A buyer's manifest is bounded, so it is one row.
    """
    said = F.from_json(F.unbase64("payload_base64").cast("string"), "struct<buyer_handle_id:string,settlement_id:string,protocol:string,amount_atomic:string>")
    e = entries.withColumn("s", said)
    good = F.coalesce((F.col("s.buyer_handle_id") == F.col("buyer_handle_id")) & fits_u128(F.col("s.amount_atomic")) & F.col("s.settlement_id").isNotNull() & F.col("chain").isin(*CHAINS), F.lit(False))
    item = F.struct("object_name", "generation", "observation_id", F.sha2(F.unbase64("payload_base64"), 256).alias("content"))
    rows = e.withColumn("good", good).groupBy("buyer_handle_id").agg(
        F.count(F.lit(1)).alias("n_entries"), F.countDistinct("chain", "s.settlement_id").alias("n_payments"), exact_sum(F.when(F.col("good"), F.col("s.amount_atomic"))).alias("total_atomic"),
        F.array_join(F.array_sort(F.collect_set(F.concat("chain", F.lit(":"), "s.protocol"))), ",").alias("coverage"), F.bool_and("good").alias("good"), F.array_sort(F.collect_list(item)).alias("items"),
    )
    text = F.array_join(F.transform("items", lambda x: F.concat_ws("\n", x["object_name"], x["generation"].cast("string"), x["observation_id"], x["content"])), "\n")
    reason = F.when(~F.col("good"), "payload").when(F.col("n_payments") < F.col("n_entries"), "duplicate").when(F.col("coverage") != ",".join(REQUIRED), "coverage")
    return rows.select("buyer_handle_id", "n_payments", "total_atomic", "coverage", reason.alias("reason"), F.sha2(F.concat_ws("\n", "buyer_handle_id", text), 256).alias("digest"))
