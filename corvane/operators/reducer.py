"""Reduction of observations to canonical events by majority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.codec import field, fields, optional, sha256

EVENT = ["namespace_id", "canonical_event_id"]


def payload_fingerprint_x402() -> F.Column:
    """Hash of what an x402 observation says; its key and provenance don't count."""
    version = F.unhex(F.lpad(F.hex("protocol_version"), 8, "0"))
    wrapped = F.concat(F.unhex(F.lit("0000000000000004")), version)
    return sha256(F.concat(fields(F.lit("x402"), F.col("asset"), F.col("amount_atomic")), wrapped, fields(F.col("scheme"), F.col("network"), F.col("pay_to"), F.col("resource"))))


def payload_fingerprint_mpp() -> F.Column:
    return sha256(fields(F.lit("mpp"), F.col("intent"), F.col("amount_atomic")))


def payload_fingerprint_mpp_discovery() -> F.Column:
    """Hash of a discovered offer (columns of adapters.mpp_offers): optional fields are marked as there or not."""
    said = fields(F.lit("mpp-discovery"), *[F.col(c) for c in ("openapi_version", "service_title", "api_version", "intent", "method")])
    return sha256(F.concat(said, *[optional(F.col(c)) for c in ("amount", "currency", "description")], field(F.col("raw"))))


def fingerprint(payload: str = "payload") -> F.Column:
    return sha256(field(F.col(payload)))


def cohorts(observations: DataFrame, payload: str = "payload") -> DataFrame:
    """Size of each group of observations of an event that say the same; what they say is hashed once for the group."""
    sizes = observations.groupBy(*EVENT, payload).agg(F.count(F.lit(1)).alias("n_observations"))
    return sizes.select(*EVENT, fingerprint(payload).alias("fingerprint"), "n_observations")


def winners(observations: DataFrame, payload: str = "payload") -> DataFrame:
    """The largest cohort of each event; of equal ones the smallest fingerprint. Aggregates only: no window."""
    sizes = cohorts(observations, payload)
    best = sizes.groupBy(*EVENT).agg(F.min(F.struct((-F.col("n_observations")).alias("less"), "fingerprint")).alias("w"), F.count(F.lit(1)).alias("n_cohorts"))
    return best.select(*EVENT, F.col("w.fingerprint").alias("winner"), (-F.col("w.less")).alias("n_supporting"), "n_cohorts")


def roles(observations: DataFrame, payload: str = "payload", of: DataFrame | None = None) -> DataFrame:
    """All columns of observations (or of `of`, some of them) with fingerprint and support_role.

    Cohorts of all observations are ranked by themselves - there are few in an event - and those asked for look theirs up.
    """
    sizes = observations.groupBy(*EVENT, payload).agg(F.count(F.lit(1)).alias("n")).withColumn("fingerprint", fingerprint(payload))
    best = F.row_number().over(Window.partitionBy(*EVENT).orderBy(F.desc("n"), "fingerprint")) == 1
    own = [F.col(c).alias(f"__{c}") for c in (*EVENT, payload)]
    ranked = sizes.select(*own, "fingerprint", F.when(best, "supporting").otherwise("conflicting").alias("support_role"))
    same = F.col(payload).eqNullSafe(F.col(f"__{payload}"))
    for c in EVENT:
        same &= F.col(c) == F.col(f"__{c}")
    asked = observations if of is None else of
    return asked.join(ranked, same).select(*asked.columns, "fingerprint", "support_role")


def supported(observations: DataFrame, tasks: int, payload: str = "payload", of: DataFrame | None = None) -> DataFrame:
    """Observations (or those of `of`, some of them) that say what the winner of their event says, dealt by event to `tasks` tasks.

    An event has one winner, so both sides meet by event alone; what they say is compared afterwards, and each side is shuffled once.
    """
    dealt = observations.select(*EVENT, payload).repartition(tasks, *EVENT)
    sizes = dealt.groupBy(*EVENT, payload).agg(F.count(F.lit(1)).alias("n")).withColumn("fingerprint", fingerprint(payload))
    best = F.row_number().over(Window.partitionBy(*EVENT).orderBy(F.desc("n"), "fingerprint"))
    won = sizes.withColumn("__best", best).where("__best = 1").select(*EVENT, F.array(payload).alias("__won"))
    asked = (observations if of is None else of).repartition(tasks, *EVENT)
    # as sets, in which nulls are equal: an equality would become part of the join's key, and all rows be dealt once more
    same = F.size(F.array_intersect(F.array(payload), F.col("__won"))) > 0
    return asked.join(won, EVENT).where(same).select(*asked.columns)


def links(observations: DataFrame, payload: str = "payload") -> DataFrame:
    """The role of each observation in its event."""
    return roles(observations.select(*EVENT, "observation_id", payload), payload).drop(payload)


def conflicts(observations: DataFrame, payload: str = "payload") -> DataFrame:
    """Losing cohorts with their observations."""
    lost = links(observations, payload).where("support_role = 'conflicting'")
    return lost.groupBy(*EVENT, "fingerprint").agg(F.count(F.lit(1)).alias("n_observations"), F.min("observation_id").alias("first_observation"), F.max("observation_id").alias("last_observation"))


def events(observations: DataFrame, payload: str = "payload") -> DataFrame:
    """Canonical events; their time is the newest of all linked observations."""
    at = observations.groupBy(*EVENT).agg(F.max("observed_at").alias("event_at"), F.count(F.lit(1)).alias("n_observations"))
    return at.join(winners(observations, payload), EVENT)


def authoritative(observations: DataFrame) -> DataFrame:
    """Runtime observations, and static ones of resources without a runtime observation."""
    runtime = observations.where("evidence_kind = 'runtime'")
    rest = observations.where("evidence_kind <> 'runtime'").join(runtime.select("resource"), "resource", "left_anti")
    return runtime.unionByName(rest)
