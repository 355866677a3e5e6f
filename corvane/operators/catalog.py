"""Candidates of the catalog: health, promotion by two signals, buyer clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidate_health(candidates: DataFrame, checks: DataFrame, as_of) -> DataFrame:
    """unseen, live, dead or stale, by each candidate's newest three checks at a time."""
    w = Window.partitionBy("candidate_id").orderBy(F.desc("checked_at"), F.desc("check_id"))
    newest = checks.where(F.col("checked_at") <= F.lit(as_of).cast("timestamp_ntz")).withColumn("n", F.row_number().over(w)).where("n <= 3")
    seen = newest.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("outcome", "n").alias("last"), F.count_if(F.col("outcome") == "dead").alias("dead"))
    rows = candidates.select("candidate_id").join(seen, "candidate_id", "left")
    health = F.when(F.col("n").isNull(), "unseen").when(F.col("last") == "live", "live").when((F.col("n") == 3) & (F.col("dead") == 3), "dead").otherwise("stale")
    return rows.select("candidate_id", health.alias("health_status"))


def shadow_catalog(candidates: DataFrame, promotions: DataFrame, checks: DataFrame, as_of) -> DataFrame:
    """Candidates that aren't promoted, with their checks."""
    open_ = candidates.join(promotions.select("candidate_id"), "candidate_id", "left_anti")
    history = checks.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("liveness_check_count"), F.max("checked_at").alias("last_checked_at"))
    rows = open_.join(candidate_health(open_, checks, as_of), "candidate_id").join(history, "candidate_id", "left")
    return rows.withColumn("liveness_check_count", F.coalesce("liveness_check_count", F.lit(0)).cast("long"))


def verified_catalog(promotions: DataFrame, candidates: DataFrame, services: DataFrame, endpoints: DataFrame, checks: DataFrame, as_of) -> DataFrame:
    rows = promotions.join(candidates.select("candidate_id", "protocol"), "candidate_id").join(services.select("service_id", "display_name"), "service_id")
    rows = rows.join(endpoints.select("endpoint_id", "service_id", "endpoint_uri"), ["endpoint_id", "service_id"])
    return rows.join(candidate_health(promotions, checks, as_of), "candidate_id").withColumn("trust_state", F.lit("verified"))


def promotable(candidates: DataFrame, signals: DataFrame, endpoints: DataFrame, services: DataFrame, as_of) -> DataFrame:
    """Candidates with signals of two kinds from two sources by a time, whose endpoint belongs to an observed service."""
    counted = signals.where(F.col("observed_at") <= F.lit(as_of).cast("timestamp_ntz")).groupBy("candidate_id")
    enough = counted.agg(F.countDistinct("signal_kind").alias("kinds"), F.countDistinct("source_id").alias("sources")).where("kinds >= 2 AND sources >= 2")
    targets = endpoints.join(services.where("trust_state = 'observed'").select("service_id"), "service_id", "left_semi").select("endpoint_uri")
    return candidates.join(targets, "endpoint_uri", "left_semi").join(enough, "candidate_id").select("candidate_id", "kinds", "sources")


def cluster_membership(log: DataFrame, version: int | None = None) -> DataFrame:
    """Members of each cluster at a version (None: the newest): handles whose last action up to it is add."""
    log = log if version is None else log.where(F.col("version") <= version)
    last = log.groupBy("cluster_id", "buyer_handle_id").agg(F.max_by("action", "version").alias("action"))
    return last.where("action = 'add'").select("cluster_id", "buyer_handle_id")
