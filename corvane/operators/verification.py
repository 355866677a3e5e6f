"""Verification of archived evidence: every object's bytes, every run's heights, and what was observed in them; and how far a collection came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import adapters, evidence, reducer
from corvane.operators.latest import small
from corvane.operators.prefix import prefix_sums
from corvane.sources.storage import stored

#: Media types of objects, the member of a response that holds protocol inputs, kinds of inputs by adapter, most observations of a run.
RPC, JSON = "application/vnd.agent-economy.rpc", "application/json"
INPUTS = "agentEconomyProtocolEvidence"
MPP = "mpp_openapi"
KINDS = {"x402_runtime": "runtime", "x402_well_known": "well_known", "x402_openapi": "openapi", "x402_bazaar": "catalog"}
MOST = 200_000


def checked(objects: DataFrame) -> DataFrame:
    """run_id, evidence_id, height, problem (null: none) and inputs of objects (run_id, chain, evidence_id, height, media_type, sha256, content).

    Bytes are hashed and parsed where they lie; contents aren't shuffled. A response's inputs must be of its height and name a context.
    """
    e = evidence.rpc_envelope(F.col("content"))
    rows = objects.select("run_id", "evidence_id", "height", "media_type", (F.sha2("content", 256) == F.col("sha256")).alias("whole"), "chain", F.explode(F.array(e)).alias("e"))  # a generator's rows are computed once
    body = F.col("e.body").cast("string")
    said = F.try_variant_get(F.try_parse_json(body), f"$.result.{INPUTS}", "variant")
    inputs = F.from_json(F.to_json(said), "array<struct<height:bigint,kind:string,context:string,evidence_base64:string>>")
    rows = rows.select("*", F.inline(F.array(F.struct(evidence.strict_json(body).alias("parsed"), said.isNotNull().alias("any"), inputs.alias("inputs")))))
    fits = lambda i: (i["height"] == F.col("height")) & (F.trim(i["context"]) != "") & i["kind"].isin("chain_transfer", MPP, *KINDS) & F.try_to_binary(i["evidence_base64"], F.lit("base64")).isNotNull()
    fine = F.col("inputs").isNotNull() & F.forall("inputs", lambda i: F.coalesce(fits(i), F.lit(False)))
    problem = (
        F.when(~F.coalesce(F.col("whole"), F.lit(False)), "digest")
        .when(F.col("media_type") != RPC, "media_type")
        .when(F.col("e").isNull() | (F.col("e.chain") != F.col("chain")) | (F.col("e.height") != F.col("height")), "envelope")
        .when(~F.coalesce(F.col("parsed"), F.lit(False)), "body")
        .when(F.col("any") & ~fine, "inputs")
    )
    return rows.select("run_id", "evidence_id", "height", problem.alias("problem"), F.when(problem.isNull() & F.col("any"), F.col("inputs")).alias("inputs"))


def reobserved(found: DataFrame) -> DataFrame:
    """run_id, evidence_id, height, reason and observation_hash of what the adapters see in the inputs of `checked`."""
    one = found.select(F.struct("run_id", "evidence_id", "height").alias("evidence_id"), F.explode("inputs").alias("i"))
    docs = one.select("evidence_id", F.col("i.kind").alias("kind"), F.col("i.context").alias("endpoint"), F.unbase64("i.evidence_base64").cast("string").alias("content"))
    out = None
    for kind, adapter in KINDS.items():
        seen = adapters.ADAPTERS[adapter](docs.where(F.col("kind") == kind)).select("evidence_id.*", "reason", F.when(F.col("reason").isNull(), reducer.payload_fingerprint_x402()).alias("observation_hash"))
        if adapter == "catalog":  # here alone an offer that is set aside lets the others be
            seen = seen.where("reason IS NULL OR reason NOT IN ('invalid_token_metadata', 'invalid_amount')")
        out = seen if out is None else out.unionByName(seen)
    declared = docs.where(F.col("kind") == MPP)
    seen = adapters.mpp_offers(declared).select("evidence_id", reducer.payload_fingerprint_mpp_discovery().alias("observation_hash"))
    refused = declared.select("evidence_id").join(seen.select("evidence_id"), "evidence_id", "left_anti").select("evidence_id.*", F.lit("malformed").alias("reason"), F.lit(None).cast("string").alias("observation_hash"))
    return out.unionByName(seen.select("evidence_id.*", F.lit(None).cast("string").alias("reason"), "observation_hash")).unionByName(refused)


def broken_runs(heights: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, problem, low, high: where heights (run_id, height) of a run (run_id, start_height, end_height) don't follow one another by 1 from its start to its end."""
    seen = prefix_sums(heights.select("run_id", F.col("height").cast("long").alias("height")), "run_id", "height", [])
    steps = seen.where("before IS NOT NULL AND height <> before + 1").select("run_id", F.when(F.col("height") == F.col("before"), "repeated").otherwise("gap").alias("problem"), F.col("before").alias("low"), F.col("height").alias("high"))
    ends = runs.join(heights.groupBy("run_id").agg(F.min("height").alias("first"), F.max("height").alias("last")), "run_id", "left")
    wrong = F.filter(
        F.array(
            F.when(F.col("first").isNull(), F.struct(F.lit("empty").alias("problem"), F.col("start_height").alias("low"), F.col("end_height").alias("high"))),
            F.when(F.col("first") != F.col("start_height"), F.struct(F.lit("start").alias("problem"), F.col("start_height").alias("low"), F.col("first").alias("high"))),
            F.when(F.col("last") != F.col("end_height"), F.struct(F.lit("end").alias("problem"), F.col("last").alias("low"), F.col("end_height").alias("high"))),
        ),
        lambda x: x.isNotNull(),
    )
    return steps.unionByName(ends.select("run_id", F.inline(wrong)))


def verify(objects: DataFrame, runs: DataFrame, recorded: DataFrame, most: int | None = MOST) -> DataFrame:
    """run_id, evidence_id, problem, low, high: all that is wrong with runs, whose rows must be none for a run to be verified.

    objects as in checked, runs as in broken_runs, recorded (run_id, evidence_id, observation_hash): what the collection said it saw. An observation
    that is seen and not recorded as often, or the other way round, is one row; a refused input is a row each time. most: observations that a run may have, None for any number.
    """
    found = stored(checked(objects))  # without contents: read once, looked at by each adapter
    at = F.col("height").cast("long")
    bytes_ = found.where("problem IS NOT NULL").select("run_id", "evidence_id", "problem", at.alias("low"), at.alias("high"))
    key = ["run_id", "evidence_id", "observation_hash", "reason"]
    none = F.lit(None).cast("long")
    said = reobserved(found).select(*key, F.when(F.col("reason").isNotNull(), at).alias("at"), F.lit(1).alias("n"))
    sides = said.unionByName(recorded.select(*key[:3], F.lit(None).cast("string").alias("reason"), none.alias("at"), F.lit(-1).alias("n")))
    differ = sides.groupBy(*key).agg(F.sum("n").alias("n"), F.max("at").alias("at")).where("n <> 0")
    name = F.when(F.col("reason").isNotNull(), F.concat(F.lit("input: "), "reason")).when(F.col("n") > 0, "observation not recorded").otherwise("observation not seen")
    times = F.when(F.col("reason").isNotNull(), F.col("n").cast("int")).otherwise(1)
    unequal = differ.withColumn("time", F.explode(F.sequence(F.lit(1), times))).select("run_id", "evidence_id", name.alias("problem"), F.col("at").alias("low"), F.col("at").alias("high"))
    many = recorded.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where(F.lit(False) if most is None else F.col("n") > most).select("run_id", F.lit(None).cast("string").alias("evidence_id"), F.lit("too many observations").alias("problem"), none.alias("low"), F.col("n").alias("high"))
    steps = broken_runs(objects.select("run_id", "height"), runs).select("run_id", F.lit(None).cast("string").alias("evidence_id"), "problem", "low", "high")
    return bytes_.unionByName(unequal).unionByName(many).unionByName(steps)


def collected(attempts: DataFrame, plans: DataFrame) -> DataFrame:
    """How far a collection comes: chain, next_height, n_blocks, requests_used and reason of each plan.

    attempts (chain, height, attempt, ok): each request in an archive, the last of a height telling whether it got its block. plans (chain,
    start_height, request_budget, max_blocks) are few. Heights count from the start as long as none is missing, failed, or beyond the
    budget of requests; the requests of the height at which it ends count too, up to the budget. reason is blocks, budget, failed or end.
    """
    per = attempts.groupBy("chain", "height").agg(F.count(F.lit(1)).alias("requests"), (~F.max_by("ok", "attempt")).cast("int").alias("bad"))
    rows = per.join(small(plans), "chain").where("height >= start_height").select("chain", F.col("height").cast("long").alias("height"), "requests", "bad", F.lit(1).alias("block"), "start_height", "request_budget", "max_blocks")
    sums = prefix_sums(rows, "chain", "height", ["requests", "bad", "block"])
    asked = sums.where("height = start_height + block_sum - 1 AND block_sum <= max_blocks AND bad_sum = bad AND requests_sum - requests < request_budget")
    safe = (F.col("bad") == 0) & (F.col("requests_sum") <= F.col("request_budget"))
    of = asked.groupBy("chain").agg(
        F.count_if(safe).alias("n_blocks"), F.max("requests_sum").alias("asked"), F.max(F.when((F.col("bad") == 1) & (F.col("requests_sum") <= F.col("request_budget")), 1).otherwise(0)).alias("failed")
    )
    out = plans.join(of, "chain", "left").select("*", F.coalesce("n_blocks", F.lit(0)).alias("blocks"), F.least(F.coalesce("asked", F.lit(0)), "request_budget").alias("requests_used"))
    reason = F.when(F.col("blocks") == F.col("max_blocks"), "blocks").when(F.col("failed") == 1, "failed").when(F.col("requests_used") >= F.col("request_budget"), "budget").otherwise("end")
    return out.select("chain", (F.col("start_height") + F.col("blocks")).cast("long").alias("next_height"), F.col("blocks").cast("long").alias("n_blocks"), F.col("requests_used").cast("long").alias("requests_used"), reason.alias("reason"))
