"""The driver's tables seen as the domain's: what each column is, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAIN = "CASE {0} % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'ethereum' WHEN 2 THEN 'solana' ELSE 'tempo' END"
PROTOCOL = "CASE WHEN {0} % 3 = 0 THEN 'mpp' ELSE 'x402' END"
_EVENT = {"namespace_id": "'ns-' || (event_id % 2)", "chain_scope": CHAIN.format("event_id"), "protocol": PROTOCOL.format("event_id"), "canonical_event_id": "'event-' || event_id"}
_LINE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"

#: Domain table: (driver table, columns, condition).
SPECS: dict[str, tuple[str, dict[str, str], str]] = {
    "settlements": (
        "events",
        _EVENT
        | {
            "settlement_id": "'set-' || event_id",
            "buyer_handle_id": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'buyer-' || user_id END",
            "asset": "upper(event_type)",
            "amount_atomic": "CAST(CAST(floor(abs(value) * 100) AS BIGINT) AS STRING)",
            "settled_at": "ts",
            "provenance_id": "'prov-' || (event_id % 50)",
        },
        "true",
    ),
    "event_provenance": (
        "events",
        {"namespace_id": "'ns-' || (event_id % 2)", "provenance_id": "'prov-' || (event_id % 50)", "evidence_id": "'ev-' || (event_id % 10)", "observed_at": "ts"},
        "true",
    ),
    "finality_1": ("events", _EVENT | {"finality_sequence": "CAST(1 AS BIGINT)", "finality_status": "'observed'"}, "true"),
    "finality_2": ("events", _EVENT | {"finality_sequence": "CAST(2 AS BIGINT)", "finality_status": "'finalized'"}, "event_id % 5 <> 0"),
    "finality_3": ("events", _EVENT | {"finality_sequence": "CAST(3 AS BIGINT)", "finality_status": "'orphaned'"}, "event_id % 5 <> 0 AND event_id % 17 = 0"),
    "observations": (
        "lineitem",
        {
            "namespace_id": "'ns-' || (l_orderkey % 2)",
            "observation_id": "'obs-' || " + _LINE,
            "canonical_event_id": "'order-' || l_orderkey",
            "source_id": "'source-' || (l_suppkey % 10)",
            "chain_scope": CHAIN.format("l_orderkey"),
            "protocol": PROTOCOL.format("l_orderkey"),
            "parser_version": "'adapter@' || (l_linenumber % 2)",
            "payload": "l_returnflag || '/' || l_linestatus",
            "observed_at": "l_shipdate",
            "evidence_id": "'ev-' || l_partkey",
            "provenance_id": "'prov-' || (l_partkey % 50)",
        },
        "true",
    ),
    "evm_evidence": (
        "lineitem",
        {
            "canonical_event_id": "'order-' || l_orderkey",
            "source_id": "'source-' || (l_suppkey % 10)",
            "provenance_id": "'prov-' || (l_partkey % 50)",
            "evidence_id": "'ev-' || " + _LINE,
            "asserted_at": "l_shipdate",
            "block_number": "CAST(l_linenumber * 10 AS BIGINT)",
            "block_hash": "'0x' || l_linenumber",
            "canonical_block_hash": "CASE WHEN l_partkey % 13 = 0 THEN '0xother' ELSE '0x' || l_linenumber END",
            "latest_block": "l_linenumber * 10 + l_suppkey % 20",
            "finalized_block": "l_linenumber * 10 - 5 + l_suppkey % 10",
            "reverted": "l_quantity <= 5",
        },
        "true",
    ),
    "requirements": (
        "part",
        {
            "requirement_id": "'req-' || p_partkey",
            "payment_option_id": "'opt-' || p_partkey",
            "endpoint_id": "'endpoint-' || (p_partkey % 200)",
            "service_id": "'service-' || (p_partkey % 25)",
            "protocol": "'x402'",
            "network": "'net-' || (p_partkey % 4)",
            "asset": "'asset-' || (p_size % 5 + 1)",
            "amount_atomic": "CAST(CAST(floor(p_retailprice) AS BIGINT) % 10 AS STRING)",
            "pay_to": "'pay-' || (p_partkey % 3)",
            "evidence_id": "'ev-part-' || p_partkey",
            "provenance_id": "'prov-' || (p_partkey % 50)",
        },
        "true",
    ),
    "order_settlements": (
        "orders",
        {
            "settlement_id": "'order-' || o_orderkey",
            "namespace_id": "'ns-' || (o_orderkey % 2)",
            "chain_scope": CHAIN.format("o_orderkey"),
            "provenance_id": "'prov-' || (o_orderkey % 50)",
            "buyer_handle_id": "'buyer-' || o_custkey",
            "protocol": "'x402'",
            "network": "'net-' || (o_orderkey % 4)",
            "asset": "'asset-' || substr(o_orderpriority, 1, 1)",
            "amount_atomic": "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) % 10 AS STRING)",
            "pay_to": "'pay-' || (o_custkey % 3)",
            "requirement_id": "CASE WHEN o_orderkey % 10 = 0 THEN 'req-' || (o_orderkey % 2000) END",
            "evidence_id": "'ev-order-' || o_orderkey",
            "settled_at": "o_orderdate",
        },
        "o_orderstatus = 'F'",
    ),
    "activities": (
        "orders",
        {
            "subject_id": "'buyer-' || o_custkey",
            "amount_atomic": "CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS STRING)",
            "occurred_on": "o_orderdate",
            "protocol": "CASE WHEN o_orderkey % 2 = 0 THEN 'x402' ELSE 'mpp' END",
            "counterparty": "'service-' || (o_orderkey % 7)",
            "autonomy": "CASE o_orderstatus WHEN 'F' THEN 'verified_agent' WHEN 'P' THEN 'human' ELSE 'unknown' END",
            "evidence_id": "'ev-order-' || o_orderkey",
            "replayed": "o_orderkey % 9 <> 0",
        },
        "true",
    ),
    "liveness_checks": (
        "lineitem",
        {"candidate_id": "'cand-' || l_suppkey", "check_id": _LINE, "checked_at": "l_shipdate", "outcome": "CASE WHEN l_returnflag = 'R' THEN 'dead' ELSE 'live' END"},
        "true",
    ),
    "candidates": (
        "supplier",
        {"candidate_id": "'cand-' || s_suppkey", "protocol": PROTOCOL.format("s_suppkey"), "display_name": "s_name", "endpoint_uri": "'https://s' || s_suppkey || '.example'"},
        "true",
    ),
    "promotions": (
        "supplier",
        {"candidate_id": "'cand-' || s_suppkey", "service_id": "'service-' || s_nationkey", "endpoint_id": "'endpoint-' || s_suppkey", "policy_version": "CAST(1 + s_suppkey % 3 AS BIGINT)"},
        "s_suppkey % 4 = 0",
    ),
    "services": (
        "nation",
        {"namespace_id": "'ns-' || (n_nationkey % 2)", "provenance_id": "'prov-' || n_nationkey", "service_id": "'service-' || n_nationkey", "display_name": "n_name", "trust_state": "CASE WHEN n_regionkey % 2 = 0 THEN 'observed' ELSE 'verified' END"},
        "true",
    ),
    "endpoints": ("supplier", {"endpoint_id": "'endpoint-' || s_suppkey", "service_id": "'service-' || s_nationkey", "endpoint_uri": "'https://s' || s_suppkey || '.example'"}, "s_suppkey % 8 <> 4"),
    "signals": (
        "lineitem",
        {"candidate_id": "'cand-' || l_suppkey", "signal_kind": "CASE WHEN l_suppkey % 3 = 0 THEN 'N' ELSE l_returnflag END", "source_id": "'source-' || (l_suppkey % 2) || l_linestatus", "observed_at": "l_shipdate"},
        "true",
    ),
    "buyers": ("customer", {"namespace_id": "'ns-' || (c_custkey % 2)", "chain_scope": CHAIN.format("c_custkey"), "provenance_id": "'prov-' || (c_custkey % 50)", "buyer_handle_id": "'buyer-' || c_custkey", "handle_kind": "CASE WHEN c_custkey % 2 = 0 THEN 'wallet' ELSE 'agent' END", "label": "c_name"}, "true"),
}

LABELS = [  # label, version, kind, metric, threshold, confidence in basis points
    ("core:high-frequency", 1, "core", "payment_count", "12", 9000),
    ("core:agentic", 1, "core", "autonomous_count", "8", 8000),
    ("local:high-spend", 7, "local", "total_spend_atomic", "200000000", 7500),
    ("local:diverse", 2, "local", "unique_counterparties", "6", 6000),
    ("local:slow", 1, "local", "median_cadence_seconds", "9000000", 5000),
]


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, condition = SPECS[name]
    return driver_table(spark, sf_dir, source).where(condition).select(*[F.expr(e).alias(c) for c, e in columns.items()])


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain(spark, sf_dir, "event_provenance").groupBy("namespace_id", "provenance_id", "evidence_id").agg(F.max("observed_at").alias("observed_at"))


def finality_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain(spark, sf_dir, "finality_1").unionByName(domain(spark, sf_dir, "finality_2")).unionByName(domain(spark, sf_dir, "finality_3"))


def label_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "label_id string, label_version int, label_kind string, metric string, threshold string, confidence_bps int")


def cte(name: str) -> str:
    """A domain table as a common table expression."""
    source, columns, condition = SPECS[name]
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {condition})"


PROVENANCE = "provenance AS (SELECT namespace_id, provenance_id, evidence_id, max(observed_at) AS observed_at FROM event_provenance GROUP BY ALL)"
UPDATES = "finality_updates AS (SELECT * FROM finality_1 UNION ALL SELECT * FROM finality_2 UNION ALL SELECT * FROM finality_3)"
LABEL_ROWS = "labels_def AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in LABELS) + ") t(label_id, label_version, label_kind, metric, threshold, confidence_bps))"


def sql(tables: str, body: str) -> str:
    """A query over domain tables named in `tables`; body starts after their definitions."""
    parts = []
    for t in tables.split():
        if t == "provenance":
            parts += [cte("event_provenance"), PROVENANCE]
        elif t == "finality_updates":
            parts += [cte("finality_1"), cte("finality_2"), cte("finality_3"), UPDATES]
        elif t == "labels_def":
            parts.append(LABEL_ROWS)
        else:
            parts.append(cte(t))
    return "WITH " + ",\n".join(parts) + ("" if body.lstrip().startswith(",") else "\n") + body
