"""Features, rule labels and replay drift of buyers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.amounts import exact_sum, fits_u128, is_less
from corvane.functions.codec import each, field, fields, sha256
from corvane.operators.latest import small

METRICS = ["total_spend_atomic", "payment_count", "median_cadence_seconds", "x402_count", "mpp_count", "unique_counterparties", "autonomous_count", "autonomy_observed_count"]


def median_gaps(activities: DataFrame, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Integer median of the seconds between a subject's payments; between two middle ones, half way down."""
    return features(activities, keys).select(*keys, "median_cadence_seconds").where("median_cadence_seconds IS NOT NULL")


def features(activities: DataFrame, keys: Sequence[str] = ("subject_id",), tasks: int | None = None) -> DataFrame:
    """METRICS of each subject (each value of keys), in one shuffle to `tasks` tasks: the session's number, or one of latest.dealt_tasks.

    Gaps between payments and their ranks come from windows over the subject's payments, which share its shuffle
    and spill; of an even number of gaps the two middle ones count, half way down.
    """
    said = {"x402": F.col("protocol") == "x402", "agent": F.col("autonomy") == "verified_agent", "seen": F.col("autonomy") != "unknown"}
    rows = activities.select(*keys, "occurred_at", "amount_atomic", "counterparty", *[c.alias(name) for name, c in said.items()])
    rows = rows.repartition(tasks or int(activities.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    at = F.col("occurred_at").cast("decimal(20,0)")
    mine = Window.partitionBy(*keys)
    rows = rows.withColumn("gap", (at - F.lag(at).over(mine.orderBy("occurred_at"))).cast("decimal(20,0)"))
    rows = rows.withColumn("rank", F.row_number().over(mine.orderBy(F.col("gap").asc_nulls_last()))).withColumn("gaps", F.count("gap").over(mine))
    middle = lambda k: F.max(F.when((F.col("rank") == k) & (F.col("gaps") > 0), F.col("gap")))
    sums = rows.groupBy(*keys).agg(
        exact_sum(F.col("amount_atomic")).alias("total_spend_atomic"),
        F.count(F.lit(1)).alias("payment_count"),
        F.count_if("x402").alias("x402_count"),
        F.count_if(~F.col("x402")).alias("mpp_count"),
        F.countDistinct("counterparty").alias("unique_counterparties"),
        F.count_if("agent").alias("autonomous_count"),
        F.count_if("seen").alias("autonomy_observed_count"),
        middle(F.floor((F.col("gaps") + 1) / 2)).alias("low"),
        middle(F.floor(F.col("gaps") / 2) + 1).alias("high"),
    )
    apart = F.col("high") - F.col("low")
    return sums.withColumn("median_cadence_seconds", (F.col("low") + (apart - apart % 2) / 2).cast("decimal(20,0)")).select(*keys, *METRICS)


def outside_window(activities: DataFrame, start: int, end: int) -> DataFrame:
    return activities.where((F.col("occurred_at") < start) | (F.col("occurred_at") >= end))


def feature_violations(found: DataFrame) -> DataFrame:
    """Rows whose features contradict one another, or whose spend is beyond 128 bits."""
    n = F.col("payment_count")
    fine = (
        (n == F.col("x402_count") + F.col("mpp_count"))
        & (F.col("unique_counterparties") <= n)
        & (F.col("autonomous_count") <= F.col("autonomy_observed_count"))
        & (F.col("autonomy_observed_count") <= n)
        & (F.col("median_cadence_seconds").isNull() == (n < 2))
        & fits_u128(F.col("total_spend_atomic"))
    )
    return found.where(~fine)


def claims(found: DataFrame, labels: DataFrame, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Labels whose metric reaches the threshold; a missing cadence counts as 0. labels is a small table of rules."""
    long = found.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("string"), F.lit("0")).alias("value")) for m in METRICS])))
    rows = long.join(small(labels), "metric").where(~is_less(F.col("value"), F.col("threshold")))
    return rows.select(*keys, "label_id", "label_version", "label_kind", "confidence_bps", F.lit("inferred").alias("status"))


def _compared(both: DataFrame) -> DataFrame:
    added, removed = F.array_sort(F.array_except("new", "old")), F.array_sort(F.array_except("old", "new"))
    return both.select("subject_id", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"), (F.size(added) + F.size(removed)).cast("long").alias("churn"))


def drift(baseline: DataFrame, replay: DataFrame) -> DataFrame:
    """Labels that came and went between two runs over one window, and how many."""
    tagged = baseline.withColumn("run", F.lit("old")).unionByName(replay.withColumn("run", F.lit("new")))
    return drift_of_runs(tagged)


def drift_of_runs(found: DataFrame) -> DataFrame:
    """The same for claims of both runs in one table, by column run: old or new."""
    name = F.concat("label_id", F.lit("@"), "label_version")
    of = lambda run: F.collect_set(F.when(F.col("run") == run, name)).alias(run)
    return _compared(found.groupBy("subject_id").agg(of("old"), of("new")))


#: What the hashes of an input, of a label set and of a result begin with; orders of values.
INPUT_TAG, LABELS_TAG, RESULT_TAG = "aem-behavior-input-v1", "aem-label-set-v1", "aem-classification-result-v1"
PROTOCOLS, AUTONOMY = ["x402", "mpp"], ["verified_agent", "verified_human", "unknown"]


def label_set_hash(labels: DataFrame) -> DataFrame:
    """One row: hash of the rules by id and version. A rule set is small: it is one array."""
    rule = F.struct("label_id", F.col("label_version").cast("int").alias("label_version"), "label_kind", "metric", "threshold")
    rules = labels.agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    one = lambda r: fields(r["label_id"], r["label_version"].cast("string"), r["label_kind"], r["metric"], r["threshold"])
    return rules.select(sha256(F.concat(field(F.lit(LABELS_TAG)), each(F.col("rules"), one))).alias("label_set_hash"))


def label_set_hashes(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys and label_set_hash of each of many rule sets of any size: rules are sorted within their task and hashed as they pass."""
    rule = ["label_id", "label_version", "label_kind", "metric", "threshold"]
    rows = labels.select(*keys, F.col("label_version").cast("int").alias("label_version"), *[c for c in rule if c != "label_version"])
    rows = rows.select("*", F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__n"), fields(*[F.col(c) for c in rule]).alias("__said"))
    ordered = rows.sortWithinPartitions(*keys, *rule).select(*keys, "__n", "__said")
    head = len(LABELS_TAG).to_bytes(8, "big") + LABELS_TAG.encode()
    schema = ", ".join(f"`{c}` {labels.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for *mine, n, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mine != key:
                    if key is not None:
                        done.append((*key, digest and digest.hexdigest()))
                    key, digest = mine, hashlib.sha256(head + n.to_bytes(8, "big"))
                if said is None:  # a rule without a value has no bytes, and its set no hash
                    digest = None
                elif digest:
                    digest.update(said)
            kinds = [*(c.type for c in batch.columns[:-2]), pa.string()]
            if done:
                yield packed(done, kinds)
        if key is not None:
            yield packed([(*key, digest and digest.hexdigest())], kinds)

    def packed(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*keys, "label_set_hash"])

    return ordered.mapInArrow(run, f"{schema}, label_set_hash string")


def duplicate_labels(labels: DataFrame) -> DataFrame:
    """Rules that are defined more than once: a label set must have none."""
    return labels.groupBy("label_id", "label_version").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def input_hashes(activities: DataFrame, start: int, end: int, feature_version: str = "features@1") -> DataFrame:
    """Hash of each subject's activities in [start, end), in the order of their values, amounts as numbers.

    A run's activities are bounded (50,000), so a subject's are one row.
    """
    rank = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))
    order = [F.length("amount_atomic").alias("digits"), "amount_atomic", "occurred_at", rank("protocol", PROTOCOLS).alias("p"), "counterparty", rank("autonomy", AUTONOMY).alias("a"), "evidence_id"]
    rows = activities.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    packed = rows.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct(*order, "protocol", "autonomy"))).alias("items"))
    one = lambda x: fields(x["amount_atomic"], x["occurred_at"].cast("string"), x["protocol"], x["counterparty"], x["autonomy"], x["evidence_id"])
    head = fields(F.lit(INPUT_TAG), F.col("subject_id"), F.lit(str(start)), F.lit(str(end)), F.lit(feature_version))
    return packed.select("subject_id", sha256(F.concat(head, each(F.col("items"), one))).alias("input_hash"))


def classify(activities: DataFrame, labels: DataFrame, start: int, end: int, version: str = "classifier@1", feature_version: str = "features@1") -> DataFrame:
    """A classification batch over [start, end): METRICS, claims (by label), evidence ids and hashes of each subject."""
    inside = activities.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    found = features(inside)
    claim = F.struct("label_id", "label_version", "label_kind", "status", "confidence_bps")
    said = claims(found, labels).groupBy("subject_id").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    evidence = inside.groupBy("subject_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    rows = found.join(said, "subject_id", "left").join(evidence, "subject_id").join(input_hashes(inside, start, end, feature_version), "subject_id").join(F.broadcast(label_set_hash(labels)))
    rows = rows.withColumn("claims", F.coalesce("claims", F.array().cast(said.schema["claims"].dataType)))
    head = fields(F.lit(RESULT_TAG), F.lit(version), F.col("subject_id"), F.lit(feature_version), F.col("input_hash"), F.col("label_set_hash"), F.lit(str(start)), F.lit(str(end)))
    one = lambda c: fields(c["label_id"], c["label_version"].cast("string"), c["label_kind"], c["status"])
    return rows.withColumn("state_hash", sha256(F.concat(head, each(F.col("claims"), one))))


def drift_of_batches(baseline: DataFrame, replay: DataFrame) -> DataFrame:
    """What changed between two results of `classify` over one window, for subjects that are in both.

    subject_id, input_changed (whether other activities were seen), labels that came and went, how many, and both state hashes.
    """
    names = lambda claims: F.transform(claims, lambda c: F.concat(c["label_id"], F.lit("@"), c["label_version"].cast("string")))
    side = lambda run, mark: run.select("subject_id", F.col("input_hash").alias(f"{mark}_input"), F.col("state_hash").alias(f"{mark}_state_hash"), names(F.col("claims")).alias(mark))
    both = side(baseline, "old").join(side(replay, "new"), "subject_id")
    hashes = both.select("subject_id", (F.col("old_input") != F.col("new_input")).alias("input_changed"), F.col("old_state_hash").alias("baseline_state_hash"), F.col("new_state_hash").alias("replay_state_hash"), "old", "new")
    added, removed = F.array_sort(F.array_except("new", "old")), F.array_sort(F.array_except("old", "new"))
    return hashes.select("subject_id", "input_changed", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"), (F.size(added) + F.size(removed)).cast("long").alias("churn"), "baseline_state_hash", "replay_state_hash")


def baseline_runs(runs: DataFrame, seals: DataFrame) -> DataFrame:
    """The run each buyer starts with: of sealed runs the earliest series, in its newest version."""
    key = ["namespace_id", "run_id", "run_version"]
    sealed = runs.join(seals.select(*key), key, "left_semi").where("buyer_handle_id IS NOT NULL")
    series = sealed.groupBy("namespace_id", "buyer_handle_id", "run_id").agg(F.min("created_at").alias("began"), F.max("run_version").alias("run_version"))
    return series.groupBy("namespace_id", "buyer_handle_id").agg(F.min(F.struct("began", "run_id", "run_version")).alias("r")).select("namespace_id", "buyer_handle_id", "r.run_id", "r.run_version")


def promote(asked: DataFrame, runs: DataFrame, seals: DataFrame, promotions: DataFrame) -> DataFrame:
    """Promotions asked for (namespace_id, buyer_handle_id, run_id, run_version) with their next sequence, or a reason against them."""
    key = ["namespace_id", "run_id", "run_version"]
    sealed = runs.join(seals.select(*key), key, "left_semi").select(*key, F.col("buyer_handle_id").alias("owner"))
    last = promotions.groupBy("namespace_id", "buyer_handle_id").agg(F.max("promotion_sequence").alias("last"))
    rows = asked.join(sealed, key, "left").join(last, ["namespace_id", "buyer_handle_id"], "left")
    fits = F.col("owner").eqNullSafe(F.col("buyer_handle_id"))
    order = Window.partitionBy("namespace_id", "buyer_handle_id", fits).orderBy("run_id", "run_version")
    following = F.coalesce("last", F.lit(0)) + F.row_number().over(order)
    return rows.select("namespace_id", "buyer_handle_id", "run_id", "run_version", F.when(fits, following).cast("long").alias("promotion_sequence"), F.when(~fits, "no_sealed_run_of_buyer").alias("reason"))
