"""Finality of events from chain evidence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.codec import count, field, field_of, fields

#: Order of statuses, and to which each may change.
STATUSES = ["observed", "confirmed", "finalized", "orphaned", "reverted"]
TRANSITIONS = {
    "observed": STATUSES,
    "confirmed": ["finalized", "orphaned", "reverted"],
    "finalized": ["orphaned", "reverted"],
    "orphaned": ["observed", "confirmed", "finalized", "reverted"],
    "reverted": [],
}
SUBJECT = ["canonical_event_id"]


def evm_status(confirmations: int) -> Column:
    """Status of one piece of evidence by its blocks."""
    if confirmations < 1:
        raise ValueError("confirmations must be positive")
    return (
        F.when(F.col("block_hash") != F.col("canonical_block_hash"), "orphaned")
        .when(F.col("reverted"), "reverted")
        .when(F.col("finalized_block") >= F.col("block_number"), "finalized")
        .when(F.col("latest_block") >= F.col("block_number") + confirmations, "confirmed")
        .otherwise("observed")
    )


def solana_status() -> Column:
    """Status by commitment: processed, confirmed or finalized."""
    return (
        F.when(F.col("block_hash") != F.col("canonical_block_hash"), "orphaned")
        .when(F.col("reverted"), "reverted")
        .when(F.col("commitment") == "finalized", "finalized")
        .when(F.col("commitment") == "confirmed", "confirmed")
        .otherwise("observed")
    )


def may_change(before: Column, after: Column) -> Column:
    ok = before == after
    for status, targets in TRANSITIONS.items():
        if targets:
            ok |= (before == status) & after.isin(*targets)
    return ok


def inclusion() -> Column:
    """Block number and hash as bytes that order like the pair."""
    return F.concat(F.lit(bytes([0])), count(F.col("block_number")), field(F.col("block_hash")))


def _by_inclusion(evidence: DataFrame, confirmations: int, subject: list[str]) -> DataFrame:
    """Each inclusion (block) of a subject, its evidence in one total order: state, first time, accepted, rejected.

    A status that may not follow the inclusion's is rejected. Rows that repeat count once. Where each status may follow the one before,
    counting is enough; only the evidence of other inclusions is gathered and folded.
    """
    names = [c for c in ("source_id", "provenance_id", "evidence_id") if c in evidence.columns]
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), evm_status(confirmations)).cast("int")
    order = ["asserted_at", "rank", "canonical_block_hash", "latest_block", "finalized_block", "reverted", *names]
    block = [*subject, "block_number", "block_hash"]
    rows = evidence.withColumn("rank", rank).select(*block, *order)
    in_order = Window.partitionBy(*block).orderBy(*order)
    before = F.lag(F.struct(*order)).over(in_order)
    allowed = F.lit(False)  # as ranks, from 1
    for status, targets in TRANSITIONS.items():
        if targets:
            allowed |= (F.col("before.rank") == STATUSES.index(status) + 1) & F.col("rank").isin(*[STATUSES.index(t) + 1 for t in targets])
    again = F.col("before").eqNullSafe(F.struct(*order))
    seen = rows.select("*", before.alias("before"), F.lead("rank").over(in_order).isNull().alias("last"))
    seen = seen.select(*block, *order, "last", again.alias("again"), (F.col("before").isNull() | (F.col("before.rank") == F.col("rank")) | allowed).alias("fits"))
    seen = seen.withColumn("plain", F.min("fits").over(Window.partitionBy(*block)))
    status = F.get(F.array(*[F.lit(s) for s in STATUSES]), F.col("rank") - 1)
    item = F.struct(*order, status.alias("status"))
    grouped = seen.groupBy(*block).agg(
        F.min("asserted_at").alias("first"), F.max(F.when(F.col("last"), F.col("rank"))).alias("rank"), F.count_if(~F.col("again")).alias("n"), F.collect_list(F.when(~F.col("plain") & ~F.col("again"), item)).alias("items")
    )
    rejected = F.array().cast("array<struct<evidence_id:string,status:string,current_status:string>>")
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("accepted"), rejected.alias("rejected"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["status"].isNull() | may_change(acc["status"], x["status"])
        lost = F.struct(x["evidence_id"].alias("evidence_id"), x["status"].alias("status"), acc["status"].alias("current_status"))
        return F.struct(
            F.when(fits, x["status"]).otherwise(acc["status"]).alias("status"),
            (acc["accepted"] + fits.cast("long")).alias("accepted"),
            F.when(fits, acc["rejected"]).otherwise(F.concat(acc["rejected"], F.array(lost))).alias("rejected"),
        )

    counted = F.struct(status.alias("status"), F.col("n").cast("long").alias("accepted"), rejected.alias("rejected"))
    folded = F.when(F.size("items") == 0, counted).otherwise(F.aggregate(F.array_sort("items"), start, step))
    return grouped.select(*subject, inclusion().alias("inclusion"), "first", folded.alias("f")).select(*subject, "inclusion", "first", "f.*")


def timelines(evidence: DataFrame, confirmations: int, subject: list[str] = SUBJECT) -> DataFrame:
    """Current status of each subject, with accepted updates and conflicts, whatever order its evidence came in.

    The current status is that of the inclusion that was asserted first last, so inclusions are folded on
    their own and a subject is an aggregate of them.
    """
    return _by_inclusion(evidence, confirmations, subject).groupBy(*subject).agg(
        F.max_by("status", F.struct("first", "inclusion")).alias("current_status"), F.sum("accepted").alias("n_updates"), F.sum(F.size("rejected")).cast("long").alias("n_conflicts")
    )


def conflicts(evidence: DataFrame, confirmations: int, subject: list[str] = SUBJECT) -> DataFrame:
    """Rejected evidence with its status, and the status that it can't follow."""
    return _by_inclusion(evidence, confirmations, subject).where(F.size("rejected") > 0).select(*subject, F.inline("rejected"))


#: Fixed value: what a timeline's bytes begin with.
TIMELINE_TAG = "agent-economy-finality-v1"


def state_hashes(evidence: DataFrame, confirmations: int) -> DataFrame:
    """canonical_event_id, current_status, n_updates, n_conflicts and state_hash of each event's timeline.

    evidence has the subject (canonical_event_id, chain_scope, transaction_id), source_id, provenance_id, evidence_id, asserted_at (a number) and the
    columns of evm_status. Rows are sorted within their task and hashed as they pass, so no timeline is gathered; only the bytes of an event's
    refused evidence, which come last, are held. Rows that repeat count once.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), evm_status(confirmations)).cast("int")
    basis = F.concat(inclusion(), field(F.col("canonical_block_hash")), count(F.col("latest_block")), count(F.col("finalized_block")), F.when(F.col("reverted"), F.lit(bytes([1]))).otherwise(F.lit(bytes([0]))))
    subject, names = ["canonical_event_id", "chain_scope", "transaction_id"], ["source_id", "provenance_id", "evidence_id"]
    at = F.col("asserted_at").cast("long")
    said = F.concat(fields(*[F.col(c) for c in (*subject, *names)]), count(at), F.unhex(F.lpad(F.hex(F.col("rank") - 1), 2, "0")), field_of(F.col("basis")))
    rows = evidence.select(*subject, *names, at.alias("asserted_at"), rank.alias("rank"), inclusion().alias("inclusion"), basis.alias("basis"))
    key = ["canonical_event_id", "asserted_at", "rank", "basis", *names]
    ordered = rows.select("*", said.alias("said")).repartition("canonical_event_id").sortWithinPartitions(*key)
    head = len(TIMELINE_TAG).to_bytes(8, "big") + TIMELINE_TAG.encode() + b"\0" + confirmations.to_bytes(8, "big")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        event, fold, out = None, None, []
        for batch in batches:
            for e, a, r, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if event is None or e != event:
                    if fold:
                        out.append((event, *fold.done()))
                    event, fold = e, _Timeline(head)
                fold.take(a, STATUSES[r - 1], i, s)
            if len(out) >= 5000:
                yield packed(out)
                out = []
        if fold:
            out.append((event, *fold.done()))
        if out:
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["canonical_event_id", "current_status", "n_updates", "n_conflicts", "state_hash"])

    return ordered.select("canonical_event_id", "asserted_at", "rank", "inclusion", "said").mapInArrow(run, "canonical_event_id string, current_status string, n_updates bigint, n_conflicts bigint, state_hash string")


class _Timeline:
    """Folds one event's evidence in order while its bytes are hashed."""

    def __init__(self, head: bytes):
        self.hash, self.refused, self.before = hashlib.sha256(head), [], None
        self.states: dict[bytes, tuple[str, int]] = {}  # status and first time of each inclusion
        self.active, self.index, self.status, self.n = None, -1, None, 0

    def take(self, at: int, status: str, inclusion: bytes, said: bytes) -> None:
        if said == self.before:
            return
        self.before = said
        now, first = self.states.get(inclusion, (None, at))
        if now is not None and now != status and status not in TRANSITIONS[now]:
            self.refused.append(b"\0" + said + bytes([STATUSES.index(now)]))
            return
        self.hash.update(b"\1" + said)
        self.states[inclusion] = (status, first)
        if self.active is None or self.active[1] == inclusion or self.active < (first, inclusion):
            self.active, self.index, self.status = (first, inclusion), self.n, status
        self.n += 1

    def done(self) -> tuple[str, int, int, str]:
        self.hash.update(b"".join(self.refused) + b"\1" + self.index.to_bytes(8, "big"))
        return self.status, self.n, len(self.refused), self.hash.hexdigest()
