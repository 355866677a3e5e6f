"""Finality of a stream of evidence: all evidence of a subject is state, as late evidence always counts.

finality_by_inclusion keeps state by inclusion: evidence that comes in, however late, reads and folds the evidence of its own block
again and of no other; of the others only a row of fixed width is looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.finality import STATUSES, TRANSITIONS, evm_status

OUTPUT = "canonical_event_id string, current_status string, n_updates long, n_conflicts long"


def fold(items: Iterable[list]) -> tuple[str | None, int, int]:
    """Current status, accepted updates and conflicts of (asserted_at, rank, block, hash, ..., status) lists in any order."""
    states: dict[tuple, str] = {}
    first: dict[tuple, int] = {}
    active, current, accepted, conflicts = None, None, 0, 0
    for item in sorted(items):
        at, block, status = item[0], (item[2], len(item[3]), item[3]), item[-1]
        before = states.get(block)
        if before is not None and before != status and status not in TRANSITIONS[before]:
            conflicts += 1
            continue
        accepted += 1
        states[block] = status
        mine = (first.setdefault(block, at), block)
        if active is None or active[1] == block or active < mine:
            active, current = mine, status
    return current, accepted, conflicts


def finality_stream(evidence: DataFrame, confirmations: int) -> DataFrame:
    """The state of each subject whenever evidence for it arrives; without expiry."""
    status = evm_status(confirmations)
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)
    rows = evidence.select(
        "canonical_event_id", "asserted_at", rank.alias("rank"), "block_number", "block_hash", "canonical_block_hash", "latest_block", "finalized_block", F.col("reverted").cast("int").alias("reverted"), "evidence_id", status.alias("status")
    )
    columns = rows.columns[1:]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        items = json.loads(state.get[0]) if state.exists else []
        known = {json.dumps(i) for i in items}
        for batch in batches:
            for row in batch[columns].itertuples(index=False):
                item = [x.item() if hasattr(x, "item") else x for x in row]
                if json.dumps(item) not in known:
                    known.add(json.dumps(item))
                    items.append(item)
        state.update((json.dumps(items),))
        current, accepted, conflicts = fold(items)
        yield pd.DataFrame({"canonical_event_id": [key[0]], "current_status": [current], "n_updates": [accepted], "n_conflicts": [conflicts]})

    return rows.groupBy("canonical_event_id").applyInPandasWithState(update, OUTPUT, "items string", "update", "NoTimeout")


#: The state store that keeps state by key; the session has to name it before the stream starts.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = ["asserted_at", "rank", "block_number", "block_hash", "canonical_block_hash", "latest_block", "finalized_block", "reverted", "evidence_id", "status"]


class Inclusions(StatefulProcessor):
    """Of each subject: the evidence of every inclusion, and what it comes to (status, first time, accepted, conflicts)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        block = "block_number bigint, block_hash string"
        self.evidence = handle.getMapState("evidence", block, "items array<string>")
        self.folded = handle.getMapState("folded", block, "status string, first bigint, accepted bigint, conflicts bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came: dict[tuple[int, str], set[str]] = {}
        for row in rows:
            came.setdefault((row.block_number, row.block_hash), set()).add(json.dumps([row[c] for c in COLUMNS]))
        for block, items in came.items():
            known = set(self.evidence.getValue(block)[0]) if self.evidence.containsKey(block) else set()
            if items <= known:
                continue
            both = [json.loads(i) for i in known | items]
            self.evidence.updateValue(block, (sorted(known | items),))
            self.folded.updateValue(block, (*_in_block(both), len(both)))
        active, accepted, conflicts = None, 0, 0
        for (number, hashed), (status, first, mine, n) in self.folded.iterator():
            accepted, conflicts = accepted + mine, conflicts + n - mine
            if active is None or active[0] < (first, (number, len(hashed), hashed)):
                active = ((first, (number, len(hashed), hashed)), status)
        yield Row(canonical_event_id=key[0], current_status=active[1], n_updates=accepted, n_conflicts=conflicts)

    def close(self) -> None:
        pass


def _in_block(items: list[list]) -> tuple[str, int, int]:
    """Status, first time and number of accepted pieces of one inclusion's evidence."""
    status, accepted = None, 0
    for item in sorted(items):
        if status is None or item[-1] == status or item[-1] in TRANSITIONS[status]:
            status, accepted = item[-1], accepted + 1
    return status, min(i[0] for i in items), accepted


def finality_by_inclusion(evidence: DataFrame, confirmations: int) -> DataFrame:
    """The state of each subject whenever evidence for it arrives, as finality_stream has it; needs the state store ROCKSDB names. Times are numbers."""
    status = evm_status(confirmations)
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)
    rows = evidence.select(
        "canonical_event_id", "asserted_at", rank.alias("rank"), "block_number", "block_hash", "canonical_block_hash", "latest_block", "finalized_block", F.col("reverted").cast("int").alias("reverted"), "evidence_id", status.alias("status")
    )
    return rows.groupBy("canonical_event_id").transformWithState(Inclusions(), OUTPUT, "Update", "None")
