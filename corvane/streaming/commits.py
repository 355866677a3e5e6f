"""Batches of several tables that come into view together: written first, then named by the next receipt of a chain.

Every attempt writes to folders of its own, so attempts never touch one another's files. A receipt is a small file with a number;
the file system creates it only if there is none, so of two writers that would write the same number one fails and looks again. Receipts
hold the digest of the one before and the cursors after the batch, which move by comparing what was expected.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import storage
from corvane.streaming.ingest import ContradictoryReplay

RECEIPT = "number bigint, batch_id string, attempt string, before string, tables map<string,struct<n_rows:bigint,digest:string>>, cursors map<string,string>"


class Rejected(ValueError):
    """A batch breaks a rule."""


class Conflict(ValueError):
    """A cursor isn't where the writer thought it was."""


def _file(root: str, number: int) -> str:
    return f"{root}/_receipts/{number:012d}.json"


def _newest(spark: SparkSession, root: str) -> int:
    """Number of the last receipt, 0 if there is none; numbers have no gaps, so it is found by halving."""
    there = lambda n: storage.read_file(spark, _file(root, n)) is not None
    low, high = 0, 1
    while there(high):
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if there(middle) else (low, middle)
    return low


def receipts(spark: SparkSession, root: str) -> DataFrame:
    """All receipts of a store, as RECEIPT."""
    if not storage.file_names(spark, f"{root}/_receipts"):
        return spark.createDataFrame([], RECEIPT)
    return spark.read.schema(RECEIPT).json(f"{root}/_receipts/*.json")


def cursor(spark: SparkSession, root: str, name: str) -> str | None:
    """Where a cursor is; None if it was never set."""
    last = storage.read_file(spark, _file(root, _newest(spark, root)))
    return json.loads(last)["cursors"].get(name) if last else None


def _said(rows: DataFrame) -> dict:
    """Number and digest of rows in any order; rows that repeat count each time."""
    n, digest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
    return {"n_rows": n, "digest": digest}


def _replayed(spark: SparkSession, root: str, batch_id: str, tables: Mapping[str, DataFrame] | None, said: dict | None) -> bool:
    """Whether a batch is there with the same rows; ContradictoryReplay if with others."""
    before = receipts(spark, root).where(F.col("batch_id") == batch_id).select(F.to_json("tables").alias("t")).first()
    if before is None:
        return False
    if json.loads(before.t) != (said if said is not None else {name: _said(rows) for name, rows in tables.items()}):
        raise ContradictoryReplay(f"batch {batch_id} was committed with other rows")
    return True


def commit(root: str, batch_id: str, tables: Mapping[str, DataFrame], violations: Mapping[str, DataFrame] | None = None, move: tuple[str, str | None, str] | None = None) -> bool:
    """Writes a batch's tables under root; True if they are new, False if the same batch was committed before.

    Violations must be empty, or Rejected names the first rule with rows. move is a cursor, what it is expected to be (None: unset), and
    what it becomes with the batch: Conflict if it is elsewhere. Readers take only attempts with a receipt, so a batch comes into view
    whole or not at all. A committed batch that comes with other rows raises ContradictoryReplay.
    """
    spark = next(iter(tables.values())).sparkSession
    if _replayed(spark, root, batch_id, tables, None):
        return False
    for rule, rows in (violations or {}).items():
        if wrong := rows.limit(1).collect():
            raise Rejected(f"{rule}: {wrong[0].asDict()}")
    attempt = uuid.uuid4().hex
    folders = [f"{root}/{name}/attempt={attempt}" for name in tables]
    done = False
    try:
        said = {}
        for (name, rows), path in zip(tables.items(), folders, strict=True):
            rows.write.parquet(path)
            said[name] = _said(spark.read.schema(rows.schema).parquet(path))
        while not done:
            number = _newest(spark, root)
            last = storage.read_file(spark, _file(root, number)) if number else None
            if _replayed(spark, root, batch_id, None, said):  # by another writer, meanwhile
                return False
            cursors = json.loads(last)["cursors"] if last else {}
            if move:
                name, expected, then = move
                if cursors.get(name) != expected:
                    raise Conflict(f"cursor {name} is {cursors.get(name)!r}, not {expected!r}")
                cursors[name] = then
            before = hashlib.sha256(last.encode()).hexdigest() if last else ""
            receipt = {"number": number + 1, "batch_id": batch_id, "attempt": attempt, "before": before, "tables": said, "cursors": cursors}
            done = storage.create_file(spark, _file(root, number + 1), json.dumps(receipt, sort_keys=True))
        return True
    finally:
        if not done:
            for path in folders:
                storage.delete(spark, path)


def committed(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A table's rows of all committed batches, with batch_id; folders of attempts without a receipt aren't taken."""
    empty = spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("string"))
    columns = ["batch_id", *[c for c in empty.columns if c != "batch_id"]]
    if not storage.file_names(spark, f"{root}/{name}"):
        return empty.select(*columns)
    there = receipts(spark, root).where(F.map_contains_key("tables", name)).select("batch_id", "attempt")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{name}")
    rows = rows.withColumn("attempt", F.regexp_extract(F.col("_metadata.file_path"), r"attempt=([^/]+)/", 1))
    return rows.join(there, "attempt").select(*columns)


def broken_chain(spark: SparkSession, root: str) -> DataFrame:
    """Receipts that don't name the digest of the one before; must be empty."""
    lines = spark.read.text(f"{root}/_receipts", wholetext=True).select(F.sha2("value", 256).alias("own"), F.from_json("value", RECEIPT).alias("r")).select("own", "r.number", "r.batch_id", "r.before")
    before = lines.select((F.col("number") + 1).alias("number"), F.col("own").alias("said"))
    return lines.join(before, "number", "left").where(F.col("before") != F.coalesce("said", F.lit(""))).select("number", "batch_id")


def publish_once(root: str, bundle_hash: str, pages: DataFrame) -> bool:
    """Publishes a bundle of pages (page_path, markdown) once; a replay must have the same bytes."""
    return commit(root, bundle_hash, {"pages": pages})
