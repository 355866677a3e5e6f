"""Incremental ingestion: batches of a stream appended once, with receipts, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.latest import contradictions, new_rows


class ContradictoryReplay(ValueError):
    """A key came again with other values."""


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)


def within(stored: DataFrame, batch: DataFrame, column: str | None) -> DataFrame:
    """The stored rows whose column (say, a time in the key) is in the batch's range: row groups outside it aren't read."""
    if column is None:
        return stored
    low, high = batch.agg(F.min(column), F.max(column)).first()
    return stored.where(F.col(column).between(F.lit(low), F.lit(high)))


def append_once(path: str, receipts: str, keys: Sequence[str], prune: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows with new keys and notes each batch.

    A batch that was noted before is let be. prune names a column of the key: only stored rows in the
    batch's range of it are compared. ContradictoryReplay is raised if a key that is stored comes
    with other values: nothing of that batch is written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.limit(0).write.mode("ignore").parquet(path)  # so that the table exists
        spark.createDataFrame([], "batch_id long, n_rows long, digest long").write.mode("ignore").parquet(receipts)
        noted = _table(spark, receipts, "batch_id long, n_rows long, digest long")
        if not noted.where(F.col("batch_id") == batch_id).isEmpty():
            return
        batch.persist()
        try:
            rows = batch.distinct()
            if wrong := rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect():
                raise ContradictoryReplay(f"twice in a batch with other values: {wrong[0].asDict()}")
            stored = within(_table(spark, path, batch.schema), batch, prune)
            if wrong := contradictions(rows, stored, keys).limit(1).collect():
                raise ContradictoryReplay(f"stored with other values: {wrong[0].asDict()}")
            new_rows(rows, stored, keys).write.mode("append").parquet(path)
            receipt = batch.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*batch.columns)).alias("digest"))
            receipt.write.mode("append").parquet(receipts)
        finally:
            batch.unpersist()

    return write


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handles all that is there now, then ends."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Settlements by hour, protocol and chain; hours are final when the watermark has passed them."""
    return (
        stream.withWatermark("settled_at", late)
        .groupBy(F.window("settled_at", "1 hour").alias("hour"), "protocol", "chain_scope")
        .agg(F.count(F.lit(1)).alias("settlement_count"))
        .select(F.col("hour.start").alias("hour"), "protocol", "chain_scope", "settlement_count")
    )


def touched(batch: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All stored rows of the keys of a batch: what has to be reduced again."""
    return history.join(batch.select(*keys).distinct(), list(keys), "left_semi")
