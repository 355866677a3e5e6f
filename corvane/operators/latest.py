"""The newest or oldest row of each key, pages by key, and other small relational pieces."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: the first in order. Spark limits the rows of each key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Rows of a task that sorts them in several steps at once.
TASK_ROWS = 250_000


def dealt_tasks(df: DataFrame, rows: int | None = None) -> int:
    """Tasks to deal df to by a number, so that none gets many more than `rows` (TASK_ROWS) of its rows; they are counted. Adaptive execution doesn't gather tasks
    of a given number, which it otherwise does up to a size in the shuffle, a multiple of it in memory."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or TASK_ROWS)))


def many(df: DataFrame, keys: Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """Keys of more than `rows` (TASK_ROWS) rows of df, which are few, with a column `name`: the parts of at most about so many rows to cut each to."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > (rows or TASK_ROWS))
    return F.broadcast(n.select(*keys, F.ceil(F.col("__n") / (rows or TASK_ROWS)).cast("int").alias(name)))


EVENT_KEYS = ["namespace_id", "protocol", "chain_scope", "canonical_event_id"]
#: Most rows of a table that is broadcast after they were counted.
BROADCAST_ROWS = 10_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it has at most `limit` rows (no more are counted); else it joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def current_event_finality(updates: DataFrame) -> DataFrame:
    """The update with the highest sequence of each event: an aggregate, so only one row per event and task is shuffled."""
    rest = [c for c in updates.columns if c not in EVENT_KEYS]
    best = updates.groupBy(*EVENT_KEYS).agg(F.max_by(F.struct(*rest), "finality_sequence").alias("__u"))
    return best.select(*EVENT_KEYS, "__u.*").select(*updates.columns)


def joined_set(column: str) -> Column:
    """Distinct values in order, joined by commas."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def page_limit(limit: int | None = None) -> int:
    """25 if not given; ValueError outside 1 to 100."""
    limit = 25 if limit is None else limit
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return limit


def page(df: DataFrame, by: Sequence[str], after: Sequence | None = None, limit: int | None = None, descending: bool = False) -> DataFrame:
    """The rows after a cursor in the order of `by`, one more than the limit to tell whether there are more."""
    key = F.struct(*by)
    if after is not None:
        cursor = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(by, after, strict=True)])
        df = df.where(key < cursor if descending else key > cursor)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in by]
    return df.orderBy(*order).limit(page_limit(limit) + 1)


def search(facts: DataFrame, needle: str) -> DataFrame:
    """Buyers and services whose id or label contains the needle, in any case; % and _ in it match as in LIKE."""
    if not 1 <= len(needle) <= 200:
        raise ValueError("needle must have 1 to 200 characters")
    like = f"%{needle}%"
    return facts.where(F.col("kind").isin("buyer", "service") & (F.col("id").ilike(like) | F.col("label").ilike(like)))


def height_gaps(heights: DataFrame, keys: Sequence[str], height: str) -> DataFrame:
    """Where heights of a key skip: the last before and the first after each gap."""
    w = Window.partitionBy(*keys).orderBy(height)
    found = heights.select(*keys, height).distinct().withColumn("before", F.lag(height).over(w))
    return found.where(F.col(height) > F.col("before") + 1).select(*keys, F.col("before").alias("gap_after"), F.col(height).alias("gap_until"))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't there yet, once: an insert that lets conflicts be."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def contradictions(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are there with other values: must be empty for a replay to be accepted."""
    values = [c for c in incoming.columns if c not in keys]
    a = incoming.select(*keys, F.struct(*values).alias("__new"))
    b = existing.select(*keys, F.struct(*values).alias("__old"))
    return a.join(b, list(keys)).where(~F.col("__new").eqNullSafe(F.col("__old"))).select(*keys)


def non_contiguous(versions: DataFrame, keys: Sequence[str], version: str, then: Sequence[str] = ()) -> DataFrame:
    """Versions that don't follow the one before by 1, or don't start at 1; equal ones are in the order of `then`."""
    w = Window.partitionBy(*keys).orderBy(version, *then)
    return versions.withColumn("__b", F.coalesce(F.lag(version).over(w), F.lit(0))).where(F.col(version) != F.col("__b") + 1).drop("__b")


def cursor_of(*parts: Column) -> Column:
    """A cursor after a row: its key as hex of a JSON array of texts."""
    return F.lower(F.hex(F.to_json(F.array(*[p.cast("string") for p in parts]))))


def encode_cursor(parts: Sequence[str]) -> str:
    return json.dumps(list(parts), separators=(",", ":"), ensure_ascii=False).encode().hex()


def decode_cursor(cursor: str, n: int) -> list[str]:
    """The n texts of a cursor; ValueError for anything else."""
    try:
        parts = json.loads(bytes.fromhex(cursor))
    except ValueError as e:
        raise ValueError("cursor is malformed") from e
    if not isinstance(parts, list) or len(parts) != n or not all(isinstance(p, str) for p in parts):
        raise ValueError("cursor is malformed")
    return parts


def etag(*columns: str) -> Column:
    """Hash of a row's JSON, nulls shown."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def claim_order(jobs: DataFrame, at, limit: int = 1) -> DataFrame:
    """The queued jobs that may start at a time, in the order in which workers take them."""
    due = jobs.where((F.col("status") == "queued") & (F.col("scheduled_for") <= F.lit(at).cast("timestamp_ntz")))
    return due.orderBy("scheduled_for", "created_at", "job_id").limit(limit)


def assertion_sequences(incoming: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str], sequence: str) -> DataFrame:
    """incoming numbered by key in an order, on from the highest number that is there."""
    last = existing.groupBy(*keys).agg(F.max(sequence).alias("__last"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return incoming.join(last, list(keys), "left").withColumn(sequence, (F.coalesce("__last", F.lit(0)) + number).cast("long")).drop("__last")


def stale(observed: Column, as_of, minutes: int = 5) -> Column:
    """Whether the newest evidence is older than some minutes at a time; without evidence it is."""
    return F.coalesce(observed < F.lit(as_of).cast("timestamp_ntz") - F.make_interval(mins=F.lit(minutes)), F.lit(True))


def metric(*columns: str) -> Column:
    """The first of the columns, as text, that has a value; an empty text is none."""
    return F.coalesce(*[F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in columns])


def percent(share: Column) -> Column:
    return F.concat(F.format_string("%.2f", share * 100), F.lit("%"))
