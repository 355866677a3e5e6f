"""Running totals and predecessors in the order of a key, without a window over a key's whole rows.

Rows are dealt to ranges of key and order, each task scans its own, and what tasks owe one another is one row a task: only the first
key of a range can go on from the range before. A key with a third of all rows is spread like any others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.storage import stored

#: Ranges that rows are dealt to for each shuffle partition of the session.
RANGES = 1


def _local(rows: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """rows in ranges, with __part, __n (place of a row in its key's segment), before, and the segment's running totals."""
    names = list(rows.columns)
    k, o, v = names.index(key), names.index(order), [names.index(c) for c in values]
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * RANGES
    ranged = rows.repartitionByRange(tasks, key, order).sortWithinPartitions(key, order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "__part int", "__n bigint", "before bigint", *(f"`{c}_sum` bigint" for c in values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_key, last_order, held = None, 0, np.zeros(1 + len(v), np.int64)  # of the segment that may go on
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(k).dictionary_encode()
            codes, orders = keys.indices.to_numpy(zero_copy_only=False), batch.column(o).cast(pa.int64()).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = codes[1:] != codes[:-1]
            new[0] = keys.dictionary[codes[0]].as_py() != last_key
            starts = np.flatnonzero(new)
            segment = np.cumsum(new)  # 0: goes on from the batch before
            before = np.empty(n, np.int64)
            before[1:], before[0] = orders[:-1], last_order
            totals = []
            for i, x in enumerate([np.ones(n, np.int64), *(batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in v)]):
                run_up = np.cumsum(x)
                base = np.concatenate([[-held[i]], run_up[starts] - x[starts]])
                totals.append(run_up - base[segment])
            last_key, last_order = keys.dictionary[codes[-1]].as_py(), int(orders[-1])
            held = np.array([t[-1] for t in totals])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(totals[0]), pa.array(before, mask=new), *(pa.array(t) for t in totals[1:])], [*names, "__part", "__n", "before", *(f"{c}_sum" for c in values)]
            )

    return ranged.mapInArrow(run, schema)


def prefix_sums(rows: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """rows with before (the order of the row before in the key; null for the first) and a running total of each value, as {value}_sum.

    key is a text that isn't null, order and values are whole numbers. Of rows with equal key and order any may come first.
    """
    local = stored(_local(rows, key, order, values))  # both uses must see the same ranges, which are cut by a sample
    totals = [f"{c}_sum" for c in values]
    ends = local.groupBy(key, "__part").agg(F.max_by(F.struct(F.col(order).cast("long").alias("__last"), *totals), "__n").alias("e"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that the key is in
    owed = ends.select(key, "__part", F.last("e.__last").over(earlier).alias("__before"), *[F.sum(f"e.{c}").over(earlier).alias(f"__{c}") for c in totals]).where("__before IS NOT NULL")
    joined = local.join(F.broadcast(owed), [key, "__part"], "left")  # at most a row for each task
    return joined.select(*rows.columns, F.coalesce("before", "__before").alias("before"), *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in totals])
