"""What the corpus operators share: table access, shared storage and byte-level text helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a table that may be broadcast after they were counted.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared one that the session names; only a local master may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/checkpoints/corvane"
    return f"{root.rstrip('/')}/corvane-{uuid.uuid4().hex}"


def on_exit(spark: SparkSession, path: str) -> str:
    """Has a folder deleted when the session's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Writes df to shared storage and reads it back: cuts lineage and survives lost executors.

    Without a path the table is kept for as long as the session's JVM lives.
    """
    kept = path is None
    path = path or shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    if kept:
        on_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in a shared folder of its own, which are deleted once spent.

    What is returned beyond the with block must not read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, shared_dir(spark), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def stored(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.count += 1
        return stored(df, f"{self.root}/{self.count}", compression)

    def mark(self) -> int:
        return self.count

    def spent(self, after: int, upto: int) -> None:
        """Deletes the tables stored after one mark, up to another."""
        for k in range(max(0, after) + 1, upto + 1):
            self._delete(f"{self.root}/{k}")


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if its counted rows are within limit; else it joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


#: Bits of a sieve at most; a bitmap of Spark has so many.
SIEVE_BITS, BITMAP_BITS = 1 << 27, 8 * 4096


def sieved(df: DataFrame, column: str, ids: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose id may be among `ids` (one column, `rows` of them), and rows whose id surely isn't.

    A bitmap of hashed ids is broadcast: 16 bits for each id, at most 16 MB in all, beyond which it only lets
    more through. Rows that pass still need their join; the others are spared the shuffle. Null ids pass.
    """
    bits = max(BITMAP_BITS, min(SIEVE_BITS, 1 << (16 * max(1, rows) - 1).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    number = lambda c: F.floor(at(c) / F.lit(BITMAP_BITS)).cast("long")
    name = ids.columns[0]
    maps = ids.select(number(F.col(name)).alias("__map"), F.pmod(at(F.col(name)), F.lit(BITMAP_BITS)).alias("__bit"))
    maps = stored(maps.groupBy("__map").agg(F.bitmap_construct_agg("__bit").alias("__bits")))  # bits / 32768 rows of 4 KB
    place = F.pmod(at(F.col(column)), F.lit(BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), place % 8)) != 0, F.lit(False)) | F.col(column).isNull()
    joined = df.withColumn("__map", number(F.col(column))).join(F.broadcast(maps), "__map", "left")
    return joined.where(hit).select(*df.columns), joined.where(~hit).select(*df.columns)


def n_words(text) -> F.Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the offset of each row and of the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Prefixes:
    """Prefix sums of a polynomial over bytes, from which the hash of any byte range follows by one subtraction."""

    BASE = 0x5851F42D4C957F2D
    BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    _up = _down = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) < n + 1:
            size = max(n + 1, 1 << 20)
            inverse = pow(cls.BASE, -1, 1 << 64)
            tables = []
            for base in (cls.BASE, inverse):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                tables.append(np.multiply.accumulate(p))
            if size > 1 << 24:  # of a very long text: not kept
                return tables[0], tables[1]
            cls._up, cls._down = tables
        return cls._up, cls._down

    def __init__(self, data: np.ndarray):
        up, self.down = self._powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of the rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
