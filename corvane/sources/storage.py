"""Tables and small files in shared storage, through the session's Hadoop file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the one that spark.checkpoint.dir names, gone when the session's JVM ends; only a local master may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/checkpoints/corvane"
    path = f"{root.rstrip('/')}/corvane-{uuid.uuid4().hex}"
    at, files = _at(spark, path)
    files.deleteOnExit(at)
    return path


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df to shared storage and reads it back: cuts lineage and survives lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file if there is none by that name: of several writers one gets True, the others False."""
    at, files = _at(spark, path)
    files.mkdirs(at.getParent())
    try:
        out = files.create(at, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    at, files = _at(spark, path)
    if not files.exists(at):
        return None
    raw = files.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(raw)).decode()
    finally:
        raw.close()


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    at, files = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)
