"""Versioned Parquet tables in a folder: readers see the last whole version, whatever is lost while the next one is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, top: str) -> list[int]:
    """The whole versions of a table, oldest first."""
    path, fs = _path(spark, top)
    if not fs.exists(path):
        return []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().removeprefix("version=")) for p in names if fs.exists(done(p, "_SUCCESS")))


def read(spark: SparkSession, top: str, version: int, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{top}/version={version}")


def latest(spark: SparkSession, top: str, schema) -> DataFrame:
    """The last whole version; empty if there is none."""
    known = versions(spark, top)
    return read(spark, top, known[-1], schema) if known else spark.createDataFrame([], schema)


def write(rows: DataFrame, top: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{top}/version={version}")


def delete(spark: SparkSession, place: str) -> None:
    path, fs = _path(spark, place)
    fs.delete(path, True)


def expire(spark: SparkSession, top: str, keep: int = 2) -> None:
    """Only the last versions stay; readers of the one before the last may still be at work."""
    for version in versions(spark, top)[:-keep]:
        delete(spark, f"{top}/version={version}")


def move(spark: SparkSession, place: str, to: str) -> bool:
    path, fs = _path(spark, place)
    return bool(fs.exists(path) and fs.rename(path, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)))


def read_text(spark: SparkSession, place: str) -> str | None:
    """A small file; None if it is absent."""
    path, fs = _path(spark, place)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def write_text(spark: SparkSession, place: str, text: str) -> None:
    """Written beside and moved, so that readers see the old or the new one."""
    path, fs = _path(spark, place)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}.new")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(path, False)
    fs.rename(beside, path)
