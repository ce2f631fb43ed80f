"""Incremental ingestion: file streams and stores with a watermark, merged idempotently batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import ledger
from ledgerloom.schema import ENTRIES
from ledgerloom.sources import folders, lines

_RAW = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, source: str, max_files: int = 200) -> DataFrame:
    """New log files as a stream of file_key, stem, content, for logs that are complete when they arrive.

    A file stream takes a path once; logs that grow are followed by `UsageLedger.watch`, whose manifest knows how far each was read.
    """
    raw = spark.readStream.format("binaryFile").schema(_RAW).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").option("maxFilesPerTrigger", max_files).load(root)
    from ledgerloom.functions import scalars as S

    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.jsonl$", "")
    return raw.select(S.hash_parts(F.lit(source), stem).alias("file_key"), stem.alias("stem"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Parts that a streamed ledger is kept in; a batch rewrites those that it has facts for.
BUCKETS = 32
_COMMITS = "kind string, name string, at long"


def merge_batch(spark: SparkSession, path: str, entries: DataFrame, batch: int, query: str = "") -> None:
    """Merge a batch of facts of a query into the ledger at `path`; running a batch of that query again changes nothing.

    Facts are kept in hash buckets. A batch writes those that it touches anew, and then a commit that says which version of each bucket
    counts and how far each query has come; so a lost executor or driver leaves the last commit, and other queries' batches are kept.
    """
    known = folders.versions(spark, f"{path}/commits")
    at, done = _commit(spark, path)
    if done.get(query, -1) >= batch:
        return
    bucket = F.pmod(F.xxhash64("source", "dedup_key"), F.lit(BUCKETS)).cast("int")
    fresh = entries.select(*ENTRIES.names).withColumn("_bucket", bucket).persist()
    touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most BUCKETS
    version = (known[-1] if known else -1) + 1
    if touched:
        old = _buckets(spark, path, {b: v for b, v in at.items() if b in touched})
        ledger.deduplicate(old.unionByName(fresh.drop("_bucket"))).withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/version={version}")
    at |= dict.fromkeys(touched, version)
    done[query] = batch
    rows = [("bucket", str(b), v) for b, v in at.items()] + [("query", q, n) for q, n in done.items()]
    folders.write(spark.createDataFrame(rows, _COMMITS), f"{path}/commits", version)
    fresh.unpersist()
    folders.expire(spark, f"{path}/commits")
    needed = {v for c in folders.versions(spark, f"{path}/commits") for v in _commit(spark, path, c)[0].values()}
    for v in folders.versions(spark, f"{path}/data"):
        if v not in needed:
            folders.delete(spark, f"{path}/data/version={v}")


def _commit(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict[int, int], dict[str, int]]:
    """(version of each bucket, last batch of each query)."""
    top = f"{path}/commits"
    rows = (folders.latest(spark, top, _COMMITS) if version is None else folders.read(spark, top, version, _COMMITS)).collect()  # a row a bucket and query
    return {int(r.name): r.at for r in rows if r.kind == "bucket"}, {r.name: r.at for r in rows if r.kind == "query"}


def _buckets(spark: SparkSession, path: str, at: dict[int, int]) -> DataFrame:
    places = [f"{path}/data/version={v}/_bucket={b}" for b, v in sorted(at.items())]
    return spark.read.schema(ENTRIES).parquet(*places) if places else spark.createDataFrame([], ENTRIES)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The facts of the last commit."""
    return _buckets(spark, path, _commit(spark, path)[0])


def ingest(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that parses arriving files and merges their facts; `parse` maps json lines to ledger entries. One run takes all there is.

    The checkpoint names the query: another one may write to the same ledger.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        merge_batch(spark, path, parse(lines.json_lines(df)), number, checkpoint)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def since_watermark(rows: DataFrame, watermark_ms: int, seen: DataFrame | None = None) -> DataFrame:
    """Rows at or after the watermark that were not seen; older rows are never revisited."""
    new = rows.where(F.col("time_created") >= watermark_ms)
    return new if seen is None else ledger.unseen(new, seen)


def advance(rows: DataFrame, watermark_ms: int) -> int:
    """The next watermark: the latest time among all rows read, skipped ones included."""
    return max(watermark_ms, rows.agg(F.max("time_created")).first()[0] or 0)


_STATE = T.StructType([T.StructField("remaining_percent", T.IntegerType())])


def change_only_stream(events: DataFrame) -> DataFrame:
    """A stream of quota points without those that repeat their series' value; one small number of state a series.

    Points are put in order within a batch; one that comes in a later batch than its successors is compared with the last value kept.
    """
    import pandas as pd

    series = ["provider", "identity", "kind", "window_id"]

    def keep(key, batches, state):
        known = state.get[0] if state.exists else None
        parts = list(batches)  # the points of one series in one batch
        points = pd.concat(parts).sort_values("observed_at", kind="stable") if parts else None
        if points is None or points.empty:
            return
        before = points["remaining_percent"].shift(1)
        before.iloc[0] = float("nan") if known is None else known
        new = points[points["remaining_percent"] != before]
        state.update((int(points["remaining_percent"].iloc[-1]),))
        yield pd.DataFrame({**dict(zip(series, key, strict=True)), "remaining_percent": new["remaining_percent"].astype(int), "observed_at": new["observed_at"]})

    schema = "provider string, identity string, kind string, window_id string, remaining_percent int, observed_at timestamp"
    return events.groupBy(*series).applyInPandasWithState(keep, schema, _STATE, "append", "NoTimeout")
