"""Reconciliation of the ledger with an external rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators.metrics import total_tokens

KEYS = ["day", "source", "model", "speed"]
_VALUES = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "requests", "cost_nanos")


def read_rollup(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Buckets of a rollup document: days are seconds since 2001."""
    shape = "struct<updatedAt:double, pricingFingerprint:string, buckets:array<struct<day:double, app:string, model:string, speed:string, inputTokens:bigint, outputTokens:bigint, cacheReadTokens:bigint, cacheCreationTokens:bigint, requestCount:bigint, costUSD:double, hasUnpricedUsage:boolean>>>"
    b = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)["buckets"]).alias("b")).select("b.*")
    rows = b.select(S.apple_day(F.col("day"), zone).alias("day"), F.lower("app").alias("source"), S.audit_model_key(F.col("model")).alias("model"), F.coalesce("speed", F.lit("standard")).alias("speed"), F.col("inputTokens").alias("input_tokens"), F.col("outputTokens").alias("output_tokens"), F.col("cacheReadTokens").alias("cache_read_tokens"), F.col("cacheCreationTokens").alias("cache_write_tokens"), F.col("requestCount").alias("requests"), S.usd_to_nanos(F.col("costUSD")).alias("cost_nanos"))
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in _VALUES])


def ledger_rollup(entries: DataFrame) -> DataFrame:
    """The ledger by day, source, audit model key and speed."""
    rows = entries.select(F.col("day_local").alias("day"), "source", S.audit_model_key(F.coalesce("model", F.lit(""))).alias("model"), "speed", (total_tokens() - F.col("output_tokens")).alias("i"), F.col("output_tokens").alias("o"), F.col("cache_read_input_tokens").alias("r"), (F.col("cache_write_5m_input_tokens") + F.col("cache_write_1h_input_tokens")).alias("w"), F.col("api_equivalent_cost_nanos").alias("c"))
    return rows.groupBy(*KEYS).agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("r").alias("cache_read_tokens"), F.sum("w").alias("cache_write_tokens"), F.count("*").alias("requests"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("cost_nanos"))


def compare(ours: DataFrame, theirs: DataFrame, keys: list[str] | None = None, values: tuple[str, ...] = _VALUES, tolerance_nanos: int = 1) -> DataFrame:
    """Full outer comparison: each key is equal, differs, only_ours or only_theirs; costs may differ by the tolerance a request."""
    keys = keys or KEYS
    a = ours.select(*keys, F.struct(*values).alias("ours"))
    b = theirs.select(*keys, F.struct(*values).alias("theirs"))
    exact = [F.col(f"ours.{v}").eqNullSafe(F.col(f"theirs.{v}")) for v in values if v != "cost_nanos"]
    same = F.lit(True)
    for e in exact:
        same = same & e
    if "cost_nanos" in values:
        same = same & (F.abs(F.col("ours.cost_nanos") - F.col("theirs.cost_nanos")) <= (tolerance_nanos * F.greatest(F.col("ours.requests"), F.lit(1)) if "requests" in values else tolerance_nanos))
    state = F.when(F.col("theirs").isNull(), "only_ours").when(F.col("ours").isNull(), "only_theirs").when(same, "equal").otherwise("differs")
    return a.join(b, keys, "full_outer").withColumn("state", state)


def common_days(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return ours.select("day").intersect(theirs.select("day"))


def all_days(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return ours.select("day").union(theirs.select("day")).distinct()


def write_report(compared: DataFrame, path: str) -> dict:
    """Write the rows that are not equal as JSON lines, and return how many rows each state has."""
    compared.where("state != 'equal'").orderBy("state", *[c for c in KEYS if c in compared.columns]).write.mode("overwrite").json(path)
    return {r.state: r.n for r in compared.groupBy("state").agg(F.count("*").alias("n")).collect()}
