"""The ledger's columns over the star-schema tables, for queries that run without log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schema import CATALOG

SOURCES = {"A": "codex", "N": "claude", "R": "pi"}
#: Brands with a price: every brand whose number is divisible by 5 has none.
BRANDS = [n for n in range(1, 26) if n % 5]
SPLIT = "1998-01-01 00:00:00"
FINGERPRINT = "demo-catalog"
ORDER = ["occurred_at", "file_key", "model", "uncached_input_tokens", "cache_read_input_tokens", "cache_write_5m_input_tokens", "output_tokens"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_rows() -> list[tuple]:
    """Invented prices: two dated periods a brand and speed, a later fallback for all brands, long requests of some dearer or unpriced."""
    rows = []
    for n in BRANDS:
        for source in ("codex", "claude"):
            for speed, k in (("standard", 1), ("fast", 2)):
                base = (n * 7 % 13 + 1) * 100_000_000 * k
                threshold = 60_000 if n % 3 == 0 else None
                for since, until, rise in ((None, SPLIT, 1), (SPLIT, None, 2)):
                    rows.append((source, f"brand#{n}", speed, since, until, base * rise, base * rise // 10, base * rise * 5 // 4, base * rise * 2, base * rise * 5, 11_000 if n % 2 else 10_000, threshold, 20_000, 15_000, n % 2 == 1 or threshold is None, 0))
                rows.append((source, f"brand#{n}", speed, None, None, base * 9, base, base, base, base * 9, 10_000, None, 10_000, 10_000, True, 2))
    return rows


def catalog(spark: SparkSession) -> DataFrame:
    from ledgerloom.sources.catalog import local_rows

    iso = lambda t: t and t.replace(" ", "T") + "Z"
    return local_rows(spark, [(*r[:3], iso(r[3]), iso(r[4]), *r[5:]) for r in catalog_rows()], CATALOG)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts before deduplication, without prices."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    whole = lambda c: F.round(c).cast("long")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    source = F.when(F.col("l_returnflag") == "A", "codex").when(F.col("l_returnflag") == "N", "claude").otherwise("pi")
    geo = F.when(F.col("l_linenumber") % 3 == 0, "us").when(F.col("l_linenumber") % 3 == 1, "global").otherwise("unknown")
    null = F.lit(None)
    return rows.select(
        F.col("l_suppkey").cast("string").alias("file_key"), source.alias("source"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("dedup_key"), F.col("l_orderkey").cast("string").alias("conversation_key"),
        F.col("p_brand").alias("model"), F.when(F.col("l_linestatus") == "F", "fast").otherwise("standard").alias("speed"), geo.alias("inference_geo"), F.col("l_shipdate").cast("timestamp").alias("occurred_at"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day_local"),
        whole(F.col("l_quantity")).alias("uncached_input_tokens"), whole(F.col("l_discount") * 100).alias("cache_read_input_tokens"), whole(F.col("l_tax") * 100).alias("cache_write_5m_input_tokens"), F.when(source == "claude", F.col("l_linenumber")).otherwise(F.lit(0)).cast("long").alias("cache_write_1h_input_tokens"),
        whole(F.col("l_extendedprice")).alias("output_tokens"), F.floor(whole(F.col("l_extendedprice")) / 2).cast("long").alias("reasoning_output_tokens"),
        F.when(source == "pi", F.col("l_linenumber") * 1000).cast("long").alias("api_equivalent_cost_nanos"), null.cast("long").alias("billing_equivalent_tokens_nanos"), null.cast("long").alias("fast_multiplier_nanos"), null.cast("string").alias("pricing_fingerprint"),
    )


def conversation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_key, title, project_hint) of the orders."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").cast("string").alias("conversation_key"), F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("project_hint"))


def quota_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("provider"), F.col("user_id").cast("string").alias("identity"), F.lit("five_hour").alias("kind"), F.lit("five_hour").alias("window_id"), (F.lit(100.0) - F.col("value")).alias("remaining"), F.col("ts").cast("timestamp").alias("observed_at"), "event_id")
