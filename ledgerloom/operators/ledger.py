"""The ledger: union, deduplication, conversation merge, reset and rebuild."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.metrics import total_tokens
from ledgerloom.schema import CATALOG_SOURCES, CONVERSATION_FACTS, ENTRIES


def union_entries(*parts: DataFrame) -> DataFrame:
    """Facts of all sources in one ledger."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*ENTRIES.names) for p in parts])


def deduplicate(entries: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One fact per (source, dedup_key): of catalog-priced sources the largest in tokens, ties to the first; of the others the last.

    `order` are the columns that say what came first (`seq`). The two rules share one window, as a key has one source; its group limit
    drops most rows before the shuffle.
    """
    priced = F.col("source").isin(*CATALOG_SOURCES)
    seq = F.struct(*(order or ["seq"]))
    first = Window.partitionBy("source", "dedup_key").orderBy(F.when(priced, total_tokens()).desc(), F.when(priced, seq).asc(), F.when(~priced, seq).desc())
    return entries.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def insert_counters(entries: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """inserted (new facts and accepted updates) and duplicates, as a row-by-row upsert in `seq` order would count them."""
    rows = entries.withColumn("_old", F.lit(False))
    if existing is not None:
        rows = rows.unionByName(existing.select(*entries.columns).withColumn("_old", F.lit(True)))
    order = Window.partitionBy("source", "dedup_key").orderBy(F.desc("_old"), "seq")
    before = F.max("_t").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_t", total_tokens()).withColumn("_before", before)
    accepted = F.col("_before").isNull() | ~F.col("source").isin(*CATALOG_SOURCES) | (F.col("_t") > F.col("_before"))
    n = F.count(F.when(accepted & ~F.col("_old"), 1))
    return rows.agg(n.alias("inserted"), (F.count(F.when(~F.col("_old"), 1)) - n).alias("duplicates"))


def _latest(c: str, seq: Column) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c)


def merge_conversations(facts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per conversation from all parsed facts, rejected duplicates included.

    The latest non-null title, project, source id and branch win; a side chain once is one for ever; times span all facts.
    """
    seq = F.struct(*(order or ["seq"]))
    return facts.groupBy("conversation_key").agg(
        F.min_by("source", seq).alias("source"), _latest("title", seq), _latest("project_hint", seq), _latest("source_id", seq), _latest("branch", seq),
        F.max("is_sidechain").alias("is_sidechain"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"),
    )


def conversations_as_facts(conversations: DataFrame) -> DataFrame:
    """Known conversations as what two facts before all others said, so that new facts are merged into them."""
    ends = conversations.withColumn("occurred_at", F.explode(F.array("first_at", "last_at")))
    return ends.withColumn("seq", F.lit("")).select(*CONVERSATION_FACTS.names)


def without_orphans(conversations: DataFrame, entries: DataFrame) -> DataFrame:
    """Conversations that still have a fact."""
    return conversations.join(entries.select("conversation_key").distinct(), "conversation_key", "left_semi")


def orphans(conversations: DataFrame, entries: DataFrame) -> DataFrame:
    return conversations.join(entries.select("conversation_key").distinct(), "conversation_key", "left_anti")


def reset_files(entries: DataFrame, file_keys: DataFrame) -> DataFrame:
    """The ledger without the facts of rewritten files."""
    return entries.join(file_keys.select("file_key").distinct(), "file_key", "left_anti")


def rebuild(entries: DataFrame, sources: list[str] | None) -> DataFrame:
    """The ledger without the facts of some sources (of all, if none are named)."""
    return entries.where(~F.col("source").isin(*sources)) if sources else entries.limit(0)


def unseen(rows: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id was not seen in earlier scans, each once."""
    return rows.join(seen.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def valid_entries(entries: DataFrame) -> DataFrame:
    """Facts that the ledger accepts: known source, a key, no negative count, reasoning within output."""
    from ledgerloom.schema import SOURCES, TOKENS

    ok = F.col("source").isin(*SOURCES) & F.col("dedup_key").isNotNull() & F.col("conversation_key").isNotNull() & F.col("occurred_at").isNotNull()
    for c in TOKENS:
        ok = ok & (F.col(c) >= 0)
    return entries.where(ok & (F.col("reasoning_output_tokens") <= F.col("output_tokens")))
