"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment (operator 1).

Shingles are compared by their 64-bit hashes, so containment is exact up to collisions of these.

Only DataFrame functions. Documents are not sketched: an item's MinHash values are shingles of the item, so they are looked up
among all shingles of a document, which makes short items findable in documents of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import stored, unused

#: Words of a shingle (an item with fewer is one shingle of its own length), and the part of an item that must be found.
SHINGLE, CONTAINMENT = 5, 0.75
#: Rows up to which a table of found documents, and of the item shingles of one pass, is broadcast (16 to 40 bytes each). More items
#: take more passes; an item alone larger than a pass, and more found documents, are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: What separates words: everything but letters and digits, so case and punctuation do not hide an item.
SEPARATOR = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR)
    return F.transform(F.array(cut), lambda w: F.slice(w, F.when(F.get(w, F.lit(0)) == "", 2).otherwise(1), F.greatest(F.lit(0), F.size(w) - F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0))))[0]


def runs(w: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def short_runs(w: Column, n: int) -> Column:
    """Hashes of all runs of n words, told apart from the runs of SHINGLE words."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.lit("short"), F.lit(n), F.slice(w, i + 1, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))


def item_shingles(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(_item, _length, _h, _n, _sketch): distinct shingles of each item, how many it has, and which are its MinHash values.

    Items are partitioned by size, each class up to twice the size of the one before. An item takes the k shingles of smallest
    second hash, with the k of its class: so many that a document without any of them cannot hold CONTAINMENT of the item.
    """
    w = benchmark.select(F.col(item_id).alias("_item"), words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    short = F.xxhash64(F.lit("short"), F.size("_w"), "_w")
    hashed = w.select("_item", F.least(F.size("_w"), F.lit(SHINGLE)).alias("_length"), F.explode(F.when(F.size("_w") < SHINGLE, F.array(short)).otherwise(runs(F.col("_w"), SHINGLE))).alias("_h")).distinct()
    n = F.count("*").over(Window.partitionBy("_item"))
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.xxhash64("_h", F.lit(1)), "_h"))
    largest = F.pow(F.lit(2), F.floor(F.log2(F.col("_n"))) + 1) - 1  # of the class
    k = largest - F.ceil(largest * CONTAINMENT) + 1
    return hashed.withColumns({"_n": n, "_rank": rank}).withColumn("_sketch", F.col("_rank") <= k).drop("_rank")


def document_shingles(documents: DataFrame, lengths: list[int]) -> DataFrame:
    """(_doc, _h) of rows (_doc, _text): runs of SHINGLE words, and of fewer only where items are that short."""
    w = documents.select("_doc", words(F.col("_text")).alias("_w"))
    found = runs(F.col("_w"), SHINGLE)
    for n in lengths:
        if n < SHINGLE:
            found = F.concat(found, short_runs(F.col("_w"), n))
    return w.select("_doc", F.explode(found).alias("_h"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _held(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(_doc, _item, _n, _found) of rows (_doc, _text): the items of which the texts of one _doc together hold CONTAINMENT."""
    items = stored(item_shingles(benchmark, item_id, item_text))
    total = items.count()
    docs = docs.where(F.col("_text").isNotNull())
    passes = max(1, -(-2 * total // BROADCAST_ROWS) if total > BROADCAST_ROWS else 1)  # half full, so that uneven passes fit
    of_pass = F.pmod(F.xxhash64("_item"), F.lit(passes))
    parts = [_held_items(docs, items if passes == 1 else items.where(of_pass == p)) for p in range(passes)]
    return reduce(DataFrame.unionByName, parts)


def _held_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs of `_held` of some items."""
    sizes = {r._length: r.n for r in items.groupBy("_length").agg(F.count("*").alias("n")).collect()}
    total, lengths = sum(sizes.values()), sorted(sizes)
    sketch = items.where("_sketch").select("_item", "_h")
    near = stored(document_shingles(docs, lengths).join(_bounded(sketch, total), "_h").select("_doc", "_item").distinct())
    pairs = near.count()
    chosen = near.select(F.col("_doc").alias("_near")).distinct()
    docs = docs.join(_bounded(chosen, pairs), F.col("_doc").eqNullSafe(F.col("_near")), "left_semi")
    full = _bounded(items.select("_item", "_h", "_n"), total)
    hits = document_shingles(docs, lengths).join(full, "_h").groupBy("_doc", "_item", "_n").agg(F.count_distinct("_h").alias("_found"))
    again = near.select(F.col("_doc").alias("_d"), F.col("_item").alias("_i"))
    hits = hits.where(F.col("_found") >= F.col("_n") * F.lit(CONTAINMENT))
    return hits.join(again, F.col("_doc").eqNullSafe(F.col("_d")) & F.col("_item").eqNullSafe(F.col("_i")), "left_semi")


def find_leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment of every pair in which the document holds CONTAINMENT of the item's shingles.

    Items without words, and null or empty texts, are in no pair. Rows that repeat a doc_id are one document, and so are
    those of an item and those with a null id. Neither table's other columns are read.
    """
    hits = _held(documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")), benchmark, item_id, item_text)
    return hits.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), F.col("_n").cast("long").alias("n_item"), F.col("_found").cast("long").alias("n_found"), (F.col("_found") / F.col("_n")).alias("containment"))


def remove_leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose own text does not hold CONTAINMENT of an item's shingles, with all their columns.

    Every row is judged by itself, also where ids are null or repeat: rows are told apart by id and hash of the text. Rows without a
    text stay; without documents none are returned, without items all; columns may have any name.
    """
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"))
    hits = _held(documents.select(key.alias("_doc"), F.col(text).alias("_text")), benchmark, item_id, item_text)
    name = unused("_bad", documents)
    bad = stored(hits.select(F.col("_doc").alias(name)).distinct())
    return documents.join(_bounded(bad, bad.count()), key.eqNullSafe(F.col(name)), "left_anti")
