"""Sharding into equal byte sizes by Karmarkar-Karp differencing over indivisible groups (operator 2)."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import attach, stored

#: Items that one task differences, and items that the driver differences at the end: levels are added until there are so few.
BUCKET_ITEMS, LAST_ITEMS = 4096, 65_536
#: Items, evenly chosen by size, that all buckets of a level together hand on as they are, and a bucket at most: they even out the rest.
SINGLES, SINGLES_OF_BUCKET = 16384, 512
#: Rows of a text from which its shard is attached to them without bringing them together.
MANY_COPIES = 1000
#: Rows of one window that numbers slots.
SLOT_ROWS = 20_000


def karmarkar_karp(sizes: Iterable[int], k: int) -> list[int]:
    """The part (0 to k-1) of each item.

    Each item starts as a partial partition (itself, 0, ..., 0). The two partitions with the largest spread are combined,
    the largest part of one with the smallest of the other, until one is left; ties go to the earlier partition.
    Parts are numbered by falling sum.
    """
    sizes = list(sizes)
    if not sizes or k < 2:
        return [0] * len(sizes)
    left: list[int] = []
    right: list[int] = []
    n = len(sizes)
    heap = [(-s, i, ((s, i),)) for i, s in enumerate(sizes)]  # only the filled parts, largest first
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        if len(b) <= free:
            merged = [*a, *b]
        else:
            merged = [*a, *b[:free]] if free else list(a)
            for x, (s, node) in zip(range(len(a) - 1, -1, -1), b[free:], strict=False):
                left.append(merged[x][1])
                right.append(node)
                merged[x] = (merged[x][0] + s, n + len(left) - 1)
        merged.sort(key=lambda p: (-p[0], p[1]))
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, tuple(merged)))
        serial += 1
    out = [0] * n
    for part, (_, root) in enumerate(heap[0][2]):
        stack = [root]
        while stack:
            node = stack.pop()
            if node < n:
                out[node] = part
            else:
                stack += (left[node - n], right[node - n])
    return out


def difference_level(items: DataFrame, count: int, shards: int, large: int) -> DataFrame:
    """(_item, _bytes) -> (_item, _bytes, _to): differencing within hash buckets of bounded size, `_to` names the part.

    Items of more than `large` bytes are parts by themselves, and so are a bucket's evenly chosen singles. A bucket makes 64 parts
    where few buckets are, so that the last level has enough to even out, and one a shard otherwise.
    """
    buckets = max(1, -(-count // BUCKET_ITEMS))
    parts = shards * (4 if buckets < 64 else 1)
    singles = max(2, min(SINGLES_OF_BUCKET, SINGLES // buckets))

    def difference(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_bytes", "_item"], ascending=[False, True], ignore_index=True)
        alone = (pdf.index % max(1, len(pdf) // singles) == 0) | (pdf["_bytes"].to_numpy() > large)
        part = np.zeros(len(pdf), np.int64)
        part[~alone] = karmarkar_karp(pdf.loc[~alone, "_bytes"].tolist(), parts)
        part[alone] = parts + np.arange(alone.sum())
        return pd.DataFrame({"_item": pdf["_item"], "_bytes": pdf["_bytes"], "_to": [f"{b}/{p}" for b, p in zip(pdf["_bucket"], part, strict=True)]})

    dealt = items.withColumn("_bucket", F.pmod(F.xxhash64("_item"), F.lit(buckets)).cast("int"))
    return stored(dealt.groupBy("_bucket").applyInPandas(difference, "_item string, _bytes long, _to string"))


def shards_of(groups: DataFrame, count: int, shards: int, large: int) -> DataFrame:
    """(_item, shard) of the `count` groups (_item, _bytes): levels of differencing, until the driver can difference what is left."""
    levels, items = [], groups
    while True:
        levels.append(difference_level(items, count, shards, large))
        items = stored(levels[-1].groupBy(F.col("_to").alias("_item")).agg(F.sum("_bytes").alias("_bytes")))
        before, count = count, items.count()
        if count <= LAST_ITEMS or 2 * count > before:
            break
    last = items.orderBy(F.desc("_bytes"), "_item").collect()  # at most LAST_ITEMS, or groups of which few are not large
    chosen = karmarkar_karp([x["_bytes"] for x in last], shards)
    placed = groups.sparkSession.createDataFrame([(x["_item"], s) for x, s in zip(last, chosen, strict=True)], "_to string, shard int")
    for level in reversed(levels):
        placed = attach(level, placed, ["_to"], "inner").select("_item", "shard")
        placed = placed if level is levels[0] else placed.withColumnRenamed("_item", "_to")
    return placed


def shard_documents(documents: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot. Rows of equal text stay in one shard.

    Size is the UTF-8 length plus 1; null texts have length 0 and form one group, and a null id is an id like others; an empty table gives
    none. Buckets of about BUCKET_ITEMS groups are differenced in parallel into parts, these again, until LAST_ITEMS are left, which the
    driver differences: never rows or all groups. Groups of more than an eighth of a shard, of which there are few, are always among
    those. Copies are counted before any shuffle, and no join or window brings the copies of a text together.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    group = F.when(F.col(text).isNull(), F.lit("")).otherwise(F.md5(content.cast("binary")))
    rows = stored(documents.select(F.col(doc_id).alias("_id"), group.alias("_group"), (F.octet_length(content) + F.lit(1)).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row")))
    groups = stored(rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")))
    total = groups.agg(F.count("*").alias("n"), F.sum("_bytes").alias("bytes"), F.sum("_rows").alias("rows")).first()
    by_group = shards_of(groups.select(F.col("_group").alias("_item"), "_bytes"), total.n, shards, (total.bytes or 0) // (8 * shards)).withColumnRenamed("_item", "_group")
    many = stored(groups.where(F.col("_rows") >= MANY_COPIES).select("_group").join(by_group, "_group"))
    if many.isEmpty():
        out = rows.join(by_group, "_group")
    else:
        marked = attach(rows, many, ["_group"])
        out = marked.where("shard IS NOT NULL").unionByName(marked.where("shard IS NULL").drop("shard").join(by_group, "_group"))
    return with_slots(out, total.rows or 0, shards).select(F.col("_id").alias(doc_id), "size", "text_crc32", "shard", "slot")


def with_slots(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """Adds a gapless slot from 0 within each shard: rows are dealt over hash cells whose counts give the offsets."""
    cells = max(1, -(-count // (SLOT_ROWS * shards)))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64("_id", "_group", "_row"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    offsets = counts.select("shard", "_cell", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("_n")).alias("_offset"))
    numbered = rows.withColumn("_in_cell", F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_id", "_group", "_row")))
    return attach(numbered, offsets, ["shard", "_cell"], "inner", cells * shards).withColumn("slot", F.col("_offset") + F.col("_in_cell") - 1)
