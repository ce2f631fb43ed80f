"""Mixing sources to target weights by hash-random keys and distributed prefix sums (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import WORD, attach, stored

#: Rows for each of which the key space has one range; the keys are uniform, so a source has no more of them in a range.
RANGE_ROWS = 4_096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(_source, _size) of each source -> also _target: `share` of all sizes by weight, none above `most` times its size.

    Sources take the weights in turn, by code point, null last. Resharing the excess until none is above ends where
    target = min(most * size, level * weight); the level follows from the sources sorted by most * size / weight.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("_source").asc_nulls_last())))
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.pmod(F.col("_rank") - 1, F.lit(len(weights))) == i, F.lit(w)).otherwise(weight)
    ranked = ranked.withColumn("_weight", weight.cast("double")).withColumn("_cap", F.lit(float(most)) * F.col("_size"))
    order = everything.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("_size").over(everything)
    full = F.coalesce(F.sum("_cap").over(before), F.lit(0.0)) + F.col("_cap") / F.col("_weight") * F.sum("_weight").over(onward) <= budget
    ranked = ranked.withColumns({"_full": full, "_budget": budget})
    capped = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(everything)
    level = (F.col("_budget") - capped) / open_weight
    return ranked.select("_source", "_size", F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_weight")).alias("_target"))


def mix_sources(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size (words), source_size, target, taken (words taken, repeats counted), and `carry` columns.

    Every source's taken words sum to the integer part of its target: whole epochs for all rows, and the last epoch is cut in
    key order at the exact word. Keys are md5 of id and text, so reruns agree. Ranges of keys are summed first: what lies before the
    one in which a source's cut falls is taken whole, and only that one's keys are put in order. Rows of equal id and text are one
    key and share its words evenly, the part of a word that is left over for each being dropped. Null texts have size 0 and take 0;
    null sources are a source; an empty table gives none. Sources are expected to be few enough for one window over them.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    key = F.md5(F.concat(shown(doc_id), F.lit(b"/"), F.md5(shown(text)).cast("binary")))
    rows = documents.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"), key.alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    ranges = max(1, -(-documents.count() // RANGE_ROWS))
    rows = rows.withColumn("_range", F.floor(F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") / 16.0**12 * ranges).cast("int"))
    rows = rows if carry else stored(rows)  # ids, counts and keys only: then the texts are read once
    cells = stored(rows.groupBy("_source", "_range").agg(F.sum("size").alias("_cell")))
    targets = source_targets(cells.groupBy("_source").agg(F.sum("_cell").alias("_size")), weights, share, most)
    whole = F.floor(F.col("_target"))
    targets = targets.withColumn("_epochs", F.coalesce(F.floor(whole / F.nullif(F.col("_size"), F.lit(0))), F.lit(0)))
    targets = targets.withColumn("_rest", whole - F.col("_epochs") * F.col("_size")).withColumnRenamed("_source", "_of")
    # the range in which the rest of each source ends, and the words of the source before it
    ended = F.sum("_cell").over(Window.partitionBy("_source").orderBy("_range"))
    cells = attach(_null_safe(cells.withColumn("_ended", ended).withColumnRenamed("_source", "_of")), _null_safe(targets), ["_source", "_none"], "inner")
    last = cells.where(F.col("_ended") >= F.col("_rest")).groupBy("_source", "_none").agg(F.min_by(F.struct("_range", (F.col("_rest") - F.col("_ended") + F.col("_cell")).alias("left")), "_range").alias("_last"))
    cuts = stored(attach(_null_safe(targets), last, ["_source", "_none"]).select("_source", "_none", "_size", "_target", "_epochs", F.col("_last._range").alias("_at"), F.col("_last.left").alias("_left")))
    marked = attach(_null_safe(rows.withColumnRenamed("_source", "_of")), cuts, ["_source", "_none"])
    # within that range: words before each key, then what each row of the key gets
    cut = marked.where(F.col("_range") == F.col("_at")).groupBy("_source", "_none", "_key", "_left").agg(F.sum("size").alias("_words"), F.count("*").alias("_rows"))
    before = F.sum("_words").over(Window.partitionBy("_source", "_none").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_words")
    part = F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_left") - before))
    cut = cut.select("_source", "_none", "_key", F.floor(part / F.col("_rows")).alias("_part"))
    out = attach(marked, stored(cut), ["_source", "_none", "_key"])
    rest = F.when(F.col("_range") < F.coalesce("_at", F.lit(1 << 30)), F.col("size")).otherwise(F.coalesce("_part", F.lit(0)))
    return out.select(F.col("_id").alias(doc_id), "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_epochs") * F.col("size") + rest).cast("long").alias("taken"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def _null_safe(rows: DataFrame) -> DataFrame:
    """`_of` as two columns that equal each other also where it is null."""
    return rows.withColumns({"_source": F.coalesce(F.col("_of"), F.lit("")), "_none": F.col("_of").isNull()}).drop("_of")
