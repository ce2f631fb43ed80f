"""The measures that summaries, conversations and breakdowns share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.schema import TOKENS

SUMS = ("entries", *TOKENS, "fast_raw_tokens", "fast_billing_nanos", "unpriced_fast", "cost_nanos", "priced", "unpriced", "assumed_geo")
#: Sums of nanos pass 63 bits first: they are added as wide decimals and kept whole under these names. Under its own name, a long, a total beyond 63 bits is null.
WIDE = {"fast_billing_nanos": "fast_billing_nanos_exact", "cost_nanos": "cost_nanos_exact"}
MEASURES = (*SUMS, "fast_multiplier_min", "fast_multiplier_max", "pricing_fingerprint")


def total_tokens() -> Column:
    return sum((F.col(c) for c in TOKENS[1:5]), F.col(TOKENS[0]))


def _wide(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("decimal(19,0)")), F.lit(0))


def _summed() -> list[Column]:
    """SUMS over rows that have them already, those of WIDE from the exact ones."""
    return [_wide_total(c).try_cast("long").alias(c) if c in WIDE else F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS]


def _wide_total(c: str) -> Column:
    return F.coalesce(F.sum(F.col(WIDE[c]).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")


def _exact_totals() -> list[Column]:
    return [_wide_total(c).alias(n) for c, n in WIDE.items()]


def _partial() -> list[Column]:
    """Aggregates over facts, all of fixed width, so they are hashed and combined before the shuffle."""
    fast, cost = F.col("speed") == "fast", F.col("api_equivalent_cost_nanos")
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count("*").alias("entries"),
        *[add(F.col(c)).alias(c) for c in TOKENS],
        add(F.when(fast, total_tokens())).alias("fast_raw_tokens"),
        _wide(F.when(fast, F.col("billing_equivalent_tokens_nanos"))).alias(WIDE["fast_billing_nanos"]),
        add(F.when(fast & F.col("billing_equivalent_tokens_nanos").isNull(), 1)).alias("unpriced_fast"),
        _wide(cost).alias(WIDE["cost_nanos"]),
        F.count(cost).alias("priced"),
        add(F.when(cost.isNull(), 1)).alias("unpriced"),
        add(F.when((F.col("source") == "claude") & (F.col("inference_geo") == "unknown") & cost.isNotNull(), 1)).alias("assumed_geo"),
        F.min(F.when(fast, F.col("fast_multiplier_nanos"))).alias("fast_multiplier_min"),
        F.max(F.when(fast, F.col("fast_multiplier_nanos"))).alias("fast_multiplier_max"),
    ]


def _final() -> list[Column]:
    """The same over partial rows of one fingerprint each; a group's fingerprint is that of all its priced rows, or null."""
    print_ = F.col("pricing_fingerprint")
    return [
        *_summed(),
        F.min("fast_multiplier_min").alias("fast_multiplier_min"),
        F.max("fast_multiplier_max").alias("fast_multiplier_max"),
        F.when(F.min(print_) == F.max(print_), F.max(print_)).alias("pricing_fingerprint"),
        *_exact_totals(),
    ]


def measured(facts: DataFrame, **keys: Column) -> DataFrame:
    """One row per group of the named keys with all measures.

    Facts are first grouped with the fingerprint as a key: text among the aggregates would make Spark sort all facts.
    """
    first = facts.groupBy(*[c.alias(n) for n, c in keys.items()], "pricing_fingerprint").agg(*_partial())
    return first.groupBy(*keys).agg(*_final())


def measured_sets(facts: DataFrame, sets: list[list[str]], **keys: Column) -> tuple[DataFrame, list[Column]]:
    """(grouping sets over rows that are already grouped by all keys, the aggregates to apply)."""
    first = facts.groupBy(*[c.alias(n) for n, c in keys.items()], "pricing_fingerprint").agg(*_partial())
    return first.groupingSets(sets, *keys), _final()


def grand_total(groups: DataFrame) -> DataFrame:
    """Totals of summary rows; the fingerprint is null if any priced group lacks one or they differ."""
    lacking = F.sum(F.when((F.col("priced") > 0) & F.col("pricing_fingerprint").isNull(), 1))
    print_ = F.col("pricing_fingerprint")
    return groups.agg(
        *_summed(),
        F.min("fast_multiplier_min").alias("fast_multiplier_min"),
        F.max("fast_multiplier_max").alias("fast_multiplier_max"),
        F.when(F.coalesce(lacking, F.lit(0)).eqNullSafe(0) & (F.min(print_) == F.max(print_)), F.max(print_)).alias("pricing_fingerprint"),
        *_exact_totals(),
    )


def presented(rows: DataFrame) -> DataFrame:
    """Adds what readers see: input and total tokens, decimal texts, and the flag of unpriced fast use."""
    given = sum((F.col(c) for c in TOKENS[1:4]), F.col(TOKENS[0]))
    return rows.withColumns({
        "input_tokens": given,
        "total_tokens": given + F.col("output_tokens"),
        "fast_billing_tokens": S.nanos_to_text(F.col(WIDE["fast_billing_nanos"])),
        "fast_multiplier_min_text": S.nanos_to_text(F.col("fast_multiplier_min")),
        "fast_multiplier_max_text": S.nanos_to_text(F.col("fast_multiplier_max")),
        "cost_usd": S.nanos_to_text(F.col(WIDE["cost_nanos"])),
        "has_unpriced_equivalent": F.col("unpriced_fast") > 0,
    })


def wire_names(rows: DataFrame) -> DataFrame:
    """Columns in camel case, as readers of JSON expect them."""
    return rows.toDF(*[w[0] + "".join(p.title() for p in w[1:]) for w in (c.split("_") for c in rows.columns)])


def cache_rates() -> dict[str, Column]:
    """The three rates in use, of input (exact and rounded) and of all tokens (rounded), in percent and at most 100; null of nothing."""
    given = sum((F.col(c) for c in TOKENS[1:4]), F.col(TOKENS[0]))
    share = lambda of: F.when(of > 0, F.least(F.lit(100.0), F.col("cache_read_input_tokens") * 100.0 / of))
    return {"cache_rate_of_input": share(given), "cache_rate_of_input_rounded": F.round(share(given)).cast("int"), "cache_rate_of_total_rounded": F.round(share(given + F.col("output_tokens"))).cast("int")}
