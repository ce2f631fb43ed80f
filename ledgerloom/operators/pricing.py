"""Exact prices of facts from a ranked, dated catalog, without a shuffle of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.schema import CATALOG_SOURCES, PRICE_COLUMNS, RATES, TOKENS

#: Fixed value: fast requests of one source with more input than this have no price.
FAST_INPUT_LIMIT = 272_000
#: Nanos per million tokens, times two basis-point multipliers.
_DIVISOR = 10**14
#: Billing multipliers of fast requests, in nanos.
FAST_MULTIPLIERS = {
    "codex": {"gpt-5.6": 2_500_000_000, "gpt-5.6-sol": 2_500_000_000, "gpt-5.6-terra": 2_500_000_000, "gpt-5.6-luna": 2_500_000_000, "gpt-5.5": 2_500_000_000, "gpt-5.5-codex": 2_500_000_000, "gpt-5.4": 2_000_000_000, "gpt-5.4-codex": 2_000_000_000},
    "claude": {"claude-opus-5": 2_000_000_000, "claude-opus-4-8": 2_000_000_000, "claude-opus-4-7": 6_000_000_000, "claude-opus-4-6": 6_000_000_000},
}
POLICY_VERSION = 2


def ranked(catalog: DataFrame) -> DataFrame:
    """One row per source, speed and model prefix with its catalog rows in order of precedence."""
    entry = F.struct("priority", (-F.length("model_prefix")).alias("_shorter"), "model_prefix", "effective_from", "effective_until", *RATES, "us_bps", "long_threshold", "long_input_bps", "long_output_bps", "long_priced")
    return catalog.groupBy(F.col("source").alias("_source"), F.col("speed").alias("_speed"), F.col("model_prefix").alias("_prefix")).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))


def undated(model: Column) -> Column:
    """The model without a calendar date at its end; null where there is none."""
    base = F.regexp_replace(model, r"-(?:\d{4}-\d{2}-\d{2}|\d{8})$", "")
    may_be = (F.substring(model, -9, 1) == "-") | (F.substring(model, -11, 1) == "-")
    return F.when(may_be & (base != model) & S.model_matches(model, base), base)


def with_entries(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds `_entries`, in order of precedence, of the catalog rows whose prefix is `_model`, or is it without a date.

    Both are equality joins with the catalog, which Spark broadcasts where its size allows.
    """
    known = ranked(catalog)
    rows = rows.withColumn("_base", undated(F.col("_model")))
    for key, name in (("_model", "_exact"), ("_base", "_dated")):
        named = known.select(*[F.col(c).alias(f"{name}{c}") for c in known.columns])
        rows = rows.join(named, (F.col("source") == F.col(f"{name}_source")) & (F.col("speed") == F.col(f"{name}_speed")) & (F.col(key) == F.col(f"{name}_prefix")), "left").drop(f"{name}_source", f"{name}_speed", f"{name}_prefix")
    both = F.when(F.col("_dated_entries").isNull(), F.col("_exact_entries")).when(F.col("_exact_entries").isNull(), F.col("_dated_entries")).otherwise(F.sort_array(F.concat("_exact_entries", "_dated_entries")))
    return rows.withColumn("_entries", both).drop("_base", "_exact_entries", "_dated_entries")


def matching_entry(at: Column) -> Column:
    """The first of `_entries` that holds at the time, or null."""
    holds = lambda e: F.coalesce(e["effective_from"] <= at, F.lit(True)) & F.coalesce(at < e["effective_until"], F.lit(True))
    return F.get(F.filter("_entries", holds), F.lit(0))


def input_tokens() -> Column:
    return F.col("uncached_input_tokens") + F.col("cache_read_input_tokens") + F.col("cache_write_5m_input_tokens") + F.col("cache_write_1h_input_tokens")


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _small_cost(e: Column) -> tuple[Column, Column]:
    """(whether it holds, whole nanos): requests without multipliers whose products and sum stay within 63 bits."""
    counts, rates = [F.col(t) for t in TOKENS[:5]], [e[r] for r in RATES]
    plain = ~F.coalesce(input_tokens() > e["long_threshold"], F.lit(False)) & ((F.col("inference_geo") != "us") | (e["us_bps"] == 10_000))
    small = plain & (F.greatest(*counts) < 2**22) & (F.greatest(*rates) < 2**38)
    total = sum((c * r for c, r in zip(counts[1:], rates[1:], strict=True)), counts[0] * rates[0])
    return F.coalesce(small, F.lit(False)), F.call_function("div", total + 500_000, F.lit(1_000_000))


def _exact_cost(e: Column) -> Column:
    """Whole nanos, half up, in wide decimals; null where a request has no price or the number is out of range."""
    raw = _scaled(e)
    return F.when(raw < F.lit(str(2**63 * _DIVISOR)).cast("decimal(38,0)"), F.call_function("div", raw, _exact(F.lit(_DIVISOR))).cast("long"))


def _scaled(e: Column) -> Column:
    """The price times the divisor, and half of it; null on overflow."""
    into = None
    for t, r in zip(TOKENS[:4], RATES[:4], strict=True):
        part = F.try_multiply(F.col(t).cast("decimal(19,0)"), e[r].cast("decimal(19,0)")).cast("decimal(38,0)")
        into = part if into is None else F.try_add(into, part).cast("decimal(38,0)")
    out = F.try_multiply(F.col(TOKENS[4]).cast("decimal(19,0)"), e[RATES[4]].cast("decimal(19,0)")).cast("decimal(38,0)")
    long = F.coalesce(input_tokens() > e["long_threshold"], F.lit(False))
    times = lambda x, bps: F.try_multiply(x, bps.cast("decimal(38,0)")).cast("decimal(38,0)")
    ten = F.lit(10_000).cast("long")
    both = F.try_add(times(into, F.when(long, e["long_input_bps"]).otherwise(ten)), times(out, F.when(long, e["long_output_bps"]).otherwise(ten))).cast("decimal(38,0)")
    scaled = times(both, F.when(F.col("inference_geo") == "us", e["us_bps"]).otherwise(ten))
    return F.when(~(long & ~e["long_priced"]), F.try_add(scaled, _exact(F.lit(_DIVISOR // 2))).cast("decimal(38,0)"))


def _multiplier(model: Column, source: Column) -> Column:
    out = F.lit(None).cast("long")
    for s, table in FAST_MULTIPLIERS.items():
        pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
        out = F.when(source == s, pairs[model]).otherwise(out)
    return out


def derived_multipliers(catalog: DataFrame, as_of) -> DataFrame:
    """(_model, _derived): models of one source whose fast prices are one exact multiple of the standard ones at the time `as_of`."""
    at = F.lit(as_of).cast("timestamp")
    current = ranked(catalog.where(F.col("source") == "claude")).withColumn("_entry", matching_entry(at))
    entry = lambda speed: F.max(F.when(F.col("_speed") == speed, F.col("_entry")))  # noqa: E731  one row a speed
    pair = current.groupBy(F.col("_prefix").alias("_model")).agg(entry("standard").alias("s"), entry("fast").alias("f")).where("s IS NOT NULL AND f IS NOT NULL")
    checked = ("uncached_rate", "output_rate", "cache_read_rate", "cache_write_5m_rate")
    ratios, ok = [], F.lit(True)
    for r in checked:
        base, premium = F.col(f"s.{r}").cast("decimal(19,0)"), F.col(f"f.{r}").cast("decimal(19,0)") * F.lit(10**9).cast("decimal(10,0)")
        ok = ok & F.when(base == 0, premium == 0).otherwise(premium % base == 0)
        ratios.append(F.when(base != 0, (premium / base).cast("long")))
    return pair.where(ok & (F.greatest(*ratios) == F.least(*ratios))).select("_model", F.greatest(*ratios).alias("_derived"))


def price(facts: DataFrame, catalog: DataFrame, fingerprint: str | None = None, derived: DataFrame | None = None) -> DataFrame:
    """Adds the four price columns and `assumed_geo`; rows of sources that price themselves keep theirs.

    Unpriced (null): no model, speed unknown, fast input over the limit, no entry at the time, a long request that the entry does not
    price, or a number beyond the range. `derived` holds multipliers of models that the fixed table lacks.
    """
    had = {c: (F.col(c) if c in facts.columns else F.lit(None)) for c in PRICE_COLUMNS}
    own = ~F.col("source").isin(*CATALOG_SOURCES)
    rows = with_entries(S.with_price_model(facts, "_model"), catalog)
    limited = (F.col("source") == "codex") & (F.col("speed") == "fast") & (input_tokens() > FAST_INPUT_LIMIT)
    rows = rows.withColumn("_entry", F.when(~limited, matching_entry(F.col("occurred_at"))))
    # the wide arithmetic is rarely needed; as a lambda it stays out of the generated code, which then is small enough to be compiled
    small, plain = _small_cost(F.col("_entry"))
    rows = rows.withColumn("_cost", F.when(F.col("_entry").isNull(), F.lit(None).cast("long")).when(small, plain).otherwise(F.get(F.transform(F.array("_entry"), _exact_cost), F.lit(0))))
    cost = F.col("_cost")
    fixed = _multiplier(F.col("_model"), F.col("source"))
    if derived is not None:
        rows = rows.join(derived.withColumnRenamed("_model", "_of"), (F.col("source") == "claude") & (F.col("_model") == F.col("_of")), "left")
        fixed = F.coalesce(fixed, F.col("_derived"))
    total = input_tokens() + F.col("output_tokens")
    billing = F.when((F.col("speed") == "fast") & (total >= 0), F.try_multiply(total, fixed))
    new = {
        "api_equivalent_cost_nanos": F.when(own, had["api_equivalent_cost_nanos"]).otherwise(cost).cast("long"),
        "billing_equivalent_tokens_nanos": F.when(own, had["billing_equivalent_tokens_nanos"]).otherwise(billing).cast("long"),
        "fast_multiplier_nanos": F.when(own, had["fast_multiplier_nanos"]).otherwise(F.when(billing.isNotNull(), fixed)).cast("long"),
        "pricing_fingerprint": F.when(own, had["pricing_fingerprint"]).otherwise(F.when(cost.isNotNull(), F.lit(fingerprint))).cast("string"),
        "assumed_geo": ~own & cost.isNotNull() & (F.col("source") == "claude") & (F.col("inference_geo") == "unknown"),
    }
    kept = [c for c in facts.columns if c not in new]
    return rows.select(*kept, *[v.alias(k) for k, v in new.items()])


def reprice(facts: DataFrame, catalog: DataFrame, fingerprint: str, derived: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(repriced facts, one row of updated, priced, unpriced); changes are counted null-safe over the price columns."""
    old = facts.select("*", F.struct(*PRICE_COLUMNS).alias("_old"))
    new = price(old, catalog, fingerprint, derived)
    ours = F.col("source").isin(*CATALOG_SOURCES)
    changed = ours & ~F.struct(*PRICE_COLUMNS).eqNullSafe(F.col("_old"))
    cost = F.col("api_equivalent_cost_nanos")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    counts = new.agg(n(changed).alias("updated"), n(ours & cost.isNotNull()).alias("priced"), n(ours & cost.isNull()).alias("unpriced"))
    return new.drop("_old"), counts


def price_keys(facts: DataFrame, only_unpriced: bool = True) -> DataFrame:
    """Distinct (source, model, speed) that a catalog should know: named, of known speed, and without a price."""
    ok = F.col("source").isin(*CATALOG_SOURCES) & (F.trim(F.coalesce("model", F.lit(""))) != "") & (F.col("speed") != "unknown")
    rows = facts.where(ok & F.col("api_equivalent_cost_nanos").isNull() if only_unpriced else ok)
    return rows.select("source", S.price_model(F.col("source"), F.col("model")).alias("model"), "speed").distinct()


def missing_keys(keys: DataFrame, catalog: DataFrame, attempts: DataFrame | None = None, now=None, cooldown_seconds: int = 1_800) -> DataFrame:
    """Keys that no catalog row covers and that were not asked for within the cooldown; made-up models never count."""
    named = keys.where(~F.col("model").startswith("<") & ~F.col("model").contains("synthetic"))
    out = with_entries(named.withColumn("_model", F.col("model")), catalog).where("_entries IS NULL").select("source", "model", "speed")
    if attempts is None:
        return out
    recent = attempts.where(F.col("attempted_at") > F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(cooldown_seconds)))
    return out.join(recent.select("source", "model", "speed").distinct(), ["source", "model", "speed"], "left_anti")


def scoped(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """Catalog rows that some key can reach: matching rows of the key's best priority."""
    c = catalog.withColumn("_id", F.struct("source", "speed", "model_prefix", "effective_from", "priority"))
    hit = keys.withColumnRenamed("source", "_s").withColumnRenamed("speed", "_v").join(c, (F.col("_s") == F.col("source")) & (F.col("_v") == F.col("speed")) & S.model_matches(F.col("model"), F.col("model_prefix")))
    best = hit.groupBy("_s", "_v", "model").agg(F.min("priority").alias("_best"))
    near = hit.join(best, ["_s", "_v", "model"]).where(F.col("priority") == F.col("_best"))
    return near.select(*catalog.columns).distinct()


def fingerprint(catalog: DataFrame) -> str:
    """SHA-256 of the catalog's rows as canonical JSON in key order, with the policy version and multipliers."""
    rows = catalog.select(F.to_json(F.struct(*sorted(catalog.columns))).alias("j")).agg(F.array_join(F.sort_array(F.collect_list("j")), "\n").alias("t"))
    return rows.select(F.sha2(F.concat(F.lit(f"{POLICY_VERSION}\n{sorted(FAST_MULTIPLIERS.items())}\n"), F.col("t")), 256)).first()[0]
