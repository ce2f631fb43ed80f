from datetime import UTC, datetime

import pytest

from ledgerloom.operators import pricing
from ledgerloom.schema import TOKENS
from ledgerloom.sources import catalog

NAMES = ["source", "model", "speed", "inference_geo", "occurred_at", *TOKENS]


def rows(spark, *given):
    at = datetime(2026, 7, 1, tzinfo=UTC)
    return spark.createDataFrame([(s, m, v, g, at, *(list(t) + [0] * 6)[:6]) for s, m, v, g, t in given], "source string, model string, speed string, inference_geo string, occurred_at timestamp, " + ", ".join(f"{c} long" for c in TOKENS))


def costs(spark, *given, rates=None):
    out = pricing.price(rows(spark, *given), rates or catalog.bundled(spark), "f").collect()
    return [r.api_equivalent_cost_nanos for r in out]


def test_costs_are_exact(spark):
    million = 1_000_000
    assert costs(spark, ("claude", "claude-opus-4.8", "standard", "us", (million, 0, 0, 0, million))) == [33_000_000_000]
    assert costs(spark, ("codex", "gpt-5.4", "standard", "global", (0, 0, 0, 0, 1))) == [15_000]
    assert costs(spark, ("codex", "OpenAI/GPT-5.4-2026-01-01", "standard", "global", (1, 0, 0, 0, 0))) == [2_500]


def test_long_requests(spark):
    n = 300_000
    assert costs(spark, ("codex", "gpt-5.5", "standard", "global", (n, 0, 0, 0, 10)), ("codex", "gpt-5.5", "fast", "global", (n, 0, 0, 0, 10))) == [n * 5_000 * 2 + 10 * 30_000 * 3 // 2, None]


def test_what_has_no_price(spark):
    assert costs(spark, ("codex", None, "standard", "global", (1,)), ("codex", "gpt-5.5", "unknown", "global", (1,)), ("codex", "nothing", "standard", "global", (1,))) == [None] * 3


def test_fast_equivalents(spark):
    out = pricing.price(rows(spark, ("codex", "gpt-5.5", "fast", "global", (10, 0, 0, 0, 90)), ("claude", "claude-opus-4-7", "fast", "global", (1,)), ("codex", "gpt-5.5", "standard", "global", (5,))), catalog.bundled(spark)).collect()
    assert [(r.billing_equivalent_tokens_nanos, r.fast_multiplier_nanos) for r in out] == [(250_000_000_000, 2_500_000_000), (6_000_000_000, 6_000_000_000), (None, None)]


def test_derived_multipliers(spark):
    got = {r._model: r._derived for r in pricing.derived_multipliers(catalog.bundled(spark), datetime(2026, 1, 1, tzinfo=UTC)).collect()}
    assert got == {"claude-opus-5": 2_000_000_000, "claude-opus-4-8": 2_000_000_000, "claude-opus-4-7": 6_000_000_000, "claude-opus-4-6": 6_000_000_000}


def test_bundled_catalog_is_valid(spark):
    rates = catalog.bundled(spark)
    assert rates.count() == 48 and rates.where(catalog.invalid_row()).count() == 0 and catalog.overlaps(rates).count() == 0
    assert pricing.fingerprint(rates) == pricing.fingerprint(catalog.bundled(spark))


def test_catalog_documents(spark, tmp_path):
    row = '{"source":"codex","modelPrefix":"m","speed":"standard","effectiveFrom":%s,"effectiveUntil":%s,"uncachedInputUsdPerMTok":"1.5","cacheReadUsdPerMTok":"0.1","cacheWrite5mUsdPerMTok":"0","cacheWrite1hUsdPerMTok":"0","outputUsdPerMTok":"2"}'
    document = '{"schemaVersion":1,"asOf":"2026-01-01","sources":["https://example.org"],"entries":[%s,%s]}'
    (tmp_path / "ok.json").write_text(document % (row % ("null", '"2026-01-01T00:00:00Z"'), row % ('"2026-01-01T00:00:00Z"', "null")))
    (tmp_path / "bad.json").write_text(document % (row % ("null", '"2026-01-02T00:00:00Z"'), row % ('"2026-01-01T00:00:00Z"', "null")))
    assert catalog.read_catalog(spark, str(tmp_path / "ok.json")).count() == 2
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, str(tmp_path / "bad.json"))


def test_reprice_counts_changes(spark):
    facts = pricing.price(rows(spark, ("codex", "gpt-5.4", "standard", "global", (1,)), ("codex", "zzz", "standard", "global", (1,))), catalog.bundled(spark), "old").drop("assumed_geo")
    same = pricing.reprice(facts, catalog.bundled(spark), "old")[1].first()
    moved = pricing.reprice(facts, catalog.bundled(spark), "new")[1].first()
    assert (same.updated, same.priced, same.unpriced, moved.updated) == (0, 1, 1, 1)
    keys = pricing.price_keys(facts)
    assert [tuple(r) for r in pricing.missing_keys(keys, catalog.bundled(spark)).collect()] == [("codex", "zzz", "standard")]


def test_refresh_rules():
    assert catalog.accepts_refresh(19, 0) and not catalog.accepts_refresh(20, 9) and catalog.accepts_refresh(20, 10)
    assert catalog.refresh_due(10**6, None, None) and not catalog.refresh_due(10**6, 10**6 - 100, None) and catalog.refresh_due(10**6, 10**6 - 5000, 10**6 - 2000)


def test_dated_models_and_precedence(spark):
    rates = catalog.bundled(spark).where("model_prefix = 'gpt-5.4'")
    dated = rates.withColumn("model_prefix", pricing.F.lit("gpt-5.4-2026-01-02")).withColumn("uncached_rate", pricing.F.lit(7_000_000_000).cast("long"))
    both = rates.unionByName(dated)
    one = ("standard", "global", (1,))
    # a date before a date is not cut from the name, and matches both the longer prefix and the shorter one
    assert costs(spark, ("codex", "gpt-5.4-2026-01-02-20260101", *one), ("codex", "gpt-5.4-2026-02-30-20260101", *one), ("codex", "gpt-5.4", *one), rates=both) == [7_000, None, 2_500]
