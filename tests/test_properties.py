"""Batches of generated inputs against plain Python."""

import hashlib
import struct
from datetime import UTC, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import ledger, pricing
from ledgerloom.schema import TOKENS
from ledgerloom.sources import catalog

few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
text = st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=300)


@few
@given(st.lists(st.tuples(text, text), min_size=20, max_size=60))
def test_hash_parts(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.h for r in rows.select("i", S.hash_parts(F.col("a"), F.col("b")).alias("h")).collect()}
    for i, pair in enumerate(pairs):
        raw = b"".join(struct.pack("<Q", len(x.encode())) + x.encode() for x in pair)
        assert got[i] == hashlib.sha256(raw).hexdigest()


@few
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(0, 12), st.integers(-9, 3)), min_size=20, max_size=60))
def test_scaled_decimals(spark, numbers):
    texts = [f"{Decimal(n).scaleb(-d):f}" + (f"e{x}" if x else "") for n, d, x in numbers]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.v for r in rows.select("i", S.scaled_decimal(F.col("t"), 9).alias("v")).collect()}
    for i, t in enumerate(texts):
        want = (Decimal(t) * 10**9).quantize(Decimal(1), ROUND_HALF_UP)
        assert got[i] == (int(want) if want < 2**63 else None), t


@few
@given(st.lists(st.integers(0, 2**63 - 1), min_size=20, max_size=60))
def test_nanos_text(spark, numbers):
    rows = spark.createDataFrame(list(enumerate(numbers)), "i int, n long")
    got = {r.i: r.t for r in rows.select("i", S.nanos_to_text(F.col("n")).alias("t")).collect()}
    for i, n in enumerate(numbers):
        assert Decimal(got[i]) == Decimal(n) / 10**9 and not (("." in got[i]) and got[i][-1] in "0.")


@few
@given(st.lists(st.tuples(st.sampled_from(["codex", "pi"]), st.sampled_from("abc"), st.integers(0, 5)), min_size=1, max_size=40))
def test_deduplication_is_a_sequential_upsert(spark, facts):
    kept, inserted = {}, 0
    for i, (source, key, n) in enumerate(facts):
        old = kept.get((source, key))
        if old is None or source == "pi" or n > old[0]:
            kept[source, key] = (n, i)
            inserted += 1
    schema = "source string, dedup_key string, seq string, " + ", ".join(f"{c} long" for c in TOKENS)
    rows = spark.createDataFrame([(s, k, f"{i:04d}", n, 0, 0, 0, 0, 0) for i, (s, k, n) in enumerate(facts)], schema)
    got = {(r.source, r.dedup_key): (r.uncached_input_tokens, int(r.seq)) for r in ledger.deduplicate(rows).collect()}
    assert got == kept and ledger.insert_counters(rows).first().inserted == inserted


@few
@given(st.lists(st.tuples(st.sampled_from(["gpt-5.6", "gpt-5.4", "gpt-5-mini", "none"]), st.sampled_from(["standard", "fast"]), *[st.integers(0, 400_000)] * 3), min_size=10, max_size=30))
def test_prices(spark, requests):
    rates = {(r.model_prefix, r.speed): r for r in catalog.bundled(spark).where("source = 'codex'").collect()}
    schema = "i int, source string, model string, speed string, inference_geo string, occurred_at timestamp, " + ", ".join(f"{c} long" for c in TOKENS)
    at = datetime(2026, 1, 1, tzinfo=UTC) + timedelta(days=1)
    rows = spark.createDataFrame([(i, "codex", m, v, "global", at, a, b, 0, 0, c, 0) for i, (m, v, a, b, c) in enumerate(requests)], schema)
    got = {r.i: r.api_equivalent_cost_nanos for r in pricing.price(rows, catalog.bundled(spark)).collect()}
    for i, (m, v, a, b, c) in enumerate(requests):
        e, want = rates.get((m, v)), None
        if e is not None and not (v == "fast" and a + b > 272_000):
            long = e.long_threshold is not None and a + b > e.long_threshold
            if not long or e.long_priced:
                into, out = (e.long_input_bps, e.long_output_bps) if long else (10_000, 10_000)
                raw = ((a * e.uncached_rate + b * e.cache_read_rate) * into + c * e.output_rate * out) * 10_000
                want = (raw + 5 * 10**13) // 10**14
        assert got[i] == want
