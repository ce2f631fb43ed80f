from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import audit, ledger, metrics, quota
from ledgerloom.plans import calendar, reports, scheduling

NOW = datetime(2026, 3, 29, 12, tzinfo=UTC)


def test_scalars(spark):
    L = F.lit
    cases = [
        (S.clean_title(L(" <a\n b  ")), "a b"), (S.clean_title(L("< ")), None), (S.project_hint(L("/a/b /")), "b"), (S.project_hint(L("a\\b"), True), "b"), (S.normalize_speed(L(" Priority ")), "fast"), (S.normalize_speed(L("x")), "unknown"),
        (S.usd_text_to_nanos(L("0.000000001")), 1), (S.usd_text_to_nanos(L("-1")), None), (S.usd_text_to_nanos(L("1.0000000001")), None), (S.scaled_decimal(L("1.5e-6"), 15), 1_500_000_000), (S.scaled_decimal(L("0.0000000005"), 9), 1), (S.nanos_to_text(L(2_500_000_000)), "2.5"),
        (S.nanos_to_text(L(0)), "0"), (S.nanos_to_text(L(33_621_607_500)), "33.6216075"), (S.audit_model_key(L("openai/GPT@x")), "gpt"), (S.model_matches(L("m-2026-02-30"), L("m")), False), (S.model_matches(L("m-20260228"), L("m")), True), (S.like_escape(L("50%_\\")), "50\\%\\_\\\\"),
        (S.duration_text(L(90_000)), "1d1h"), (S.speed_badge(L(5), L(5)), "fast"), (S.speed_badge(L(1), L(5)), "mixed"), (S.speed_badge(L(0), L(5)), None), (S.quota_tone(L(19)), "low"), (S.compact_tokens(L(12_345), True), "1.23万"), (S.http_class(L(429)), "rate_limited"), (S.apple_day(L(0.0)), "2001-01-01"),
        (S.window_kind(L(18_000)), "five_hour"), (S.cost_text(L(5), L(1)), "<$0.01"), (S.duration_text(L(59)), "<1m"), (S.duration_text(L(7200)), "2h"), (S.compact_cost_text(L(10**9 - 1)), "<$1"), (S.age_text(L(5.5)), "5s"), (S.provider_severity(L("error"), L("empty"), L(False), L("credentials")), 50), (S.provider_severity(L("offline"), L("fresh"), L(False), L(None)), 30), (S.provider_severity(L("ready"), L("fresh"), L(False), L(None)), 10), (S.percent_text(L(0.4)), "<1%"), (S.whole_percent(S.remaining_percent(L(140.0))), 0), (S.rfc3339(L("2026-01-01")).isNull(), True),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [(i, row[i]) for i in range(len(cases))] == [(i, want) for i, (_, want) in enumerate(cases)]


def test_large_amounts_are_rounded_as_sql_rounds_them(spark):
    """The count is the first of sf0.1 sixty times over whose hundredths differ with the order of multiplication and division."""
    row = spark.range(1).select(S.compact_tokens(F.lit(23_060_343_825_000_000)), S.cost_text(F.lit(23_060_343_825_000_000), F.lit(1)), S.compact_cost_text(F.lit(1_500_000_000))).first()
    assert tuple(row) == ("23,060,343.82B", "$23,060,343.83", "$2")


def test_totals_beyond_63_bits_fail_nothing(spark):
    """A total that fits is exact, one beyond its column is null, in groups and totals; the other measures stay."""
    one = lambda model, billing: (model, "fast", "claude", "us", "2020-01-01", *[1] * 6, 5, billing, 2, "p")
    names = ["model", "speed", "source", "inference_geo", "day_local", "uncached_input_tokens", "cache_read_input_tokens", "cache_write_5m_input_tokens", "cache_write_1h_input_tokens", "output_tokens", "reasoning_output_tokens", "api_equivalent_cost_nanos", "billing_equivalent_tokens_nanos", "fast_multiplier_nanos", "pricing_fingerprint"]
    facts = spark.createDataFrame([one("a", 2**62), one("a", 2**62), one("b", 2**62), one("b", 2**62 - 1)], names)
    got = {r.group_key: (r.entries, r.cost_nanos, r.fast_billing_nanos) for r in reports.summary(facts, "model").collect()}
    assert got == {"a": (2, 10, None), "b": (2, 10, 2**63 - 1)}
    for by in ("model", "speed"):
        total = reports.summary_totals(facts, by).first()
        assert (total.entries, total.cost_nanos, total.fast_billing_nanos) == (4, 20, None)
    assert reports.summary_totals(facts.limit(0), "speed").first().fast_billing_nanos == 0


def beyond_63_bits(spark):
    """Two models whose billing nanos come to 2^63 and 2^63 - 1, at a cost of 2^63 + 1 and 2."""
    one = lambda model, cost, billing: (model, "fast", "claude", "us", "2020-01-01", *[1] * 6, cost, billing, 2, "p")
    names = ["model", "speed", "source", "inference_geo", "day_local", "uncached_input_tokens", "cache_read_input_tokens", "cache_write_5m_input_tokens", "cache_write_1h_input_tokens", "output_tokens", "reasoning_output_tokens", "api_equivalent_cost_nanos", "billing_equivalent_tokens_nanos", "fast_multiplier_nanos", "pricing_fingerprint"]
    return spark.createDataFrame([one("a", 2**62, 2**62), one("a", 2**62 + 1, 2**62), one("b", 1, 2**62), one("b", 1, 2**62 - 1)], names)


def test_group_totals_beyond_63_bits_stay_whole(spark):
    rows = {r.group_key: r for r in metrics.presented(reports.summary(beyond_63_bits(spark), "model")).collect()}
    assert {k: (int(r.fast_billing_nanos_exact), int(r.cost_nanos_exact)) for k, r in rows.items()} == {"a": (2**63, 2**63 + 1), "b": (2**63 - 1, 2)}
    assert {k: (r.fast_billing_tokens, r.cost_usd) for k, r in rows.items()} == {"a": ("9223372036.854775808", "9223372036.854775809"), "b": ("9223372036.854775807", "0.000000002")}
    assert (rows["a"].fast_billing_nanos, rows["a"].cost_nanos) == (None, None) and (rows["b"].fast_billing_nanos, rows["b"].cost_nanos) == (2**63 - 1, 2)
    all_ = metrics.presented(reports.summary(beyond_63_bits(spark), "speed")).first()
    assert (all_.entries, all_.fast_billing_tokens, all_.cost_usd) == (4, "18446744073.709551615", "9223372036.854775811")
    facts = beyond_63_bits(spark).withColumns({"conversation_key": F.lit("c"), "occurred_at": F.lit(NOW)})
    for rows in (reports.dashboard(facts, calendar.Range(None, None)).where("level = 'source'"), reports.conversation_breakdown(facts, "c").where("level = 'speed'")):
        assert metrics.presented(rows).first().fast_billing_tokens == "18446744073.709551615"


def test_grand_totals_beyond_63_bits_stay_whole(spark):
    """Of groups beyond 63 bits (by model) and of one group that holds all (by speed); of no rows it is zero."""
    for by in ("model", "speed"):
        total = metrics.presented(reports.summary_totals(beyond_63_bits(spark), by)).first()
        assert (int(total.fast_billing_nanos_exact), int(total.cost_nanos_exact)) == (2**64 - 1, 2**63 + 3) and (total.fast_billing_nanos, total.cost_nanos) == (None, None)
        assert (total.entries, total.fast_billing_tokens, total.cost_usd) == (4, "18446744073.709551615", "9223372036.854775811")
    assert metrics.presented(reports.summary_totals(beyond_63_bits(spark).limit(0), "model")).first().cost_usd == "0"


def test_calendar():
    zone = "Europe/Berlin"
    day = calendar.preset("today", NOW, zone)
    assert (day.end - day.start).days == 1 and (day.end.astimezone(UTC) - day.start.astimezone(UTC)).total_seconds() == 23 * 3600  # summer time begins
    week = calendar.preset("week", NOW)
    assert week.start == datetime(2026, 3, 23, tzinfo=UTC) and calendar.previous("week", week).end == week.start
    assert calendar.preset("last_month", NOW).start == datetime(2026, 2, 1, tzinfo=UTC) and calendar.preset("all", NOW).start is None
    assert calendar.previous("all", calendar.Range(None, None)) is None
    assert (lambda r: (r.end - r.start).days)(calendar.chart(calendar.preset("today", NOW))) == 14
    custom = calendar.custom(datetime(2026, 1, 1), datetime(2026, 1, 2))
    assert calendar.last_included_day(custom) == datetime(2026, 1, 2, tzinfo=UTC)
    with pytest.raises(ValueError):
        calendar.preset("never", NOW)


def test_validation():
    with pytest.raises(ValueError):
        reports.Filter("2026-01-02T00:00:00Z", "2026-01-02T00:00:00Z").checked()
    with pytest.raises(ValueError):
        reports.Filter("yesterday").checked()
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}, {"sort": "x"}, {"search": "x" * 201}):
        with pytest.raises(ValueError):
            reports.ConversationQuery(**bad).checked()
    assert reports.ConversationQuery(search="  ").checked().search is None


def test_empty_source_list_matches_nothing(spark):
    rows = spark.createDataFrame([("codex",)], "source string")
    assert reports.in_sources(rows, []).count() == 0 and reports.in_sources(rows, None).count() == 1


def test_quota_history(spark):
    at = lambda m: datetime(2026, 1, 1, 0, m, tzinfo=UTC)
    e = spark.createDataFrame([("p", "i", "k", "w", r, at(m)) for m, r in enumerate([50.2, 50.4, 49.0, 50.0, None, None])], "provider string, identity string, kind string, window_id string, remaining double, observed_at timestamp")
    kept = quota.change_only(e).orderBy("observed_at")
    assert [r.remaining_percent for r in kept.collect()] == [50, 49, 50, None]
    assert [r.delta for r in quota.deltas(kept).orderBy("observed_at").collect()][:3] == [None, -1, 1]
    assert quota.history(kept, "p", limit=2).count() == 2
    new = e.where("remaining IS NOT NULL").withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 1 DAY"))
    assert quota.append_changes(kept.where("remaining IS NOT NULL"), new).count() == 2


def test_claude_quota_windows(spark):
    body = '{"five_hour": {"utilization": 10, "resets_at": "2026-01-01T05:00:00Z"}, "seven_day_opus": {"utilization": 30, "resets_at": 1767300000}, "limits": [{"kind": "weekly", "percent": 20}, {"kind": "session", "percent": 40}, {"kind": "weekly_scoped", "percent": 5, "scope": {"model": {"display_name": "Opus 9"}}}, {"kind": "session", "percent": 41}, {"kind": "odd kind", "percent": 1}]}'
    r = spark.createDataFrame([(1, NOW, body), (2, NOW, '{"five_hour": {"utilization": 12.5, "resets_at": null}}')], "response_id int, captured_at timestamp, body string")
    out = quota.claude_windows(r).orderBy("response_id", "place").collect()
    assert [(x.response_id, x.window_id, x.remaining) for x in out] == [(1, "five_hour", 59.0), (1, "weekly", 80.0), (1, "model-opus-9", 95.0), (1, "unknown-odd-kind", 99.0), (2, "five_hour", 87.5)]
    assert out[0].resets_at is not None and out[2].resets_at is not None and out[1].resets_at is None


def test_scheduling():
    assert [scheduling.backoff(n) for n in (0, 1, 2, 3, 9)] == [0, 30, 60, 120, 120] and scheduling.jittered(300, 7) == scheduling.jittered(300, 7)
    assert scheduling.backoff(1, True, 1000) == 900 and scheduling.backoff(2, True) == 120 and scheduling.retry_after_seconds("7") == 7 and scheduling.retry_after_seconds("soon") is None
    s = scheduling.apply(scheduling.begin(scheduling.RefreshState()), 100.0, "ok", {"a": 1}, "me")
    assert scheduling.decide(s, 101.0) == "throttle" and scheduling.decide(s, 101.0, manual=False) == "begin" and scheduling.decide(s, 200.0) == "begin"
    s = scheduling.apply(s, 200.0, "error")
    assert s.snapshot == {"a": 1} and scheduling.decide(s, 210.0) == "block"
    assert scheduling.apply(s, 300.0, "error", identity="you").snapshot is None and scheduling.is_stale(s, 1000.0, 300)


def test_insert_counters_replay(spark):
    t = "source string, dedup_key string, uncached_input_tokens long, cache_read_input_tokens long, cache_write_5m_input_tokens long, cache_write_1h_input_tokens long, output_tokens long, seq string"
    e = spark.createDataFrame([("codex", "a", n, 0, 0, 0, 0, str(i)) for i, n in enumerate([5, 3, 7, 7])] + [("pi", "b", 5, 0, 0, 0, 0, "0"), ("pi", "b", 1, 0, 0, 0, 0, "1")], t)
    assert ledger.insert_counters(e).first().asDict() == {"inserted": 4, "duplicates": 2}
    assert sorted((r.source, r.uncached_input_tokens) for r in ledger.deduplicate(e).collect()) == [("codex", 7), ("pi", 1)]


def test_audit_states(spark):
    s = "day string, source string, model string, speed string, input_tokens long, requests long, cost_nanos long"
    a = spark.createDataFrame([("d1", "x", "m", "s", 5, 2, 100), ("d2", "x", "m", "s", 5, 1, 100), ("d3", "x", "m", "s", 1, 1, 1)], s)
    b = spark.createDataFrame([("d1", "x", "m", "s", 5, 2, 102), ("d2", "x", "m", "s", 5, 1, 102), ("d4", "x", "m", "s", 1, 1, 1)], s)
    got = {r.day: r.state for r in audit.compare(a, b, values=("input_tokens", "requests", "cost_nanos")).collect()}
    assert got == {"d1": "equal", "d2": "differs", "d3": "only_ours", "d4": "only_theirs"}


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    import json

    from ledgerloom.operators import dialects
    from ledgerloom.streaming import ingest
    from tests.test_dialects import CLAUDE, PI

    logs, ledger_path, check = tmp_path / "logs", str(tmp_path / "ledger"), str(tmp_path / "check")
    logs.mkdir()
    (logs / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in CLAUDE))
    parse = lambda lines: dialects.entries(dialects.claude(lines))
    run = lambda: ingest.ingest(ingest.file_stream(spark, str(logs), "claude"), parse, ledger_path, check).awaitTermination()
    run()
    read = lambda: sorted(tuple(r) for r in ingest.read_ledger(spark, ledger_path).select("source", "dedup_key", "output_tokens").collect())
    first = read()
    assert len(first) == 2
    (logs / "b.jsonl").write_text("".join(json.dumps(r) + "\n" for r in CLAUDE))
    run()
    run()
    assert read() == first
    # a second stream into the same ledger begins with batch 0, too
    other = tmp_path / "other"
    other.mkdir()
    (other / "p.jsonl").write_text("".join(json.dumps(r) + "\n" for r in PI))
    more = lambda: ingest.ingest(ingest.file_stream(spark, str(other), "pi"), lambda x: dialects.entries(dialects.pi(x)), ledger_path, str(tmp_path / "check2")).awaitTermination()
    more()
    assert len(read()) == 5 and set(first) < set(read())
    entries = ingest.read_ledger(spark, ledger_path)
    before = read()
    ingest.merge_batch(spark, ledger_path, entries.where("source = 'pi'").withColumn("dedup_key", F.lit("again")), 0, str(tmp_path / "check2"))  # batch 0 of that query was merged
    assert read() == before


def test_change_only_stream(spark, tmp_path):
    from ledgerloom.streaming import ingest

    schema = "provider string, identity string, kind string, window_id string, remaining_percent int, observed_at timestamp"
    at = lambda m: datetime(2031, 1, 1, 0, m, tzinfo=UTC)
    batches = [[("p", "i", "k", "w", v, at(m)) for v, m in ((50, 3), (50, 1), (49, 2))] + [("p", "j", "k", "w", 7, at(1))], [("p", "i", "k", "w", v, at(m)) for v, m in ((50, 4), (40, 5), (40, 6))]]
    out, place = [], tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(place))
        query = ingest.change_only_stream(spark.readStream.schema(schema).parquet(str(place))).writeStream.foreachBatch(lambda df, _: out.extend((r.identity, r.remaining_percent, r.observed_at.minute) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(out) == [("i", 40, 5), ("i", 49, 2), ("i", 50, 1), ("i", 50, 3), ("j", 7, 1)]
