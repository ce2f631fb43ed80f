"""Registered queries of the scalar, display, calendar and refresh rules over the star-schema tables, beside the SQL they must agree with."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import driver_queries as Q
from ledgerloom import driver_tables as T
from ledgerloom.driver_queries import register
from ledgerloom.functions import documents as D
from ledgerloom.functions import scalars as S
from ledgerloom.operators import audit, ledger, pricing, quota
from ledgerloom.operators.metrics import measured, presented, wire_names
from ledgerloom.plans import calendar, reports, scheduling

# ---------------------------------------------------------------- texts


@register(r"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS VARCHAR) AS e, ['/a/' || l_partkey || ' /', '/', '..', 'x/..', '', 'a\b/c' || l_suppkey, '/q/./'][l_linenumber % 7 + 1] AS path,
  ['Default', ' standard', 'FAST ', 'priority', '', 'turbo', ' Priority'][l_linenumber % 7 + 1] AS speed, ['US', 'us', 'Global', 'eu', '', 'GLOBAL', ' us'][l_linenumber % 7 + 1] AS geo, ['Weekly Limit', '--', 'Opus 4.' || l_suppkey, '', 'a_b c', 'É 1', '!x!'][l_linenumber % 7 + 1] AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 7 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 5 THEN 'c' || l_suppkey WHEN 6 THEN 'q' END AS hint,
  CASE l_linenumber % 7 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 5 THEN 'c' || l_suppkey WHEN 6 THEN 'q' END AS windows_hint, nullif(trim(speed), '') AS filled,
  CASE WHEN lower(trim(speed)) IN ('default', 'standard') THEN 'standard' WHEN lower(trim(speed)) IN ('fast', 'priority') THEN 'fast' ELSE 'unknown' END AS speed_class,
  CASE lower(geo) WHEN 'us' THEN 'us' WHEN 'global' THEN 'global' ELSE 'unknown' END AS geo_class, CASE l_linenumber % 7 WHEN 0 THEN 'weekly-limit' WHEN 2 THEN 'opus-4-' || l_suppkey WHEN 4 THEN 'a-b-c' WHEN 5 THEN 'é-1' WHEN 6 THEN 'x' ELSE 'unspecified' END AS slug,
  replace(replace(replace(name || '%_\', '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM x""")
def scalar_texts(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda *xs: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), F.col("l_linenumber") % 7)
    supplier = F.col("l_suppkey").cast("string")
    path = pick(F.concat(F.lit("/a/"), F.col("l_partkey").cast("string"), F.lit(" /")), "/", "..", "x/..", "", F.concat(F.lit("a\\b/c"), supplier), "/q/./")
    speed, geo = pick("Default", " standard", "FAST ", "priority", "", "turbo", " Priority"), pick("US", "us", "Global", "eu", "", "GLOBAL", " us")
    name = pick("Weekly Limit", "--", F.concat(F.lit("Opus 4."), supplier), "", "a_b c", "É 1", "!x!")
    return T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.project_hint(path).alias("hint"), S.project_hint(path, windows_paths=True).alias("windows_hint"), S.optional_text(speed).alias("filled"), S.normalize_speed(speed).alias("speed_class"),
        S.inference_geo(geo).alias("geo_class"), S.slug(name).alias("slug"), S.like_escape(F.concat(name, F.lit("%_\\"))).alias("escaped"),
    )


@register("""WITH h AS (SELECT doc_id, coalesce(lang, '') AS a, coalesce(source, '') AS b FROM documents) SELECT doc_id,
  sha256(CAST(unhex(hex(chr(CAST(strlen('codex-entry') AS INTEGER))) || '00000000000000' || hex('codex-entry') || hex(chr(CAST(strlen(a) AS INTEGER))) || '00000000000000' || hex(a)) AS BLOB)) AS key,
  substr(sha256(CAST(encode('claude' || chr(31) || a || chr(31) || b) AS BLOB)), 1, 16) AS identity FROM h WHERE a <> ''""")
def hashed_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = T.table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("a"), F.coalesce("source", F.lit("")).alias("b")).where("a != ''")
    return d.select("doc_id", S.hash_parts(F.lit("codex-entry"), F.col("a")).alias("key"), S.identity_key(F.lit("claude"), F.col("a"), F.col("b")).alias("identity"))


@register(r"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS millis, strftime(CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 90 MINUTE WHEN 2 THEN date_trunc('second', ts) + INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M:%S') AS instant,
  strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS new_york_day, strftime(TIMESTAMP '2001-01-01' + to_seconds(event_id * 100), '%Y-%m-%d') AS apple_day FROM events""")
def scalar_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times as texts with every kind of offset, and local days (winter in New York)."""
    e = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(plain, F.lit("Z"))).when(k == 1, F.concat(F.regexp_replace(plain, "T", "t"), F.lit("+01:30"))).when(k == 2, F.concat(plain, F.lit("-05:00"))).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", S.utc_millis(F.col("ts")).alias("millis"), F.date_format(S.rfc3339(text), "yyyy-MM-dd HH:mm:ss").alias("instant"), S.local_day(F.col("ts"), "America/New_York").alias("new_york_day"), S.apple_day((F.col("event_id") * 100).cast("double")).alias("apple_day"))


# ---------------------------------------------------------------- numbers


@register(r"""WITH x AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(value * 100) AS cents FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN k WHEN 3 THEN 0 END AS whole, CASE event_id % 5 WHEN 0 THEN k WHEN 3 THEN 0 WHEN 4 THEN 0 END AS whole_or_zero, event_id % 5 IN (1, 2) AS broken, CASE WHEN event_id % 5 = 3 THEN 0.0 WHEN event_id % 5 = 0 THEN CAST(k AS DOUBLE) WHEN event_id % 5 = 1 THEN CAST(-1 - k AS DOUBLE) END AS number,
  CAST(k AS HUGEINT) * 1000000000 + CASE event_id % 3 WHEN 0 THEN 500000000 WHEN 1 THEN 1 ELSE 0 END AS nanos, CASE WHEN event_id % 4 < 3 THEN k * 1000000 + 250000 END AS scaled, CAST(cents * 10000000 AS BIGINT) AS from_double FROM x""")
def scalar_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Strict integers of JSON, dollar texts, exponents and amounts in floating point."""
    e = T.table(spark, sf, "events").withColumn("k", D.integer(D.parse(F.col("props")), "$.k"))
    j, text, m = F.col("event_id") % 5, F.col("k").cast("string"), F.col("event_id") % 4
    body = F.when(j == 0, F.concat(F.lit('{"x": '), text, F.lit("}"))).when(j == 1, F.concat(F.lit('{"x": '), (-1 - F.col("k")).cast("string"), F.lit("}"))).when(j == 2, F.concat(F.lit('{"x": "'), text, F.lit('"}'))).when(j == 3, '{"x": 0}').otherwise("{}")
    v = D.parse(body)
    usd = F.concat(text, F.when(F.col("event_id") % 3 == 0, ".5").when(F.col("event_id") % 3 == 1, ".000000001").otherwise("."))
    tens = F.when(m == 0, F.concat(text, F.lit(".25"))).when(m == 1, F.concat(text, F.lit("25e-2"))).when(m == 2, F.concat(F.lit("0.000"), F.lpad(text, 3, "0"), F.lit("25E6"))).otherwise(F.concat(F.lit("-"), text))
    return e.select(
        "event_id", D.integer(v, "$.x").alias("whole"), D.integer_or_zero(v, "$.x").alias("whole_or_zero"), D.broken(v, "$.x").alias("broken"), D.number(v, "$.x").alias("number"), S.usd_text_to_nanos(usd).cast("decimal(38,0)").alias("nanos"),
        S.scaled_decimal(tens, 6).alias("scaled"), S.usd_to_nanos(F.round(F.col("value") * 100) / 100).alias("from_double"),
    )


@register("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey AS BIGINT) * l_suppkey * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 100 END AS t, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
s AS (SELECT *, CASE WHEN t >= 1000000000 THEN 1000000000 WHEN t >= 1000000 THEN 1000000 WHEN t >= 1000 THEN 1000 END AS u, CASE WHEN t >= 100000000 THEN 100000000 WHEN t >= 10000 THEN 10000 END AS z FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, t, CASE WHEN u IS NULL THEN CAST(t AS VARCHAR) ELSE regexp_replace(format('{:,}', CAST(floor(round(t * 100.0 / u) / 100) AS BIGINT)) || '.' || lpad(CAST(CAST(round(t * 100.0 / u) AS BIGINT) % 100 AS VARCHAR), 2, '0'), '[.]?0+$', '') END AS rough,
  CASE WHEN q <= 5 THEN NULL WHEN t > 0 AND t < 10000000 THEN '<$0.01' ELSE '$' || format('{:,}', CAST(round(t / 1e7) AS BIGINT) // 100) || '.' || lpad(CAST(CAST(round(t / 1e7) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS dollars, CASE WHEN t <= 0 THEN '$0' WHEN t < 1000000000 THEN '<$1' ELSE '$' || format('{:,}', CAST(round(t / 1e9) AS BIGINT)) END AS whole_dollars,
  q || '%' AS percent, CASE WHEN q >= 30 THEN 'fast' WHEN q > 10 THEN 'mixed' END AS badge, CASE WHEN l_linenumber % 3 = 0 THEN q ELSE q + t END AS both FROM s""")
def scalar_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and money as readers see them; `rough` is a count without its unit."""
    n, c = F.col("l_linenumber") % 4, F.col
    t = (c("l_partkey") * c("l_suppkey") * F.when(n == 0, 1).when(n == 1, 1000).when(n == 2, 1_000_000).otherwise(100)).cast("long")
    rows = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.alias("t"), c("l_quantity").cast("long").alias("q"))
    short = S.compact_tokens(c("t"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t", F.regexp_replace(short, "[KMB]$", "").alias("rough"), S.cost_text(c("t"), c("q") - 5).alias("dollars"), S.compact_cost_text(c("t")).alias("whole_dollars"), S.percent_text(c("q").cast("double")).alias("percent"), S.speed_badge(F.greatest(c("q") - 10, F.lit(0)), F.lit(20)).alias("badge"), S.sum_options(c("q"), F.when(c("l_linenumber") % 3 != 0, c("t"))).alias("both"))


@register("""WITH e AS (SELECT event_id, event_id * 37 AS s FROM events), m AS (SELECT *, s // 60 AS m, s // 3600 AS h, s // 86400 AS d FROM e),
t AS (SELECT *, CASE WHEN m < 1 THEN '<1m' WHEN h < 1 THEN m || 'm' WHEN d < 1 THEN h || 'h' || CASE WHEN m % 60 > 0 THEN (m % 60) || 'm' ELSE '' END ELSE d || 'd' || CASE WHEN h % 24 > 0 THEN (h % 24) || 'h' ELSE '' END END AS duration FROM m)
SELECT event_id, duration, CASE WHEN s < 1 THEN NULL WHEN s < 60 THEN s || 's' ELSE duration END AS age FROM t""")
def scalar_durations(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("event_id") * 37
    return T.table(spark, sf, "events").select("event_id", S.duration_text(s).alias("duration"), S.age_text(s).alias("age"))


# ---------------------------------------------------------------- states of providers

_STATES = """
s AS (SELECT event_id, event_type AS provider, ['ready', 'offline', 'rate_limited', 'error', 'no_credentials', 'unsupported'][event_id % 6 + 1] AS availability, ['fresh', 'stale', 'empty'][user_id % 3 + 1] AS freshness, event_id % 7 = 0 AS refreshing, CASE WHEN event_id % 4 = 1 THEN 'credentials' END AS error_kind, ts FROM events),
v AS (SELECT *, CASE WHEN availability IN ('no_credentials', 'unsupported') OR (availability = 'error' AND error_kind = 'credentials') THEN 50 WHEN availability IN ('offline', 'rate_limited', 'error') THEN CASE WHEN freshness = 'empty' THEN 40 ELSE 30 END WHEN refreshing OR freshness = 'empty' THEN 20 WHEN freshness = 'stale' THEN 30 ELSE 10 END AS severity FROM s)"""


def _states(spark: SparkSession, sf: str) -> DataFrame:
    get = lambda names, k: F.get(F.array(*map(F.lit, names)), k)
    e = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.select("event_id", F.col("event_type").alias("provider"), get(["ready", "offline", "rate_limited", "error", "no_credentials", "unsupported"], F.col("event_id") % 6).alias("availability"), get(["fresh", "stale", "empty"], F.col("user_id") % 3).alias("freshness"), (F.col("event_id") % 7 == 0).alias("refreshing"), F.when(F.col("event_id") % 4 == 1, "credentials").alias("error_kind"), F.col("ts").alias("observed_at"))
    return rows.withColumn("severity", S.provider_severity(F.col("availability"), F.col("freshness"), F.col("refreshing"), F.col("error_kind")))


@register(f"WITH {_STATES} SELECT event_id, severity, availability IN ('ready', 'rate_limited') AS shown, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'unauthorized' ELSE 'error' END AS answer, ['none', 'minor', 'critical', 'unknown'][event_id % 4 + 1] AS indicator, ['Max', 'Pro Plus', 'Team'][event_id % 3 + 1] AS plan, epoch(TIMESTAMP '2024-01-10') - epoch(date_trunc('second', ts)) > 7200 AS stale FROM v")
def provider_states(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    get = lambda names, n: F.get(F.array(*map(F.lit, names)), k % n)
    rows = quota.stale(_states(spark, sf), datetime(2024, 1, 10, tzinfo=UTC), 3600)
    return rows.select("event_id", "severity", S.tray_visible(F.col("availability")).alias("shown"), S.http_class(get([204, 429, 403, 500, 302], 5)).alias("answer"), S.service_indicator(get(["none", " Minor", "critical", "on fire"], 4)).alias("indicator"), S.plan_label(get(["max", "pro_plus", " team "], 3)).alias("plan"), "stale")


@register(f"WITH {_STATES}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id // 7 ORDER BY severity DESC, event_id) AS r FROM v) SELECT event_id // 7 AS block, event_id AS worst, severity FROM r WHERE r = 1")
def worst_providers(spark: SparkSession, sf: str) -> DataFrame:
    """The worst of every seven states, the first of several."""
    rows = _states(spark, sf).withColumns({"block": F.floor(F.col("event_id") / 7), "provider": F.col("event_id"), "place": F.col("event_id")})
    return rows.groupBy("block").agg(F.max_by("provider", F.struct("severity", -F.col("place"))).alias("worst"), F.max("severity").alias("severity"))


@register("""WITH e AS (SELECT event_id, value AS used, least(100, value / 2) AS week, event_id % 3 AS k, ts FROM events),
w AS (SELECT event_id, 'five_hour' AS window_id, 'five_hour' AS kind, greatest(0, 100 - used) AS remaining, CASE WHEN k <> 2 THEN date_trunc('second', ts) + INTERVAL 5 HOUR END AS resets_at, 0 AS place FROM e WHERE k < 3
  UNION ALL SELECT event_id, 'weekly', 'weekly', 100 - week, NULL, 1 FROM e WHERE k > 0 UNION ALL SELECT event_id, 'model-opus-9', 'model', 95.0, date_trunc('second', ts) + INTERVAL 1 DAY, 2 FROM e WHERE k = 1
  UNION ALL SELECT event_id, 'unknown-odd-kind', 'unknown', 99.0, NULL, 3 FROM e WHERE k = 1)
SELECT event_id, window_id, kind, CAST(remaining AS DOUBLE) AS remaining, strftime(resets_at, '%Y-%m-%d %H:%M:%S') AS resets_at, place FROM w""")
def claude_quota_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with legacy fields only, with limits whose resets come from these, and with limits alone."""
    c = F.col
    e = T.table(spark, sf, "events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp"))
    five, day = F.date_format(c("ts") + F.expr("INTERVAL 5 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.unix_seconds(c("ts")) + 86400
    k, week = c("event_id") % 3, F.least(F.lit(100.0), c("value") / 2)
    session = F.struct(F.struct(c("value").alias("utilization"), five.alias("resets_at")).alias("five_hour"))
    limit = lambda kind, percent, scope=None: F.struct(F.lit(kind).alias("kind"), percent.alias("percent"), (F.struct(F.struct(F.lit(scope).alias("display_name")).alias("model")) if scope else F.lit(None).cast("struct<model: struct<display_name: string>>")).alias("scope"))
    many = F.array(limit("weekly", week), limit("session", F.lit(1.5)), limit("weekly_scoped", F.lit(5.0), "Opus 9"), limit("session", c("value")), limit("odd kind", F.lit(1.0)))
    few = F.array(limit("weekly_all", week), limit("five_hour", c("value")))
    body = F.when(k == 0, F.to_json(session)).when(k == 1, F.to_json(F.struct("five.five_hour", F.struct(F.lit(30).alias("utilization"), day.alias("resets_at")).alias("seven_day_opus"), many.alias("limits")))).otherwise(F.to_json(F.struct(few.alias("limits"))))
    rows = e.withColumn("five", session).select(c("event_id").alias("response_id"), c("ts").alias("captured_at"), body.alias("body"))
    return quota.claude_windows(rows).select(c("response_id").alias("event_id"), "window_id", "kind", "remaining", Q.iso("resets_at"), "place")


@register(f"""WITH {Q._QUOTA}, h AS (SELECT * FROM q WHERE observed_at < TIMESTAMP '2024-01-15'), n AS (SELECT * FROM q WHERE observed_at >= TIMESTAMP '2024-01-15'),
k AS (SELECT provider, identity, arg_max(remaining_percent, observed_at) AS known FROM h GROUP BY ALL), b AS (SELECT n.*, coalesce(lag(n.remaining_percent) OVER (PARTITION BY n.provider, n.identity ORDER BY n.observed_at), k.known) AS before FROM n LEFT JOIN k ON n.provider = k.provider AND n.identity = k.identity)
SELECT event_id, remaining_percent FROM b WHERE remaining_percent IS DISTINCT FROM before""")
def quota_append_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Later points that change their series, given the history before."""
    e = T.quota_events(spark, sf)
    history = e.where("observed_at < '2024-01-15'").withColumn("remaining_percent", S.whole_percent(F.col("remaining")))
    return quota.append_changes(history, e.where("observed_at >= '2024-01-15'")).select("event_id", "remaining_percent")


# ---------------------------------------------------------------- reports


@register(f"WITH {Q._PRICED}, g AS (SELECT source AS group_key, {Q._MEASURES} FROM f GROUP BY 1) SELECT group_key AS \"groupKey\", uncached_input_tokens + cache_read_input_tokens + cache_write_5m_input_tokens + cache_write_1h_input_tokens AS \"inputTokens\", output_tokens AS \"outputTokens\", uncached_input_tokens + cache_read_input_tokens + cache_write_5m_input_tokens + cache_write_1h_input_tokens + output_tokens AS \"totalTokens\", unpriced_fast > 0 AS \"hasUnpricedEquivalent\", CASE WHEN cost_nanos % 1000000000 = 0 THEN CAST(cost_nanos // 1000000000 AS VARCHAR) ELSE rtrim(CAST(cost_nanos // 1000000000 AS VARCHAR) || '.' || lpad(CAST(cost_nanos % 1000000000 AS VARCHAR), 9, '0'), '0') END AS \"costUsd\" FROM g")
def summary_as_read(spark: SparkSession, sf: str) -> DataFrame:
    """A summary with what readers see, under the names of their JSON."""
    rows = presented(reports.summary(Q.facts(spark, sf), "source")).select("group_key", "input_tokens", "output_tokens", "total_tokens", "has_unpriced_equivalent", "cost_usd")
    return wire_names(rows)


def _nanos_text_sql(c: str) -> str:
    return f"CASE WHEN {c} % 1000000000 = 0 THEN CAST({c} // 1000000000 AS VARCHAR) ELSE rtrim(CAST({c} // 1000000000 AS VARCHAR) || '.' || lpad(CAST({c} % 1000000000 AS VARCHAR), 9, '0'), '0') END"


_EXACT = f"{_nanos_text_sql('billing')} AS fast_billing_tokens, {_nanos_text_sql('cost')} AS cost_usd"


@register(f"WITH {Q._PRICED}, g AS (SELECT speed AS group_key, count(*) AS entries, coalesce(sum(CASE WHEN speed = 'fast' THEN billing END), 0) AS billing, coalesce(sum(cost), 0) AS cost FROM f GROUP BY 1) SELECT group_key, entries, {_EXACT} FROM g")
def summary_by_speed_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The totals of `summary_by_speed` as decimal texts, which hold what its BIGINT columns cannot."""
    return presented(reports.summary(Q.facts(spark, sf), "speed")).select("group_key", "entries", "fast_billing_tokens", "cost_usd")


@register(f"WITH {Q._PRICED}, g AS (SELECT count(*) AS entries, coalesce(sum(CASE WHEN speed = 'fast' THEN billing END), 0) AS billing, coalesce(sum(cost), 0) AS cost FROM f) SELECT entries, {_EXACT} FROM g")
def summary_totals_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same of `summary_totals`."""
    return presented(reports.summary_totals(Q.facts(spark, sf), "source")).select("entries", "fast_billing_tokens", "cost_usd")


@register(f"WITH {Q._PRICED} SELECT day_local AS day, CAST(sum(total) AS BIGINT) AS total_tokens, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost_nanos, count(cost) AS priced, CAST(round(least(100, sum(cache_read_input_tokens) * 100.0 / sum(input))) AS INTEGER) AS cache_rate FROM f WHERE occurred_at >= TIMESTAMP '1997-01-01' AND occurred_at < TIMESTAMP '1998-01-01' AND source IN ('codex', 'pi') GROUP BY 1")
def daily_tooltips(spark: SparkSession, sf: str) -> DataFrame:
    year = calendar.preset("year", datetime(1997, 5, 5, tzinfo=UTC))
    return reports.day_totals(Q.facts(spark, sf), year, ["codex", "pi"])


@register(f"WITH {Q._PRICED}, a AS (SELECT source, count(*) AS n, 'none' AS chosen FROM f GROUP BY 1 UNION ALL SELECT source, count(*), 'one' FROM f WHERE source = 'pi' GROUP BY 1) SELECT * FROM a")
def source_filters(spark: SparkSession, sf: str) -> DataFrame:
    """No list of sources is no filter, a list is one, and an empty list matches nothing."""
    rows = Q.unpriced(spark, sf)
    parts = [reports.in_sources(rows, s).groupBy("source").agg(F.count("*").alias("n")).withColumn("chosen", F.lit(name)) for s, name in ((None, "none"), (["pi"], "one"), ([], "empty"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(f"WITH {Q._ENTRIES} SELECT source, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM t GROUP BY source")
def sources_united(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of each source, read apart, in one ledger."""
    rows = T.entries(spark, sf).withColumn("seq", F.lit(""))
    parts = [rows.where(F.col("source") == s) for s in ("codex", "claude", "pi", "opencode")]
    return measured(ledger.union_entries(*parts), source=F.col("source")).select("source", F.col("entries").alias("n"), (F.col("uncached_input_tokens") + F.col("cache_read_input_tokens") + F.col("cache_write_5m_input_tokens") + F.col("cache_write_1h_input_tokens") + F.col("output_tokens")).alias("total"))


_SORTS = {"total": "total", "entries": "entries", "cost_nanos": "cost_nanos", "output_tokens": "output_tokens", "group_key": "group_key", "priced": "priced", "unpriced": "unpriced"}


@register(f"WITH {Q._PRICED}, g AS (SELECT coalesce(model, '') AS group_key, {Q._MEASURES}, CAST(sum(total) AS BIGINT) AS total FROM f GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{n}' AS sort, group_key, row_number() OVER (ORDER BY {c} {d}, group_key) AS place FROM g" for n, c in _SORTS.items() for d in ("DESC" if n != "group_key" else "ASC",)))
def model_table_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The model table in every order but that by cost of the priced; places are those of the sorted rows."""
    rows = reports.summary(Q.facts(spark, sf), "model").select("group_key", "entries", "cost_nanos", "output_tokens", "priced", "unpriced", sum((F.col(c) for c in ("cache_read_input_tokens", "cache_write_5m_input_tokens", "cache_write_1h_input_tokens", "output_tokens")), F.col("uncached_input_tokens")).alias("total"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # a row a model
    out = []
    for name in _SORTS:
        ordered = [r.group_key for r in reports.model_table(rows, name, descending=name != "group_key").collect()]
        out += [(name, key, place + 1) for place, key in enumerate(ordered)]
    return spark.createDataFrame(out, "sort string, group_key string, place long")


@register(f"WITH {Q._PRICED} SELECT day_local AS day, source, lower(coalesce(model, '')) AS model, speed, CAST(sum(input) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_input_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_5m_input_tokens + cache_write_1h_input_tokens) AS BIGINT) AS cache_write_tokens, count(*) AS requests, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost_nanos FROM f GROUP BY ALL")
def audit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ledger_rollup(Q.facts(spark, sf))


@register("SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem WHERE l_returnflag <> 'R'")
def audit_all_days(spark: SparkSession, sf: str) -> DataFrame:
    days = T.entries(spark, sf).select("source", F.col("day_local").alias("day"))
    return audit.all_days(days.where("source = 'codex'"), days.where("source = 'claude'"))


# ---------------------------------------------------------------- prices and refreshing


@register("WITH o AS (SELECT p_brand, p_size % 2 = 0 AS fast, count(*) AS n FROM part GROUP BY ALL), f AS (SELECT p_brand, fast, n + 1000 AS n FROM o WHERE p_brand <> 'Brand#3') SELECT p_brand AS model, CASE WHEN fast THEN 'fast' ELSE 'standard' END AS speed, n AS rate FROM f UNION ALL SELECT p_brand, 'fast', n FROM o WHERE p_brand = 'Brand#3' AND fast")
def catalog_keep_last_known(spark: SparkSession, sf: str) -> DataFrame:
    """A fetched list replaces standard prices, but a fast price that it lacks stays."""
    from ledgerloom.sources.catalog import keep_last_known

    old = T.table(spark, sf, "part").groupBy(F.col("p_brand").alias("model_prefix"), F.when(F.col("p_size") % 2 == 0, "fast").otherwise("standard").alias("speed")).agg(F.count("*").alias("rate"))
    fetched = old.where("model_prefix != 'Brand#3'").withColumn("rate", F.col("rate") + 1000)
    return keep_last_known(old, fetched).select(F.col("model_prefix").alias("model"), "speed", "rate")


@register(f"WITH {Q._CATALOG}, k AS (SELECT DISTINCT source, model_prefix AS model, speed FROM c UNION SELECT 'codex', 'new-' || n_nationkey, 'fast' FROM nation), a AS (SELECT 'new-' || n_nationkey AS model FROM nation WHERE n_nationkey % 3 = 0) SELECT source, model, speed FROM k WHERE model LIKE 'new-%' AND model NOT IN (SELECT model FROM a)")
def missing_price_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    """Keys without a price that were not asked for within the last half hour; older attempts do not count."""
    n = T.table(spark, sf, "nation")
    new = n.select(F.lit("codex").alias("source"), F.concat(F.lit("new-"), F.col("n_nationkey").cast("string")).alias("model"), F.lit("fast").alias("speed"))
    keys = T.catalog(spark).select("source", F.col("model_prefix").alias("model"), "speed").distinct().unionByName(new)
    minutes = F.when(F.col("n_nationkey") % 3 == 0, 29).otherwise(31)
    attempts = n.select(F.lit("codex").alias("source"), F.concat(F.lit("new-"), F.col("n_nationkey").cast("string")).alias("model"), F.lit("fast").alias("speed"), (F.lit("2024-01-02 00:00:00").cast("timestamp") - F.make_interval(mins=minutes)).alias("attempted_at"))
    return pricing.missing_keys(keys, T.catalog(spark), attempts, datetime(2024, 1, 2, tzinfo=UTC))


@register("""WITH n AS (SELECT CAST(i AS INTEGER) AS failures FROM range(0, 8) t(i)), r AS (SELECT unnest([NULL, 0, 45, 2000]) AS after)
SELECT failures, after, CASE WHEN failures = 0 THEN 0 WHEN failures = 1 THEN 30 WHEN failures = 2 THEN 60 ELSE 120 END AS failed, CASE WHEN failures = 0 THEN 0 WHEN after > 0 THEN least(900, after) WHEN failures = 1 THEN 60 WHEN failures = 2 THEN 120 ELSE 300 END AS limited FROM n, r""")
def refresh_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """Waits after failures and after rate limits, over a grid of cases."""
    rows = [(n, after, scheduling.backoff(n), scheduling.backoff(n, True, after)) for n in range(8) for after in (None, 0, 45, 2000)]
    return spark.createDataFrame(rows, "failures int, after int, failed int, limited int")


@register("""WITH g AS (SELECT running, manual, since, wait FROM (SELECT unnest([true, false]) AS running), (SELECT unnest([true, false]) AS manual), (SELECT unnest([NULL, 10, 59, 60, 5000]) AS since), (SELECT unnest([-1, 0, 20]) AS wait))
SELECT *, CASE WHEN running THEN 'merge' WHEN wait > 0 THEN 'block' WHEN manual AND since < 60 THEN 'throttle' ELSE 'begin' END AS decision, coalesce(since > 600, false) AS stale FROM g""")
def refresh_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """What a wish to refresh leads to, by state, over a grid of cases."""
    rows = []
    for running in (True, False):
        for manual in (True, False):
            for since in (None, 10, 59, 60, 5000):
                for wait in (-1, 0, 20):
                    state = scheduling.RefreshState(running, None if since is None else 10_000.0 - since, 10_000.0 + wait)
                    rows.append((running, manual, since, wait, scheduling.decide(state, 10_000.0, manual), scheduling.is_stale(state, 10_000.0, 300.0)))
    return spark.createDataFrame(rows, "running boolean, manual boolean, since int, wait int, decision string, stale boolean")


@register("""WITH s AS (SELECT unnest([NULL, 10, 86399, 86400]) AS success), f AS (SELECT unnest([NULL, 5, 1799, 1800, 90000]) AS failure), n AS (SELECT unnest([19, 20, 40]) AS before)
SELECT success, failure, before, CASE WHEN failure IS NOT NULL AND (success IS NULL OR failure < success) THEN failure >= 1800 ELSE success IS NULL OR success >= 86400 END AS due, NOT (before >= 20 AND 19 < before) AS accepted FROM s, f, n""")
def catalog_refresh_rules(spark: SparkSession, sf: str) -> DataFrame:
    """When a price list is due, seconds after its last success and failure, and whether half a list is refused."""
    from ledgerloom.sources.catalog import accepts_refresh, refresh_due

    now, ago = 1e6, lambda x: None if x is None else 1e6 - x
    rows = [(s, f, n, refresh_due(now, ago(s), ago(f)), accepts_refresh(n, 9)) for s in (None, 10, 86399, 86400) for f in (None, 5, 1799, 1800, 90000) for n in (19, 20, 40)]
    return spark.createDataFrame(rows, "success int, failure int, before int, due boolean, accepted boolean")


@register("""WITH d AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM events)
SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d - INTERVAL 13 DAY, '%Y-%m-%d') AS chart_start, strftime(d + INTERVAL 2 DAY, '%Y-%m-%d') AS custom_end, strftime(date_trunc('week', d) - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before, strftime(d + INTERVAL 1 DAY, '%Y-%m-%d') AS shown_end FROM d""")
def calendar_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Chart, custom and previous ranges at each day that occurs."""
    days = [r[0] for r in T.table(spark, sf, "events").select(F.to_date("ts")).distinct().collect()]
    text = lambda d: d.strftime("%Y-%m-%d")
    rows = []
    for day in days:
        now = datetime(day.year, day.month, day.day, 15, tzinfo=UTC)
        custom = calendar.custom(datetime(day.year, day.month, day.day), calendar.preset("today", now).end.replace(tzinfo=None))
        week = calendar.preset("week", now)
        rows.append((text(day), text(calendar.chart(calendar.preset("today", now)).start), text(custom.end), text(calendar.previous("week", week).start), text(calendar.last_included_day(custom))))
    return spark.createDataFrame(rows, "day string, chart_start string, custom_end string, week_before string, shown_end string")




@register("""WITH g AS (SELECT * FROM (SELECT unnest([0, 1, 50, 200, 201]) AS page), (SELECT unnest([-1, 0, 7]) AS start), (SELECT unnest([0, 200, 201]) AS letters), (SELECT unnest(['recent', 'tokens', 'cost', 'name']) AS sort), (SELECT unnest([-1, 0, 1]) AS days))
SELECT *, page BETWEEN 1 AND 200 AND start >= 0 AND letters <= 200 AND sort <> 'name' AND days > 0 AS accepted, CASE WHEN page BETWEEN 1 AND 200 AND start >= 0 AND letters <= 200 AND sort <> 'name' AND days > 0 AND letters > 0 THEN letters END AS searched FROM g""")
def request_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Which requests for a page of conversations are accepted, over a grid of sizes, offsets, searches, orders and ranges."""
    rows = []
    for page in (0, 1, 50, 200, 201):
        for start in (-1, 0, 7):
            for letters in (0, 200, 201):
                for sort in ("recent", "tokens", "cost", "name"):
                    for days in (-1, 0, 1):
                        times = reports.Filter("2024-01-02T00:00:00Z", f"2024-01-0{2 + days}T00:00:00Z")
                        try:
                            got = reports.ConversationQuery(times, search=f" {'x' * letters} ", sort=sort, limit=page, offset=start).checked()
                            rows.append((page, start, letters, sort, days, True, got.search and len(got.search)))
                        except ValueError:
                            rows.append((page, start, letters, sort, days, False, None))
    return spark.createDataFrame(rows, "page int, start int, letters int, sort string, days int, accepted boolean, searched int")


@register("SELECT * FROM (VALUES ('again', true), ('another rate', false), ('one row less', false), ('rows the other way', true)) AS x(change, same)")
def catalog_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog's fingerprint follows its rows and nothing else."""
    c = T.catalog(spark)
    print_ = pricing.fingerprint(c)
    changed = {"again": c, "rows the other way": c.orderBy(F.desc("model_prefix"), "speed"), "another rate": c.withColumn("output_rate", F.when(F.col("model_prefix") == "brand#1", F.col("output_rate") + 1).otherwise(F.col("output_rate"))), "one row less": c.where("NOT (model_prefix = 'brand#1' AND speed = 'fast' AND source = 'codex' AND priority = 2)")}
    return spark.createDataFrame([(k, pricing.fingerprint(v) == print_) for k, v in changed.items()], "change string, same boolean")


@register("SELECT CAST(event_id AS VARCHAR) AS provider, ['none', 'major', 'unknown'][event_id % 4 + 1] AS indicator, CASE WHEN user_id % 2 = 0 THEN event_type END AS description, CASE WHEN event_id % 4 <> 1 THEN strftime(ts, '%Y-%m-%d') END AS updated_at FROM events WHERE event_id % 4 < 3")
def service_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Status pages of services; a page without an indicator says nothing."""
    from ledgerloom.plans import readings

    k, c = F.col("event_id") % 4, F.col
    status = F.struct(F.when(k == 0, "none").when(k == 1, "major").when(k == 2, "on fire").alias("indicator"), F.when(c("user_id") % 2 == 0, c("event_type")).alias("description"))
    page = F.struct(F.when(k != 1, F.date_format("ts", "yyyy-MM-dd")).alias("updated_at"))
    return readings.service_states(T.table(spark, sf, "events").select(c("event_id").cast("string").alias("provider"), F.to_json(F.struct(status.alias("status"), page.alias("page"))).alias("body")))


@register(f"WITH {Q._ENTRIES}, s AS (SELECT * FROM t WHERE source <> 'pi' AND uncached_input_tokens > 0) SELECT source, count(*) AS n FROM s WHERE reasoning_output_tokens <= output_tokens AND CAST(file_key AS BIGINT) % 5 <> 0 GROUP BY source")
def valid_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that the ledger accepts among those with an unknown source, a negative count, or more reasoning than output."""
    e = T.entries(spark, sf).where("uncached_input_tokens > 0")
    k = F.col("file_key").cast("long") % 5
    e = e.withColumns({"source": F.when(F.col("source") == "pi", "other").otherwise(F.col("source")), "output_tokens": F.when(k == 0, F.when(F.col("file_key").cast("long") % 2 == 0, F.lit(-1)).otherwise(F.col("reasoning_output_tokens") - 1)).otherwise(F.col("output_tokens"))})
    return ledger.valid_entries(e).groupBy("source").agg(F.count("*").alias("n"))
