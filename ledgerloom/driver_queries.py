"""Registered queries over the star-schema tables: each applies an operator of the library, beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom import driver_tables as T
from ledgerloom.functions import scalars as S
from ledgerloom.operators import audit, ledger, pricing, quota
from ledgerloom.operators.metrics import MEASURES, cache_rates, total_tokens
from ledgerloom.plans import calendar, reports
from ledgerloom.schema import TOKENS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
AS_OF = datetime(2000, 1, 1, tzinfo=UTC)


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- shared inputs


def unpriced(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.deduplicate(T.entries(spark, sf), T.ORDER)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    catalog = T.catalog(spark)
    return pricing.price(unpriced(spark, sf), catalog, T.FINGERPRINT, pricing.derived_multipliers(catalog, AS_OF))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The conversation dimension, merged from all parsed facts."""
    rows = T.entries(spark, sf).join(T.conversation_columns(spark, sf), "conversation_key", "left")
    rows = rows.withColumns({"source_id": F.col("conversation_key"), "branch": F.when(F.col("speed") == "fast", F.col("file_key")), "is_sidechain": F.col("inference_geo") == "us", "_rank": F.col("source")})
    return ledger.merge_conversations(rows, [*T.ORDER, "_rank", "dedup_key"])


def iso(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_ENTRIES = """
e AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS file_key, CASE l_returnflag WHEN 'A' THEN 'codex' WHEN 'N' THEN 'claude' ELSE 'pi' END AS source,
    l_orderkey || '-' || l_linenumber AS dedup_key, CAST(l_orderkey AS VARCHAR) AS conversation_key, p_brand AS model,
    CASE l_linestatus WHEN 'F' THEN 'fast' ELSE 'standard' END AS speed,
    CASE l_linenumber % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'global' ELSE 'unknown' END AS inference_geo,
    CAST(l_shipdate AS TIMESTAMP) AS occurred_at, strftime(l_shipdate, '%Y-%m-%d') AS day_local,
    CAST(round(l_quantity) AS BIGINT) AS uncached_input_tokens, CAST(round(l_discount * 100) AS BIGINT) AS cache_read_input_tokens,
    CAST(round(l_tax * 100) AS BIGINT) AS cache_write_5m_input_tokens,
    CAST(CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END AS BIGINT) AS cache_write_1h_input_tokens,
    CAST(round(l_extendedprice) AS BIGINT) AS output_tokens, CAST(round(l_extendedprice) AS BIGINT) // 2 AS reasoning_output_tokens,
    CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS BIGINT) * 1000 END AS own_cost
  FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT *, uncached_input_tokens + cache_read_input_tokens + cache_write_5m_input_tokens + cache_write_1h_input_tokens AS input,
  uncached_input_tokens + cache_read_input_tokens + cache_write_5m_input_tokens + cache_write_1h_input_tokens + output_tokens AS total FROM e)"""
_SEQ = "occurred_at, file_key, model, uncached_input_tokens, cache_read_input_tokens, cache_write_5m_input_tokens, output_tokens"
_SEQ_DESC = ", ".join(f"{c} DESC" for c in _SEQ.split(", "))
_FACTS = _ENTRIES + f""",
u AS MATERIALIZED (
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY source, dedup_key ORDER BY total DESC, {_SEQ}) AS r FROM t WHERE source <> 'pi') WHERE r = 1
  UNION ALL
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY source, dedup_key ORDER BY {_SEQ_DESC}) AS r FROM t WHERE source = 'pi') WHERE r = 1)"""


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_CATALOG = f"""
c AS MATERIALIZED (SELECT source, model_prefix, speed, CAST(f AS TIMESTAMP) AS effective_from, CAST(u AS TIMESTAMP) AS effective_until, a, b, w5, w1, o, us, threshold, lin, lout, long_priced, priority
  FROM (VALUES {_values(T.catalog_rows())}) AS x(source, model_prefix, speed, f, u, a, b, w5, w1, o, us, threshold, lin, lout, long_priced, priority))"""
_DERIVED = """
now AS (SELECT *, row_number() OVER (PARTITION BY source, speed, model_prefix ORDER BY priority, effective_from NULLS FIRST) AS r FROM c
  WHERE source = 'claude' AND coalesce(effective_from <= TIMESTAMP '2000-01-01', true) AND coalesce(TIMESTAMP '2000-01-01' < effective_until, true)),
m AS MATERIALIZED (SELECT s.model_prefix AS model, CAST(1000000000 * CAST(f.a AS HUGEINT) // s.a AS BIGINT) AS multiplier FROM now s JOIN now f ON s.model_prefix = f.model_prefix AND s.r = 1 AND f.r = 1 AND s.speed = 'standard' AND f.speed = 'fast'
  WHERE (1000000000 * CAST(f.a AS HUGEINT)) % s.a = 0 AND 1000000000 * CAST(f.a AS HUGEINT) // s.a = 1000000000 * CAST(f.o AS HUGEINT) // s.o
    AND 1000000000 * CAST(f.a AS HUGEINT) // s.a = 1000000000 * CAST(f.b AS HUGEINT) // s.b AND 1000000000 * CAST(f.a AS HUGEINT) // s.a = 1000000000 * CAST(f.w5 AS HUGEINT) // s.w5)"""
_PRICED = (
    _FACTS + "," + _CATALOG + "," + _DERIVED + f""",
l AS MATERIALIZED (SELECT u.source, u.dedup_key, c.* EXCLUDE (source, speed), row_number() OVER (PARTITION BY u.source, u.dedup_key ORDER BY c.priority, length(c.model_prefix) DESC, c.model_prefix, c.effective_from NULLS FIRST) AS r
  FROM u JOIN c ON u.source = c.source AND u.speed = c.speed AND lower(u.model) = c.model_prefix
    AND coalesce(u.occurred_at >= c.effective_from, true) AND coalesce(u.occurred_at < c.effective_until, true)
  WHERE NOT (u.source = 'codex' AND u.speed = 'fast' AND u.input > 272000)),
q AS (SELECT u.*, l.model_prefix, l.effective_from, l.priority,
    CASE WHEN u.source = 'pi' THEN u.own_cost WHEN l.model_prefix IS NULL OR (coalesce(u.input > l.threshold, false) AND NOT l.long_priced) THEN NULL ELSE CAST((
      ((CAST(u.uncached_input_tokens AS HUGEINT) * l.a + CAST(u.cache_read_input_tokens AS HUGEINT) * l.b + CAST(u.cache_write_5m_input_tokens AS HUGEINT) * l.w5 + CAST(u.cache_write_1h_input_tokens AS HUGEINT) * l.w1)
        * CASE WHEN coalesce(u.input > l.threshold, false) THEN l.lin ELSE 10000 END
      + CAST(u.output_tokens AS HUGEINT) * l.o * CASE WHEN coalesce(u.input > l.threshold, false) THEN l.lout ELSE 10000 END)
      * CASE WHEN u.inference_geo = 'us' THEN l.us ELSE 10000 END + 50000000000000) // 100000000000000 AS BIGINT) END AS cost,
    CASE WHEN u.source = 'claude' AND u.speed = 'fast' THEN u.total * m.multiplier END AS billing, CASE WHEN u.source = 'claude' AND u.speed = 'fast' THEN m.multiplier END AS multiplier
  FROM u LEFT JOIN l ON u.source = l.source AND u.dedup_key = l.dedup_key AND l.r = 1 LEFT JOIN m ON lower(u.model) = m.model),
f AS (SELECT *, CASE WHEN source <> 'pi' AND cost IS NOT NULL THEN '{T.FINGERPRINT}' END AS print FROM q)"""
)
_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in TOKENS)
_MEASURES = f"""count(*) AS entries, {_SUMS},
  CAST(coalesce(sum(CASE WHEN speed = 'fast' THEN total END), 0) AS BIGINT) AS fast_raw_tokens, CAST(coalesce(sum(CASE WHEN speed = 'fast' THEN billing END), 0) AS BIGINT) AS fast_billing_nanos,
  min(CASE WHEN speed = 'fast' THEN multiplier END) AS fast_multiplier_min, max(CASE WHEN speed = 'fast' THEN multiplier END) AS fast_multiplier_max,
  count(CASE WHEN speed = 'fast' AND billing IS NULL THEN 1 END) AS unpriced_fast, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost_nanos, count(cost) AS priced, count(CASE WHEN cost IS NULL THEN 1 END) AS unpriced,
  count(CASE WHEN source = 'claude' AND inference_geo = 'unknown' AND cost IS NOT NULL THEN 1 END) AS assumed_geo, CASE WHEN count(DISTINCT print) = 1 THEN max(print) END AS pricing_fingerprint"""
_GROUPS = {"day": "day_local", "source": "source", "model": "coalesce(model, '')", "speed": "speed"}


def _summary_sql(by: str, where: str = "") -> str:
    return f"WITH {_PRICED} SELECT {_GROUPS[by]} AS group_key, {_MEASURES} FROM f {where} GROUP BY 1"


# ---------------------------------------------------------------- summaries

for _by in _GROUPS:
    QUERIES[f"summary_by_{_by}"] = lambda spark, sf, by=_by: reports.summary(facts(spark, sf), by).select("group_key", *MEASURES)
    ORACLE[f"summary_by_{_by}"] = _summary_sql(_by)
_RANGE = reports.Filter("1997-01-01T00:00:00Z", "1999-07-01T02:00:00+02:00", source="claude", speed="fast")


@register(_summary_sql("model", "WHERE occurred_at >= TIMESTAMP '1997-01-01' AND occurred_at < TIMESTAMP '1999-07-01' AND source = 'claude' AND speed = 'fast'"))
def summary_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return reports.summary(facts(spark, sf), "model", _RANGE).select("group_key", *MEASURES)


_TOTAL_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in MEASURES[:-3])


def _totals_sql(by: str) -> str:
    return f"""WITH {_PRICED}, g AS (SELECT {_GROUPS[by]} AS group_key, {_MEASURES} FROM f GROUP BY 1)
SELECT {_TOTAL_SUMS}, min(fast_multiplier_min) AS fast_multiplier_min, max(fast_multiplier_max) AS fast_multiplier_max,
  CASE WHEN count(CASE WHEN priced > 0 AND pricing_fingerprint IS NULL THEN 1 END) = 0 AND count(DISTINCT pricing_fingerprint) = 1 THEN max(pricing_fingerprint) END AS pricing_fingerprint FROM g"""


@register(_totals_sql("source"))
def summary_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.summary_totals(facts(spark, sf), "source").select(*MEASURES)


@register(_totals_sql("day"))
def summary_totals_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return reports.summary_totals(facts(spark, sf), "day").select(*MEASURES)


@register(f"""WITH {_PRICED}, w AS (SELECT * FROM f WHERE occurred_at >= TIMESTAMP '1998-01-01' AND occurred_at < TIMESTAMP '1998-03-01' AND source IN ('codex', 'claude'))
SELECT 'source' AS level, source, NULL AS day, NULL AS model, {_MEASURES} FROM w GROUP BY source
UNION ALL SELECT 'day', source, day_local, NULL, {_MEASURES} FROM w GROUP BY source, day_local
UNION ALL SELECT 'model', source, NULL, coalesce(model, ''), {_MEASURES} FROM w GROUP BY source, coalesce(model, '')""")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    r = calendar.Range(datetime(1998, 1, 1, tzinfo=UTC), datetime(1998, 3, 1, tzinfo=UTC))
    return reports.dashboard(facts(spark, sf), r, ["codex", "claude"]).select("level", "source", "day", "model", *MEASURES)


@register(f"""WITH {_PRICED}, d AS (SELECT strftime(x, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-01-31', INTERVAL 1 DAY)) AS x)),
s AS (SELECT unnest(['codex', 'claude', 'opencode']) AS source)
SELECT d.day, s.source, CAST(coalesce(sum(f.total), 0) AS BIGINT) AS total_tokens FROM d CROSS JOIN s LEFT JOIN f ON f.day_local = d.day AND f.source = s.source GROUP BY ALL""")
def daily_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    return reports.daily_series(facts(spark, sf), "1998-01-01", "1998-01-31", ["codex", "claude", "opencode"])


@register(f"""WITH {_PRICED}, g AS (SELECT CAST(coalesce(sum(CASE WHEN occurred_at >= TIMESTAMP '1998-02-01' AND occurred_at < TIMESTAMP '1998-03-01' THEN total END), 0) AS BIGINT) AS current,
  CAST(coalesce(sum(CASE WHEN occurred_at >= TIMESTAMP '1998-01-04' AND occurred_at < TIMESTAMP '1998-02-01' THEN total END), 0) AS BIGINT) AS previous FROM f WHERE source IN ('codex', 'pi'))
SELECT *, CASE WHEN previous > 0 THEN CAST((current - previous) AS DOUBLE) * 100 / previous END AS change_percent FROM g""")
def previous_period_delta(spark: SparkSession, sf: str) -> DataFrame:
    now = calendar.preset("month", datetime(1998, 2, 10, tzinfo=UTC))
    out = reports.period_change(facts(spark, sf), now, calendar.previous("month", now), ["codex", "pi"])
    return out.withColumn("change_percent", F.when(F.col("previous") > 0, (F.col("current") - F.col("previous")).cast("double") * 100 / F.col("previous")))


@register(f"WITH {_PRICED}, g AS (SELECT source, CAST(sum(total) AS BIGINT) AS total FROM f GROUP BY source) SELECT source, total, CAST(total AS DOUBLE) * 100 / CAST(sum(total) OVER () AS BIGINT) AS share_percent FROM g")
def source_share(spark: SparkSession, sf: str) -> DataFrame:
    return reports.shares(facts(spark, sf).groupBy("source").agg(F.sum(total_tokens()).alias("total"))).select("source", "total", (F.col("total").cast("double") * 100 / F.sum("total").over(Window.partitionBy())).alias("share_percent"))


@register(f"""WITH {_PRICED}, g AS (SELECT source, sum(cache_read_input_tokens) AS r, sum(input) AS i, sum(total) AS t FROM f GROUP BY source)
SELECT source, CAST(round(least(100, r * 100.0 / i)) AS INTEGER) AS cache_rate_of_input_rounded, CAST(round(least(100, r * 100.0 / t)) AS INTEGER) AS cache_rate_of_total_rounded FROM g""")
def cache_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    rates = cache_rates()
    return reports.summary(facts(spark, sf), "source").select(F.col("group_key").alias("source"), *[rates[n].alias(n) for n in ("cache_rate_of_input_rounded", "cache_rate_of_total_rounded")])


@register(f"WITH {_PRICED}, g AS (SELECT coalesce(model, '') AS group_key, count(cost) AS priced, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost_nanos FROM f GROUP BY 1) SELECT group_key, priced, cost_nanos, row_number() OVER (ORDER BY CASE WHEN priced > 0 THEN cost_nanos ELSE -1 END DESC, group_key) AS place FROM g")
def model_table_by_cost(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.model_table(reports.summary(facts(spark, sf), "model"), "cost")
    key = F.when(F.col("priced") > 0, F.col("cost_nanos")).otherwise(-1)
    return rows.select("group_key", "priced", "cost_nanos", F.row_number().over(Window.orderBy(key.desc(), "group_key")).cast("long").alias("place"))


# ---------------------------------------------------------------- ledger

_COLUMNS = ["source", "dedup_key", "file_key", "day_local", "model", "uncached_input_tokens", "output_tokens"]


@register(f"WITH {_FACTS} SELECT {', '.join(_COLUMNS)} FROM u WHERE source <> 'pi'")
def dedup_keep_largest(spark: SparkSession, sf: str) -> DataFrame:
    return unpriced(spark, sf).where("source != 'pi'").select(*_COLUMNS)


@register(f"WITH {_FACTS} SELECT {', '.join(_COLUMNS)} FROM u WHERE source = 'pi'")
def dedup_last_write(spark: SparkSession, sf: str) -> DataFrame:
    return unpriced(spark, sf).where("source = 'pi'").select(*_COLUMNS)


@register(f"""WITH {_ENTRIES}, b AS (SELECT *, max(total) OVER (PARTITION BY source, dedup_key ORDER BY {_SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
a AS (SELECT count(CASE WHEN before IS NULL OR source = 'pi' OR total > before THEN 1 END) AS inserted, count(*) AS n FROM b) SELECT inserted, n - inserted AS duplicates FROM a""")
def insert_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.insert_counters(T.entries(spark, sf).withColumn("seq", F.struct(*T.ORDER)))


_CONV = f"""
x AS (SELECT t.*, o_orderpriority AS title, c_mktsegment AS project_hint, CASE WHEN speed = 'fast' THEN file_key END AS branch,
    row_number() OVER (PARTITION BY conversation_key ORDER BY {_SEQ}, source, dedup_key) AS s
  FROM t LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = conversation_key LEFT JOIN customer ON o_custkey = c_custkey),
v AS (SELECT conversation_key, arg_min(source, s) AS source, arg_max(title, s) FILTER (title IS NOT NULL) AS title, arg_max(project_hint, s) FILTER (project_hint IS NOT NULL) AS project_hint,
    arg_max(branch, s) FILTER (branch IS NOT NULL) AS branch, max(inference_geo = 'us') AS is_sidechain, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM x GROUP BY conversation_key)"""


@register(f"WITH {_ENTRIES}, {_CONV} SELECT conversation_key, source, title, project_hint, branch, is_sidechain, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM v")
def conversation_merge(spark: SparkSession, sf: str) -> DataFrame:
    return conversations(spark, sf).select("conversation_key", "source", "title", "project_hint", "branch", "is_sidechain", iso("first_at"), iso("last_at"))


def _page_sql(order: str, where: str = "", page: str = "LIMIT 50") -> str:
    return f"""WITH {_PRICED}, {_CONV}, g AS (SELECT conversation_key, {_MEASURES} FROM f {where} GROUP BY 1), n AS (SELECT conversation_key, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM f GROUP BY 1)
SELECT g.conversation_key, v.title, v.project_hint, n.models, g.entries, g.output_tokens, g.cost_nanos, strftime(v.last_at, '%Y-%m-%d %H:%M:%S') AS last_at
FROM g JOIN v USING (conversation_key) JOIN n USING (conversation_key) ORDER BY {order} DESC, g.conversation_key {page}"""


def _page(spark: SparkSession, sf: str, query: reports.ConversationQuery) -> DataFrame:
    out = reports.conversation_page(facts(spark, sf), conversations(spark, sf), query)
    return out.select("conversation_key", "title", "project_hint", F.array_join("models", ",").alias("models"), "entries", "output_tokens", "cost_nanos", iso("last_at"))


_TOTAL = "g.uncached_input_tokens + g.cache_read_input_tokens + g.cache_write_5m_input_tokens + g.cache_write_1h_input_tokens + g.output_tokens"


@register(_page_sql("v.last_at", "WHERE source IN ('codex', 'claude')", "LIMIT 50 OFFSET 20"))
def conversation_list_recent(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, reports.ConversationQuery(sources=("codex", "claude"), offset=20))


@register(_page_sql(f"({_TOTAL})"))
def conversation_list_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, reports.ConversationQuery(sort="tokens"))


@register(_page_sql("g.cost_nanos", "WHERE speed = 'fast' AND occurred_at >= TIMESTAMP '1998-01-01'"))
def conversation_list_cost(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, reports.ConversationQuery(reports.Filter("1998-01-01T00:00:00Z", speed="fast"), sort="cost"))


@register(_page_sql("v.last_at", "WHERE conversation_key IN (SELECT conversation_key FROM v WHERE contains(lower(coalesce(title, '')), 'high') OR contains(lower(coalesce(project_hint, '')), 'high'))", "LIMIT 200"))
def conversation_search(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, reports.ConversationQuery(search=" HIgh ", limit=200))


@register(f"WITH {_PRICED}, {_CONV} SELECT count(DISTINCT f.conversation_key) AS total FROM f JOIN v USING (conversation_key) WHERE v.project_hint = 'MACHINERY' AND f.speed = 'standard'")
def conversation_count(spark: SparkSession, sf: str) -> DataFrame:
    return reports.conversation_count(facts(spark, sf), conversations(spark, sf), reports.ConversationQuery(reports.Filter(speed="standard"), project="MACHINERY"))


@register(f"WITH {_PRICED}, {_CONV} SELECT v.project_hint AS project, count(DISTINCT v.conversation_key) AS conversations, strftime(max(v.last_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM v WHERE v.project_hint IS NOT NULL AND v.conversation_key IN (SELECT conversation_key FROM f WHERE source = 'claude' AND occurred_at >= TIMESTAMP '2001-01-01') GROUP BY 1")
def conversation_projects(spark: SparkSession, sf: str) -> DataFrame:
    return reports.project_options(facts(spark, sf), conversations(spark, sf), "2001-01-01T00:00:00Z", None, ["claude"]).select("project", "conversations", iso("last_at"))


@register(f"WITH {_FACTS} SELECT conversation_key, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM u WHERE model IS NOT NULL GROUP BY 1")
def conversation_models(spark: SparkSession, sf: str) -> DataFrame:
    return reports.conversation_models(unpriced(spark, sf)).select("conversation_key", F.array_join("models", ",").alias("models"))


@register(f"WITH {_PRICED}, {_CONV} SELECT f.conversation_key, any_value(v.title) AS title, {_MEASURES} FROM (SELECT * FROM f WHERE conversation_key = '7') f JOIN (SELECT conversation_key, title FROM v) v USING (conversation_key) GROUP BY f.conversation_key")
def conversation_detail(spark: SparkSession, sf: str) -> DataFrame:
    return reports.conversation(facts(spark, sf), conversations(spark, sf), "7").select("conversation_key", "title", *MEASURES)


@register(f"WITH {_PRICED}, w AS (SELECT * FROM f WHERE conversation_key = '7') SELECT 'model' AS level, coalesce(model, '') AS group_key, {_MEASURES} FROM w GROUP BY 2 UNION ALL SELECT 'speed', speed, {_MEASURES} FROM w GROUP BY 2")
def conversation_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return reports.conversation_breakdown(facts(spark, sf), "7").select("level", "group_key", *MEASURES)


@register("SELECT CAST(o_orderkey AS VARCHAR) AS conversation_key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.orphans(T.conversation_columns(spark, sf).select("conversation_key"), T.entries(spark, sf))


@register(f"WITH {_FACTS} SELECT source, count(*) AS entries FROM u WHERE CAST(file_key AS BIGINT) % 7 <> 0 GROUP BY source")
def file_reset(spark: SparkSession, sf: str) -> DataFrame:
    rewritten = T.table(spark, sf, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").cast("string").alias("file_key"))
    return ledger.reset_files(unpriced(spark, sf), rewritten).groupBy("source").agg(F.count("*").alias("entries"))


@register(f"WITH {_FACTS} SELECT source, speed, count(*) AS entries FROM u WHERE source NOT IN ('pi') GROUP BY source, speed")
def rebuild_sources(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.rebuild(unpriced(spark, sf), ["pi"]).groupBy("source", "speed").agg(F.count("*").alias("entries"))


# ---------------------------------------------------------------- prices


@register(f"WITH {_PRICED} SELECT source, dedup_key, model_prefix, priority, strftime(effective_from, '%Y-%m-%d') AS effective_from FROM f WHERE source <> 'pi'")
def price_lookup_temporal(spark: SparkSession, sf: str) -> DataFrame:
    rows = unpriced(spark, sf).where("source != 'pi'").withColumn("_model", S.price_model(F.col("source"), F.col("model")))
    e = pricing.matching_entry(F.col("occurred_at"))
    rows = pricing.with_entries(rows, T.catalog(spark))
    return rows.select("source", "dedup_key", e["model_prefix"].alias("model_prefix"), e["priority"].alias("priority"), F.date_format(e["effective_from"], "yyyy-MM-dd").alias("effective_from"))


@register(f"WITH {_PRICED} SELECT source, dedup_key, cost AS api_equivalent_cost_nanos, print AS pricing_fingerprint FROM f")
def price_cost_nanos(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("source", "dedup_key", "api_equivalent_cost_nanos", "pricing_fingerprint")


@register(f"WITH {_PRICED} SELECT inference_geo, coalesce(input > 60000, false) AS long_request, count(cost) AS priced, CAST(sum(cost) AS BIGINT) AS cost_nanos, count(CASE WHEN source = 'claude' AND inference_geo = 'unknown' AND cost IS NOT NULL THEN 1 END) AS assumed FROM f WHERE source = 'claude' GROUP BY ALL")
def price_longctx_geo(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).where("source = 'claude'")
    return rows.groupBy("inference_geo", (pricing.input_tokens() > 60_000).alias("long_request")).agg(F.count("api_equivalent_cost_nanos").alias("priced"), F.sum("api_equivalent_cost_nanos").alias("cost_nanos"), F.count(F.when(F.col("assumed_geo"), 1)).alias("assumed"))


@register(f"WITH {_PRICED} SELECT source, dedup_key, billing AS billing_equivalent_tokens_nanos, multiplier AS fast_multiplier_nanos FROM f WHERE speed = 'fast'")
def fast_equivalent(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).where("speed = 'fast'").select("source", "dedup_key", "billing_equivalent_tokens_nanos", "fast_multiplier_nanos")


@register(f"WITH {_CATALOG}, {_DERIVED} SELECT model, multiplier FROM m")
def derived_multipliers(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.derived_multipliers(T.catalog(spark), AS_OF).select(F.col("_model").alias("model"), F.col("_derived").alias("multiplier"))


@register(f"WITH {_PRICED} SELECT count(CASE WHEN source <> 'pi' AND (cost IS NOT NULL OR billing IS NOT NULL) THEN 1 END) AS updated, count(CASE WHEN source <> 'pi' AND cost IS NOT NULL THEN 1 END) AS priced, count(CASE WHEN source <> 'pi' AND cost IS NULL THEN 1 END) AS unpriced FROM f")
def reprice_changes(spark: SparkSession, sf: str) -> DataFrame:
    catalog = T.catalog(spark)
    return pricing.reprice(unpriced(spark, sf), catalog, T.FINGERPRINT, pricing.derived_multipliers(catalog, AS_OF))[1]


@register(f"WITH {_PRICED} SELECT DISTINCT source, lower(model) AS model, speed FROM f WHERE source <> 'pi' AND cost IS NULL AND trim(coalesce(model, '')) <> '' AND speed <> 'unknown'")
def unpriced_keys(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.price_keys(facts(spark, sf))


@register(f"WITH {_PRICED} SELECT DISTINCT f.source, lower(f.model) AS model, f.speed FROM f WHERE source <> 'pi' AND NOT EXISTS (SELECT 1 FROM c WHERE c.source = f.source AND c.speed = f.speed AND c.model_prefix = lower(f.model))")
def missing_price_keys(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.missing_keys(pricing.price_keys(unpriced(spark, sf), only_unpriced=False), T.catalog(spark))


@register(f"WITH {_CATALOG}, k AS (SELECT *, row_number() OVER (PARTITION BY source, speed, model_prefix ORDER BY effective_from NULLS FIRST, effective_until NULLS LAST) AS n FROM c) SELECT a.source, a.speed, a.model_prefix, count(*) AS pairs FROM k a JOIN k b ON a.source = b.source AND a.speed = b.speed AND a.model_prefix = b.model_prefix AND a.n < b.n AND coalesce(b.effective_from < a.effective_until, true) AND coalesce(a.effective_from < b.effective_until, true) GROUP BY ALL")
def catalog_overlap_check(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerloom.sources.catalog import overlaps

    return overlaps(T.catalog(spark)).groupBy("source", "speed", "model_prefix").agg(F.count("*").alias("pairs"))


@register(f"WITH {_CATALOG}, k AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'codex' ELSE 'claude' END AS source, CASE l_linestatus WHEN 'F' THEN 'fast' ELSE 'standard' END AS speed, lower(p_brand) AS model FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'), h AS (SELECT c.*, min(c.priority) OVER (PARTITION BY k.source, k.speed, k.model) AS best FROM k JOIN c ON k.source = c.source AND k.speed = c.speed AND k.model = c.model_prefix) SELECT source, speed, count(*) AS n FROM (SELECT DISTINCT * FROM h WHERE priority = best) GROUP BY ALL")
def catalog_scope(spark: SparkSession, sf: str) -> DataFrame:
    li = T.table(spark, sf, "lineitem").join(T.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    keys = li.where("l_returnflag != 'R'").select(F.when(F.col("l_returnflag") == "A", "codex").otherwise("claude").alias("source"), F.when(F.col("l_linestatus") == "F", "fast").otherwise("standard").alias("speed"), S.normalize_model_key(F.col("p_brand")).alias("model")).distinct()
    return pricing.scoped(T.catalog(spark), keys).groupBy("source", "speed").agg(F.count("*").alias("n"))


_LIST_A = "(VALUES ('gpt-9', 'standard', 2000000000, 0), ('gpt-9', 'fast', 4000000000, 0), ('mini-9', 'standard', 10000000, 5))"
_LIST_B = "(VALUES ('gpt-9', 'standard', 9000000000, 1), ('gpt-9', 'fast', 5000000000, 1), ('deep-9', 'standard', 300000000, 2))"


@register(f"WITH a AS (SELECT * FROM {_LIST_A} AS x(model, speed, rate, cache)), b AS (SELECT * FROM {_LIST_B} AS x(model, speed, rate, cache)) SELECT coalesce(a.model, b.model) AS model, coalesce(a.speed, b.speed) AS speed, CAST(CASE WHEN coalesce(a.speed, b.speed) = 'standard' THEN coalesce(a.rate, b.rate) ELSE coalesce(b.rate, a.rate) END AS BIGINT) AS rate FROM a FULL JOIN b ON a.model = b.model AND a.speed = b.speed")
def catalog_layer_merge(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerloom.sources.catalog import read_list_a, read_list_b, remote_layer

    a = '{"gpt-9": {"litellm_provider": "openai", "input_cost_per_token": 2e-6, "output_cost_per_token": 1e-5, "input_cost_per_token_priority": 0.000004, "output_cost_per_token_priority": 2e-5}, "x/gpt-9": {"litellm_provider": "openai", "input_cost_per_token": 1, "output_cost_per_token": 1}, "mini-9": {"litellm_provider": "deepseek", "input_cost_per_token": 1e-8, "output_cost_per_token": 1e-8}, "other": {"litellm_provider": "nobody", "input_cost_per_token": 1, "output_cost_per_token": 1}}'
    b = '{"openai": {"models": {"gpt-9": {"cost": {"input": 9, "output": 30}, "experimental": {"modes": {"fast": {"cost": {"input": 5, "output": 50}}}}}}}, "deepseek": {"models": {"deep-9": {"cost": {"input": 0.3, "output": 1}}}}}'
    out = remote_layer(read_list_a(spark, a), read_list_b(spark, b), T.catalog(spark), ("codex",))
    return out.select(F.col("model_prefix").alias("model"), "speed", F.col("uncached_rate").alias("rate"))


@register("SELECT p_brand || '-2024-01-02' AS raw, lower(p_brand) AS key FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'OpenAI/' || p_brand || '@20240102', lower(p_brand) FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT ' ' || p_brand || '-20240102 ', lower(p_brand) FROM (SELECT DISTINCT p_brand FROM part)")
def model_key_normalize(spark: SparkSession, sf: str) -> DataFrame:
    b = T.table(spark, sf, "part").select("p_brand").distinct()
    raw = b.select(F.explode(F.array(F.concat("p_brand", F.lit("-2024-01-02")), F.concat(F.lit("OpenAI/"), "p_brand", F.lit("@20240102")), F.concat(F.lit(" "), "p_brand", F.lit("-20240102 ")))).alias("raw"))
    return raw.select("raw", S.normalize_model_key(F.col("raw")).alias("key"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(n AS BIGINT) AS nanos, CASE WHEN n % 1000000000 = 0 THEN CAST(n // 1000000000 AS VARCHAR) ELSE rtrim(CAST(n // 1000000000 AS VARCHAR) || '.' || lpad(CAST(n % 1000000000 AS VARCHAR), 9, '0'), '0') END AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey AS BIGINT) * 1234500 * l_suppkey AS n FROM lineitem)")
def nanos_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") * 1_234_500 * F.col("l_suppkey")).cast("long").alias("nanos")).distinct()
    return rows.withColumn("text", S.nanos_to_text(F.col("nanos")))


# ---------------------------------------------------------------- quota

_QUOTA = "q AS (SELECT event_type AS provider, CAST(user_id AS VARCHAR) AS identity, event_id, ts AS observed_at, CAST(greatest(0, least(100, round(100.0 - value))) AS INTEGER) AS remaining_percent FROM events)"
_CHANGES = f"{_QUOTA}, h AS (SELECT *, lag(remaining_percent) OVER (PARTITION BY provider, identity ORDER BY observed_at, event_id) AS before FROM q), k AS (SELECT * FROM h WHERE before IS NULL OR before <> remaining_percent)"


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return quota.change_only(T.quota_events(spark, sf), ["observed_at", "event_id"])


@register(f"WITH {_CHANGES} SELECT provider, identity, event_id, remaining_percent FROM k")
def quota_change_only(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("provider", "identity", "event_id", "remaining_percent")


@register(f"WITH {_CHANGES} SELECT event_id, remaining_percent FROM k WHERE provider = 'click' AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-20' ORDER BY observed_at DESC, event_id DESC LIMIT 50")
def quota_history_latest_n(spark: SparkSession, sf: str) -> DataFrame:
    return quota.history(_changes(spark, sf), "click", datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC), tie="event_id").select("event_id", "remaining_percent")


@register(f"WITH {_CHANGES} SELECT provider, identity, event_id, remaining_percent, remaining_percent - lag(remaining_percent) OVER (PARTITION BY provider, identity ORDER BY observed_at, remaining_percent, event_id) AS delta FROM k")
def quota_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return quota.deltas(_changes(spark, sf), ["event_id"]).select("provider", "identity", "event_id", "remaining_percent", "delta")


@register(f"WITH {_CHANGES}, a AS (SELECT provider, identity, max(observed_at) AS last_at FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY last_at DESC, identity) AS n FROM a) SELECT provider, identity FROM r WHERE n = 1")
def quota_active_series(spark: SparkSession, sf: str) -> DataFrame:
    return quota.active_series(_changes(spark, sf)).select("provider", "identity")


@register(f"WITH {_CHANGES} SELECT provider, identity, arg_max(remaining_percent, (observed_at, event_id)) FILTER (strftime(observed_at, '%Y-%m-%d') = '2024-01-10') - arg_min(remaining_percent, (observed_at, event_id)) FILTER (strftime(observed_at, '%Y-%m-%d') = '2024-01-10') AS delta FROM k GROUP BY provider, identity")
def quota_today_delta(spark: SparkSession, sf: str) -> DataFrame:
    return quota.day_delta(_changes(spark, sf), "2024-01-10", ties=["event_id"]).select("provider", "identity", "delta")


@register(f"WITH {_QUOTA} SELECT event_id, CASE WHEN remaining_percent <= 0 THEN 'danger' WHEN remaining_percent < 20 THEN 'low' WHEN remaining_percent <= 50 THEN 'warning' ELSE 'ok' END AS tone FROM q")
def quota_tone(spark: SparkSession, sf: str) -> DataFrame:
    return T.quota_events(spark, sf).select("event_id", S.quota_tone(S.whole_percent(F.col("remaining"))).alias("tone"))


@register("WITH e AS (SELECT *, last_value(CASE WHEN user_id % 3 <> 0 THEN user_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events) SELECT event_type AS provider, count(*) AS changes FROM e WHERE user_id % 3 <> 0 AND p IS NOT NULL AND p <> user_id GROUP BY event_type")
def identity_change(spark: SparkSession, sf: str) -> DataFrame:
    e = T.quota_events(spark, sf).withColumns({"identity": F.when(F.col("identity").cast("long") % 3 != 0, F.col("identity")), "observed_at": F.struct("observed_at", "event_id")})
    return quota.identity_changes(e).groupBy("provider").agg(F.count("*").alias("changes"))


@register("""WITH e AS (SELECT event_type, event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 HOUR END AS reset FROM events),
k AS (SELECT *, last_value(reset IGNORE NULLS) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM e)
SELECT event_id, strftime(coalesce(reset, CASE WHEN known > ts THEN known END), '%Y-%m-%d %H:%M:%S') AS resets_at FROM k""")
def reset_carry_over(spark: SparkSession, sf: str) -> DataFrame:
    e = T.quota_events(spark, sf).withColumn("resets_at", F.when(F.col("event_id") % 4 == 0, F.col("observed_at") + F.expr("INTERVAL 1 HOUR")))
    return quota.carry_resets(e).select("event_id", iso("resets_at"))


@register("SELECT event_id, greatest(0.0, least(100.0, 100.0 - value)) AS remaining, CASE WHEN event_id % 3 = 0 THEN 'five_hour' WHEN event_id % 3 = 1 THEN 'weekly' ELSE 'unknown' END AS kind, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS resets_at FROM events")
def quota_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seconds = F.when(F.col("event_id") % 3 == 0, 18_000).when(F.col("event_id") % 3 == 1, 604_800).otherwise(60)
    body = F.to_json(F.struct(F.lit("pro").alias("plan_type"), F.struct(F.struct(F.col("value").alias("used_percent"), F.lit(90.0).alias("reset_after_seconds"), seconds.alias("limit_window_seconds")).alias("primary_window")).alias("rate_limit")))
    out = quota.codex_windows(e.select(F.col("event_id").alias("response_id"), F.col("ts").alias("captured_at"), body.alias("body")))
    return out.select(F.col("response_id").alias("event_id"), "remaining", "kind", iso("resets_at"))


# ---------------------------------------------------------------- lines, titles, audit


@register("""WITH k AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations) SELECT conv_id, turn, role, CAST(carried AS BIGINT) AS carried FROM k""")
def carry_forward_model(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.last(F.when(F.col("role") == "user", F.struct(F.length("text").alias("x"))), ignorenulls=True).over(order)["x"]
    return T.table(spark, sf, "conversations").select("conv_id", "turn", "role", value.cast("long").alias("carried"))


_CLEAN = "nullif(substr(trim(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), '^<', '')), 1, 80), '')"


@register(f"SELECT conv_id, arg_min({_CLEAN}, (turn, text)) FILTER (role = 'user' AND {_CLEAN} IS NOT NULL) AS title FROM conversations GROUP BY conv_id")
def first_user_title(spark: SparkSession, sf: str) -> DataFrame:
    title = S.clean_title(F.col("text"))
    return T.table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by(title, F.when((F.col("role") == "user") & title.isNotNull(), F.struct("turn", "text"))).alias("title"))


@register(f"SELECT doc_id, {_CLEAN} AS title FROM documents")
def title_clean(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").select("doc_id", S.clean_title(F.col("text")).alias("title"))


@register("WITH k AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts FROM events), h AS (SELECT *, lag(k // 10) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM k) SELECT user_id, count(*) AS facts FROM h WHERE before IS NULL OR before <> k // 10 GROUP BY user_id")
def repeated_total_collapse(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerloom.functions import documents as D

    e = T.table(spark, sf, "events").withColumn("v", D.parse(F.col("props"))).withColumn("sig", F.floor(D.integer(F.col("v"), "$.k") / 10))
    before = F.lag("sig").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("before", before).where("before IS NULL OR before != sig").groupBy("user_id").agg(F.count("*").alias("facts"))




_AUDIT = f"""WITH {_PRICED}, a AS (SELECT day_local AS day, source, model, speed, CAST(sum(input) AS BIGINT) AS i FROM f GROUP BY ALL),
b AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, CASE l_returnflag WHEN 'A' THEN 'codex' WHEN 'N' THEN 'claude' ELSE 'opencode' END AS source, p_brand AS model, CASE l_linestatus WHEN 'F' THEN 'fast' ELSE 'standard' END AS speed, CAST(sum(round(l_quantity)) AS BIGINT) AS i FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
j AS (SELECT a.i AS x, b.i AS y FROM a FULL JOIN b ON a.day = b.day AND a.source = b.source AND a.model = b.model AND a.speed = b.speed)
SELECT CASE WHEN y IS NULL THEN 'only_ours' WHEN x IS NULL THEN 'only_theirs' WHEN x = y THEN 'equal' ELSE 'differs' END AS state, count(*) AS n FROM j GROUP BY 1"""


@register(_AUDIT)
def audit_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    ours = facts(spark, sf).groupBy(F.col("day_local").alias("day"), "source", "model", "speed").agg(F.sum(total_tokens() - F.col("output_tokens")).alias("input_tokens"))
    raw = T.entries(spark, sf).withColumn("source", F.when(F.col("source") == "pi", "opencode").otherwise(F.col("source")))
    theirs = raw.groupBy(F.col("day_local").alias("day"), "source", "model", "speed").agg(F.sum("uncached_input_tokens").alias("input_tokens"))
    return audit.compare(ours, theirs, values=("input_tokens",)).groupBy("state").agg(F.count("*").alias("n"))


@register("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT strftime(l_shipdate, '%Y-%m-%d') FROM lineitem WHERE l_returnflag = 'N'")
def audit_days(spark: SparkSession, sf: str) -> DataFrame:
    days = T.entries(spark, sf).select("source", F.col("day_local").alias("day"))
    return audit.common_days(days.where("source = 'codex'"), days.where("source = 'claude'"))


@register(f"""WITH {_ENTRIES}, {_CONV}, d AS (SELECT conversation_key, CAST(round((epoch_ms(last_at) - epoch_ms(first_at)) / 60000.0) AS BIGINT) AS m FROM v)
SELECT conversation_key, CASE WHEN m // 60 > 0 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE m || 'm' END AS duration FROM d""")
def conversation_durations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations(spark, sf).select("conversation_key", S.rounded_minutes_text(F.col("first_at"), F.col("last_at")).alias("duration"))


@register("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events)
SELECT event_id, strftime(d, '%Y-%m-%d') AS today, strftime(CAST(date_trunc('week', d) AS DATE), '%Y-%m-%d') AS week, strftime(CAST(date_trunc('month', d) AS DATE), '%Y-%m-%d') AS month,
  strftime(CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE), '%Y-%m-%d') AS last_month, strftime(CAST(date_trunc('year', d) AS DATE), '%Y-%m-%d') AS year FROM e""")
def calendar_presets(spark: SparkSession, sf: str) -> DataFrame:
    """Starts of the presets at each event's day, from the days that occur."""
    e = T.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("d"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return e.select("event_id", text("d").alias("today"), text(F.date_trunc("week", "d")).alias("week"), text(F.date_trunc("month", "d")).alias("month"), text(F.add_months(F.date_trunc("month", "d"), -1)).alias("last_month"), text(F.date_trunc("year", "d")).alias("year"))
