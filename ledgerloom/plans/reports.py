"""What callers ask of a ledger: validated requests in, DataFrames out."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import scalars as S
from ledgerloom.operators.metrics import MEASURES, WIDE, cache_rates, grand_total, measured, measured_sets, total_tokens
from ledgerloom.plans.calendar import Range

#: Default and largest page, longest search, most sources, longest key.
PAGE, MAX_PAGE, MAX_SEARCH, MAX_SOURCES, MAX_KEY = 50, 200, 200, 8, 128


def group_expression(by: str) -> Column:
    """The four groupings; a missing model groups under the empty string."""
    if by == "model":
        return F.coalesce("model", F.lit(""))
    names = {"day": "day_local", "source": "source", "speed": "speed"}
    if by not in names:
        raise ValueError(f"cannot group by {by}")
    return F.col(names[by])


def instant(text: str | datetime | None) -> datetime | None:
    if text is None or isinstance(text, datetime):
        return text
    if not re.match(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$", text):
        raise ValueError("not an RFC 3339 time")
    return datetime.fromisoformat(text)


@dataclass(frozen=True)
class Filter:
    """Half-open times and optional equalities; only what is given becomes a predicate, so it reaches the scan."""

    start: str | datetime | None = None
    end: str | datetime | None = None
    source: str | None = None
    model: str | None = None
    speed: str | None = None

    def checked(self) -> Filter:
        start, end = instant(self.start), instant(self.end)
        if start is not None and end is not None and start >= end:
            raise ValueError("the range is empty")
        model = (self.model or "").strip() or None
        if model is not None and len(model) > MAX_SEARCH:
            raise ValueError("the model name is too long")
        return replace(self, start=start, end=end, model=model)

    def apply(self, entries: DataFrame) -> DataFrame:
        f, out = self.checked(), entries
        if f.start is not None:
            out = out.where(F.col("occurred_at") >= F.lit(f.start))
        if f.end is not None:
            out = out.where(F.col("occurred_at") < F.lit(f.end))
        for name in ("source", "model", "speed"):
            if getattr(f, name) is not None:
                out = out.where(F.col(name) == getattr(f, name))
        return out


def in_sources(rows: DataFrame, sources: list[str] | None, column: str = "source") -> DataFrame:
    """No list is no filter; an empty list matches nothing."""
    if sources is None:
        return rows
    if len(sources) > MAX_SOURCES:
        raise ValueError("too many sources")
    return rows.where(F.col(column).isin(*sources)) if sources else rows.where(F.lit(False))


def summary(entries: DataFrame, by: str, where: Filter | None = None) -> DataFrame:
    """One row per group with all measures, in key order."""
    rows = (where or Filter()).apply(entries)
    return measured(rows, group_key=group_expression(by)).orderBy("group_key")


def summary_totals(entries: DataFrame, by: str, where: Filter | None = None) -> DataFrame:
    """The grand total over the groups, with the two-level rule for the fingerprint."""
    rows = (where or Filter()).apply(entries)
    return grand_total(measured(rows, group_key=group_expression(by)))


def dashboard(entries: DataFrame, r: Range, sources: list[str] | None = None) -> DataFrame:
    """Summaries by source, by source and day, and by source and model of a range, in one pass of grouping sets."""
    rows = in_sources(Filter(r.start, r.end).apply(entries), sources)
    sets, totals = measured_sets(rows, [["source"], ["source", "day"], ["source", "_model"]], source=F.col("source"), day=F.col("day_local"), _model=group_expression("model"))
    level = F.when(F.grouping("day") == 0, "day").when(F.grouping("_model") == 0, "model").otherwise("source")
    return sets.agg(level.alias("level"), *totals).select("level", "source", "day", F.col("_model").alias("model"), *MEASURES, *WIDE.values())


@dataclass(frozen=True)
class ConversationQuery:
    where: Filter = Filter()
    search: str | None = None
    project: str | None = None
    sources: tuple[str, ...] | None = None
    sort: str = "recent"
    limit: int = PAGE
    offset: int = 0

    def checked(self) -> ConversationQuery:
        search = (self.search or "").strip() or None
        if search is not None and len(search) > MAX_SEARCH:
            raise ValueError("the search text is too long")
        if not 1 <= self.limit <= MAX_PAGE or self.offset < 0 or self.sort not in ("recent", "tokens", "cost"):
            raise ValueError("bad page or order")
        return replace(self, search=search, where=self.where.checked())


def _matching(entries: DataFrame, conversations: DataFrame, q: ConversationQuery) -> DataFrame:
    """Filtered facts of the conversations that match."""
    c = conversations
    if q.project is not None:
        c = c.where(F.col("project_hint") == q.project)
    if q.search is not None:
        c = c.where(S.contains_text(F.col("title"), q.search) | S.contains_text(F.col("project_hint"), q.search))
    facts = in_sources(q.where.apply(entries), None if q.sources is None else list(q.sources))
    return facts.join(c.select("conversation_key"), "conversation_key", "left_semi")


def conversation_count(entries: DataFrame, conversations: DataFrame, query: ConversationQuery | None = None) -> DataFrame:
    return _matching(entries, conversations, (query or ConversationQuery()).checked()).agg(F.count_distinct("conversation_key").alias("total"))


def conversation_models(entries: DataFrame) -> DataFrame:
    """(conversation_key, models): sorted distinct models, whatever the filters."""
    return entries.where("model IS NOT NULL").groupBy("conversation_key").agg(F.sort_array(F.collect_set("model")).alias("models"))


def conversation_page(entries: DataFrame, conversations: DataFrame, query: ConversationQuery | None = None) -> DataFrame:
    """A page of conversations: measures over the filtered facts; title, times and models over all.

    First only what the order needs is computed, for all conversations that match; then the page's keys, MAX_PAGE at most, are
    literals of the filters on facts and conversations, so that everything else is computed for the page alone.
    """
    q = (query or ConversationQuery()).checked()
    found = _matching(entries, conversations, q)
    if q.sort == "recent":
        ranked = conversations.join(found.select("conversation_key").distinct(), "conversation_key", "left_semi").select("conversation_key", F.col("last_at").alias("_by"))
    else:
        value = total_tokens() if q.sort == "tokens" else F.col("api_equivalent_cost_nanos")
        ranked = found.groupBy("conversation_key").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_by")).join(conversations.select("conversation_key"), "conversation_key", "left_semi")
    keys = [r[0] for r in ranked.orderBy(F.desc("_by"), "conversation_key").offset(q.offset).limit(q.limit).select("conversation_key").collect()]  # at most MAX_PAGE
    ours = lambda df: df.where(F.col("conversation_key").isin(*keys) if keys else F.lit(False))
    page = measured(ours(found), conversation_key=F.col("conversation_key")).join(ours(conversations), "conversation_key")
    key = {"recent": F.col("last_at"), "tokens": total_tokens(), "cost": F.col("cost_nanos")}[q.sort]
    return page.join(conversation_models(ours(entries)), "conversation_key", "left").orderBy(key.desc(), "conversation_key")


def project_options(entries: DataFrame, conversations: DataFrame, start=None, end=None, sources: list[str] | None = None) -> DataFrame:
    """Projects with their conversations and last use, latest first."""
    facts = in_sources(Filter(start, end).apply(entries), sources).select("conversation_key").distinct()
    rows = conversations.where("project_hint IS NOT NULL").join(facts, "conversation_key", "left_semi")
    return rows.groupBy(F.col("project_hint").alias("project")).agg(F.count_distinct("conversation_key").alias("conversations"), F.max("last_at").alias("last_at")).orderBy(F.desc("last_at"), "project")


def conversation(entries: DataFrame, conversations: DataFrame, key: str) -> DataFrame:
    """One conversation without filters; no row if it is unknown."""
    if not 1 <= len(key.encode()) <= MAX_KEY:
        raise ValueError("bad conversation key")
    facts = entries.where(F.col("conversation_key") == key)
    return measured(facts, conversation_key=F.col("conversation_key")).join(conversations.where(F.col("conversation_key") == key), "conversation_key").join(conversation_models(facts), "conversation_key", "left")


def conversation_breakdown(entries: DataFrame, key: str) -> DataFrame:
    """Measures of a conversation by model and by speed."""
    if not 1 <= len(key.encode()) <= MAX_KEY:
        raise ValueError("bad conversation key")
    facts = entries.where(F.col("conversation_key") == key)
    sets, totals = measured_sets(facts, [["_model"], ["_speed"]], _model=group_expression("model"), _speed=F.col("speed"))
    return sets.agg(F.when(F.grouping("_model") == 0, "model").otherwise("speed").alias("level"), F.coalesce("_model", "_speed").alias("group_key"), *totals).select("level", "group_key", *MEASURES, *WIDE.values())


def daily_series(entries: DataFrame, first_day: str, last_day: str, sources: list[str]) -> DataFrame:
    """Total tokens for every day and source of the calendar, zero where nothing was used."""
    spark = entries.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day)))).alias("d"))
    grid = days.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.explode(F.array(*map(F.lit, sources))).alias("source"))
    used = entries.where(F.col("day_local").between(first_day, last_day)).groupBy(F.col("day_local").alias("day"), "source").agg(F.sum(total_tokens()).alias("_t"))
    return grid.join(used, ["day", "source"], "left").select("day", "source", F.coalesce("_t", F.lit(0)).cast("long").alias("total_tokens")).orderBy("day", "source")


def period_change(entries: DataFrame, now: Range, before: Range, sources: list[str] | None = None) -> DataFrame:
    """Tokens of two ranges and the change in percent, null when there was nothing before. Both ranges see the same sources."""
    rows = in_sources(entries, sources)
    within = lambda r: (F.col("occurred_at") >= F.lit(r.start)) & (F.col("occurred_at") < F.lit(r.end))
    rows = rows.where(within(now) | within(before))
    total = lambda r: F.coalesce(F.sum(F.when(within(r), total_tokens())), F.lit(0)).cast("long")
    both = rows.agg(total(now).alias("current"), total(before).alias("previous"))
    return both.withColumn("change_percent", F.when(F.col("previous") > 0, (F.col("current") - F.col("previous")) * 100.0 / F.col("previous")))


def shares(rows: DataFrame, value: str = "total") -> DataFrame:
    """Each row's part of the whole, in percent; null of nothing. Rows are groups of a summary, few enough for one window."""
    whole = F.sum(value).over(Window.partitionBy())
    return rows.withColumn("share_percent", F.when(whole > 0, F.least(F.lit(100.0), F.col(value) * 100.0 / whole)))


def model_table(rows: DataFrame, sort: str = "total", descending: bool = True) -> DataFrame:
    """Summary rows by a column; what is not priced sorts as -1 by cost."""
    key = F.when(F.col("priced") > 0, F.col("cost_nanos")).otherwise(F.lit(-1)) if sort == "cost" else F.col(sort)
    return rows.orderBy(key.desc() if descending else key.asc(), "group_key")


def day_totals(entries: DataFrame, r: Range, sources: list[str] | None = None) -> DataFrame:
    """Per day what a tooltip shows: tokens, cost and the rounded cache rate."""
    rows = measured(in_sources(Filter(r.start, r.end).apply(entries), sources), day=F.col("day_local"))
    return rows.select("day", total_tokens().alias("total_tokens"), "cost_nanos", "priced", cache_rates()["cache_rate_of_input_rounded"].alias("cache_rate")).orderBy("day")
