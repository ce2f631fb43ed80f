"""Quota windows and their change-only history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import documents as D
from ledgerloom.functions import scalars as S

SERIES = ["provider", "identity", "kind", "window_id"]
_V = "v"


def codex_windows(responses: DataFrame) -> DataFrame:
    """One row per window of quota responses (response_id, captured_at, body); null kind for an unknown length."""
    rows = responses.withColumn("v", D.parse(F.col("body"))).where(D.has(_V, "$.rate_limit.primary_window"))
    window = lambda name, place: F.when(D.has(_V, f"$.rate_limit.{name}"), F.struct(F.lit(place).alias("place"), D.number(_V, f"$.rate_limit.{name}.used_percent").alias("used"), D.number(_V, f"$.rate_limit.{name}.reset_at").alias("at"), D.number(_V, f"$.rate_limit.{name}.reset_after_seconds").alias("after"), D.number(_V, f"$.rate_limit.{name}.limit_window_seconds").alias("seconds")))
    flat = rows.select("response_id", "captured_at", S.plan_label(D.text(_V, "$.plan_type")).alias("plan"), F.explode(F.array_compact(F.array(window("primary_window", 0), window("secondary_window", 1)))).alias("w"))
    kind = S.window_kind(F.col("w.seconds"))
    return flat.select("response_id", "captured_at", "plan", F.col("w.place").alias("place"), kind.alias("kind"), F.when(kind == "unknown", F.concat(F.lit("unknown-"), F.col("w.seconds").cast("long").cast("string"))).otherwise(kind).alias("window_id"), S.remaining_percent(F.col("w.used")).alias("remaining"), S.reset_time(F.col("w.at"), F.col("w.after"), F.col("captured_at")).alias("resets_at"))


def _when(v, path):
    """A reset time that is a text or a number of seconds."""
    return F.coalesce(S.rfc3339(D.text(v, path)), S.epoch_seconds(D.number(v, path)))


#: Legacy window fields with kind, id and rank: session, weekly, then models.
LEGACY = (("five_hour", "five_hour", "five_hour", 0), ("seven_day", "weekly", "weekly", 1), ("seven_day_opus", "model", "model-opus", 2), ("seven_day_sonnet", "model", "model-sonnet", 2))


def claude_windows(responses: DataFrame) -> DataFrame:
    """Dynamic limits where a response has them, with resets filled from the legacy fields; else the legacy fields alone.

    Order: session, weekly, models, unknown. A repeated id replaces the earlier window in place.
    """
    rows = responses.withColumn("v", D.parse(F.col("body"))).select("response_id", "captured_at", "v", F.try_variant_get("v", "$.limits", "array<variant>").alias("limits"))
    legacy = F.array_compact(F.array(*[F.when(D.has(_V, f"$.{f}.utilization"), F.struct(F.lit(k).alias("kind"), F.lit(i).alias("window_id"), F.lit(r).alias("rank"), S.remaining_percent(D.number(_V, f"$.{f}.utilization")).alias("remaining"), _when(_V, f"$.{f}.resets_at").alias("resets_at"))) for f, k, i, r in LEGACY]))
    old = rows.select("response_id", "captured_at", F.size(F.coalesce("limits", F.array().cast("array<variant>"))).alias("_n"), F.posexplode(legacy).alias("pos", "w")).select("response_id", "captured_at", "_n", "pos", "w.*")
    item = rows.select("response_id", "captured_at", F.posexplode("limits").alias("pos", "x"))
    x = F.col("x")
    kind_text = F.lower(D.text(x, "$.kind"))
    scope = F.coalesce(*[D.text(x, f"$.scope.{a}{b}") for a in ("model", "surface") for b in ("", ".display_name", ".name", ".id")])
    kind = F.when(scope.isNotNull(), "model").when(kind_text.isin("session", "five_hour"), "five_hour").when(kind_text.isin("weekly", "weekly_all", "seven_day"), "weekly").otherwise("unknown")
    rank = F.when(kind == "five_hour", 0).when(kind == "weekly", 1).when(kind == "model", 2).otherwise(3)
    new_id = F.when(kind == "model", F.concat(F.lit("model-"), S.slug(scope))).when(kind == "unknown", F.concat(F.lit("unknown-"), S.slug(kind_text))).otherwise(kind)
    new = item.where(D.number(x, "$.percent").isNotNull()).select("response_id", "captured_at", "pos", kind.alias("kind"), new_id.alias("window_id"), rank.alias("rank"), S.remaining_percent(D.number(x, "$.percent")).alias("remaining"), _when(x, "$.resets_at").alias("resets_at"))
    last = F.max_by(F.struct("kind", "rank", "remaining", "resets_at"), "pos")
    new = new.groupBy("response_id", "captured_at", "window_id").agg(F.min("pos").alias("pos"), last.alias("w")).select("response_id", "captured_at", "pos", "window_id", "w.*")
    fill = old.select(F.col("response_id").alias("_r"), F.col("window_id").alias("_w"), F.col("resets_at").alias("_at"))
    same = (F.col("response_id") == F.col("_r")) & ((F.col("window_id") == F.col("_w")) | ((F.col("kind") == "model") & F.col("_w").startswith("model-") & F.contains(F.col("window_id"), F.substring("_w", 7, 100))))
    filled = new.join(fill, same, "left").groupBy(*new.columns).agg(F.min("_at").alias("_at")).withColumn("resets_at", F.coalesce("resets_at", "_at")).drop("_at")
    both = filled.unionByName(old.where("_n = 0").drop("_n"))
    place = F.row_number().over(Window.partitionBy("response_id").orderBy("rank", "pos")) - 1
    return both.withColumn("place", place).drop("pos", "rank")


def change_only(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Points whose whole remaining percentage differs from the one before in their series."""
    by = Window.partitionBy(*SERIES).orderBy(*(order or ["observed_at"]))
    rows = events.withColumn("remaining_percent", S.whole_percent(F.col("remaining")))
    before = F.lag("remaining_percent").over(by)
    return rows.withColumn("_before", before).withColumn("_first", F.row_number().over(by) == 1).where(F.col("_first") | ~F.col("remaining_percent").eqNullSafe(F.col("_before"))).drop("_before", "_first")


def valid_events(events: DataFrame) -> DataFrame:
    """Points that a history accepts: a provider, a window of a known kind, a time, and a share between 0 and 100 where there is one."""
    named = F.col("provider").isNotNull() & F.col("window_id").isNotNull() & F.col("kind").isin("five_hour", "weekly", "model", "unknown") & F.col("observed_at").isNotNull()
    return events.where(named & (F.col("remaining").isNull() | F.col("remaining").between(0, 100)))


def append_changes(history: DataFrame, events: DataFrame) -> DataFrame:
    """New points that change their series, given the last known point of each."""
    last = history.groupBy(*SERIES).agg(F.max_by("remaining_percent", "observed_at").alias("_known"))
    by = Window.partitionBy(*SERIES).orderBy("observed_at")
    rows = events.withColumn("remaining_percent", S.whole_percent(F.col("remaining"))).join(last, SERIES, "left")
    return rows.withColumn("_before", F.coalesce(F.lag("remaining_percent").over(by), F.col("_known"))).where(~F.col("remaining_percent").eqNullSafe(F.col("_before"))).drop("_before", "_known")


def history(events: DataFrame, provider: str, start=None, end=None, limit: int | None = None, most: int = 200, default: int = 50, tie: str | None = None) -> DataFrame:
    """The latest points of a provider in a half-open range, oldest first."""
    rows = events.where(F.col("provider") == provider)
    rows = rows.where(F.col("observed_at") >= F.lit(start).cast("timestamp")) if start is not None else rows
    rows = rows.where(F.col("observed_at") < F.lit(end).cast("timestamp")) if end is not None else rows
    ties = [tie] if tie else []
    n = max(1, min(most, default if limit is None else limit))
    return rows.orderBy(F.desc("observed_at"), *[F.desc(t) for t in ties]).limit(n).orderBy("observed_at", *ties)


def deltas(events: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Each point with its change since the one before (null first)."""
    by = Window.partitionBy(*SERIES).orderBy("observed_at", "remaining_percent", *(ties or []))
    return events.withColumn("delta", F.col("remaining_percent") - F.lag("remaining_percent").over(by))


def active_series(events: DataFrame) -> DataFrame:
    """Per provider the series with the latest point; of several the first by name."""
    last = events.groupBy(*SERIES).agg(F.max("observed_at").alias("last_at"))
    first = Window.partitionBy("provider").orderBy(F.desc("last_at"), "identity", "kind", "window_id")
    return last.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def day_delta(events: DataFrame, day: str, zone: str = "UTC", ties: list[str] | None = None) -> DataFrame:
    """Last minus first point of a local day, per series; series without a point that day have null."""
    here = S.local_day(F.col("observed_at"), zone) == day
    at = F.struct("observed_at", *(ties or []))
    change = F.max_by("remaining_percent", F.when(here, at)) - F.min_by("remaining_percent", F.when(here, at))
    return events.groupBy(*SERIES).agg(change.alias("delta"))


def carry_resets(snapshots: DataFrame) -> DataFrame:
    """A window without a reset time keeps its series' last one while that is still ahead."""
    by = Window.partitionBy(*SERIES).orderBy("observed_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.last("resets_at", ignorenulls=True).over(by)
    return snapshots.withColumn("resets_at", F.coalesce("resets_at", F.when(known > F.col("observed_at"), known)))


def identity_changes(snapshots: DataFrame) -> DataFrame:
    """Snapshots at which a provider's known identity became another known one."""
    by = Window.partitionBy("provider").orderBy("observed_at").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last("identity", ignorenulls=True).over(by)
    return snapshots.withColumn("previous_identity", known).where("identity IS NOT NULL AND previous_identity IS NOT NULL AND identity != previous_identity")


def stale(snapshots: DataFrame, now, interval_seconds: int) -> DataFrame:
    """Snapshots older than twice the interval."""
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("observed_at")
    return snapshots.withColumn("stale", age > 2 * interval_seconds)


def worst_provider(states: DataFrame) -> DataFrame:
    """The provider of highest severity, the first in `place` of several."""
    return states.agg(F.max_by("provider", F.struct("severity", -F.col("place"))).alias("provider"), F.max("severity").alias("severity"))
