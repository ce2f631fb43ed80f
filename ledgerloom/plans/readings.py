"""Quota readings and service states of providers, kept between runs in a small cache file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import documents as D
from ledgerloom.functions import scalars as S
from ledgerloom.plans import scheduling
from ledgerloom.sources import folders

CACHE_VERSION = 1


def read_cache(spark: SparkSession, path: str) -> dict | None:
    """The cached readings by provider; a file of another version, or one that is no such document, is deleted and counts as absent."""
    text = folders.read_text(spark, path)
    if text is None:
        return None
    try:
        document = json.loads(text)
        if document["version"] == CACHE_VERSION and isinstance(document["providers"], dict):
            return document["providers"]
    except (ValueError, KeyError, TypeError):
        pass
    folders.delete(spark, path)
    return None


def write_cache(spark: SparkSession, path: str, providers: dict) -> None:
    folders.write_text(spark, path, json.dumps({"version": CACHE_VERSION, "providers": providers}))


def service_states(bodies: DataFrame) -> DataFrame:
    """indicator, description, updated_at of status pages (provider, body); a body without an indicator gives no row."""
    rows = bodies.withColumn("v", D.parse(F.col("body"))).where(D.text("v", "$.status.indicator").isNotNull())
    return rows.select("provider", S.service_indicator(D.text("v", "$.status.indicator")).alias("indicator"), D.text("v", "$.status.description").alias("description"), D.text("v", "$.page.updated_at").alias("updated_at"))


@dataclass
class Readings:
    """What is known of each provider: snapshots, how refreshing went, and when it may be tried again."""

    spark: SparkSession
    path: str
    states: dict[str, scheduling.RefreshState] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, kept in (read_cache(self.spark, self.path) or {}).items():
            self.states[name] = scheduling.RefreshState(**kept)

    def snapshot(self, provider: str) -> dict | None:
        return self.states.get(provider, scheduling.RefreshState()).snapshot

    def refresh(self, provider: str, now: float, fetch, manual: bool = True) -> str:
        """What became of the wish: merge, block, throttle, or the outcome of `fetch`, which gives (outcome, snapshot, identity, retry after)."""
        state = self.states.get(provider, scheduling.RefreshState())
        decision = scheduling.decide(state, now, manual)
        if decision != "begin":
            return decision
        self.states[provider] = scheduling.begin(state)
        outcome, snapshot, identity, wait = fetch()
        self.states[provider] = scheduling.apply(self.states[provider], now, outcome, snapshot, identity, wait)
        write_cache(self.spark, self.path, {k: asdict(replace(s, running=False)) for k, s in self.states.items()})
        return outcome
