"""Column sets of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCES = ("codex", "claude", "pi", "opencode")
#: Sources that are priced by the catalog; the others bring their own costs.
CATALOG_SOURCES = ("codex", "claude")
TOKENS = ("uncached_input_tokens", "cache_read_input_tokens", "cache_write_5m_input_tokens", "cache_write_1h_input_tokens", "output_tokens", "reasoning_output_tokens")
PRICE_COLUMNS = ("api_equivalent_cost_nanos", "billing_equivalent_tokens_nanos", "fast_multiplier_nanos", "pricing_fingerprint")

# fixed values: the names of the ledger's columns
_STRINGS = ("file_key", "source", "dedup_key", "conversation_key", "model", "speed", "inference_geo")
ENTRIES = T.StructType(
    [T.StructField(c, T.StringType()) for c in _STRINGS]
    + [T.StructField("occurred_at", T.TimestampType()), T.StructField("day_local", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in (*TOKENS, *PRICE_COLUMNS[:3])]
    + [T.StructField("pricing_fingerprint", T.StringType()), T.StructField("seq", T.StringType())]
)
#: What a fact says about its conversation, in the order it was read.
CONVERSATION_FACTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("conversation_key", "source", "title", "project_hint", "source_id", "branch")]
    + [T.StructField("is_sidechain", T.BooleanType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("seq", T.StringType())]
)
CONVERSATIONS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("conversation_key", "source", "title", "project_hint", "source_id", "branch")]
    + [T.StructField("is_sidechain", T.BooleanType()), T.StructField("first_at", T.TimestampType()), T.StructField("last_at", T.TimestampType())]
)
QUOTA_EVENTS = T.StructType([
    T.StructField("provider", T.StringType()), T.StructField("identity", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("window_id", T.StringType()),
    T.StructField("remaining", T.DoubleType()), T.StructField("resets_at", T.TimestampType()), T.StructField("observed_at", T.TimestampType()),
])
RATES = ("uncached_rate", "cache_read_rate", "cache_write_5m_rate", "cache_write_1h_rate", "output_rate")
CATALOG = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("source", "model_prefix", "speed")]
    + [T.StructField("effective_from", T.TimestampType()), T.StructField("effective_until", T.TimestampType())]
    + [T.StructField(c, T.LongType()) for c in (*RATES, "us_bps", "long_threshold", "long_input_bps", "long_output_bps")]
    + [T.StructField("long_priced", T.BooleanType()), T.StructField("priority", T.IntegerType())]
)
