"""Scalar rules of the ledger as Column expressions; none leaves code generation for Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NANOS = 1_000_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


#: The white space that trimming knows.
_WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(c, F.lit(_WHITE))


def optional_text(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(strip(c), F.lit(""))


def clean_title(c: Column) -> Column:
    """White space collapsed, one leading `<` dropped, trimmed, cut to 80 characters; empty becomes null."""
    collapsed = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.nullif(F.substring(F.trim(F.regexp_replace(collapsed, "^<", "")), 1, 80), F.lit(""))


def project_hint(c: Column, windows_paths: bool = False) -> Column:
    """Last component of a path, trimmed and cut to 120 characters; empty, `.` at the end and `..` aside, becomes null."""
    path = F.translate(c, "\\", "/") if windows_paths else c
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1))
    return F.nullif(F.substring(strip(F.when(last != "..", last)), 1, 120), F.lit(""))


def normalize_speed(c: Column) -> Column:
    s = ascii_lower(strip(c))
    return F.when(s.isin("default", "standard"), "standard").when(s.isin("fast", "priority"), "fast").otherwise("unknown")


def inference_geo(c: Column) -> Column:
    s = ascii_lower(c)
    return F.when(s == "us", "us").when(s == "global", "global").otherwise("unknown")


_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def rfc3339(c: Column) -> Column:
    """Instant of an RFC 3339 text with any offset; null when it is not one."""
    return F.when(c.rlike(_RFC3339), F.try_to_timestamp(F.regexp_replace(F.upper(c), " ", "T")))


def utc_millis(ts: Column) -> Column:
    """An instant as text with milliseconds and Z (the session runs in UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_day(ts: Column, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def usd_to_nanos(c: Column) -> Column:
    """A dollar amount in floating point, rounded half away from zero."""
    return F.round(c.cast("double") * F.lit(1e9)).cast("long")


def usd_text_to_nanos(c: Column) -> Column:
    """Exact: a non-negative decimal text of at most nine fraction digits, else null."""
    s = F.trim(c)
    return F.when(s.rlike(r"^\d+(\.\d{0,9})?$"), (F.regexp_replace(s, r"\.$", "").try_cast("decimal(38,9)") * NANOS).try_cast("decimal(38,0)").try_cast("long"))


def scaled_decimal(c: Column, scale: int) -> Column:
    """A decimal text, exponent allowed, times 10**scale, half up; null if negative, malformed or out of range."""
    ok = c.rlike(r"^\d+(\.\d*)?([eE][+-]?\d{1,3})?$")
    mantissa = F.regexp_extract(c, r"^([^eE]*)", 1)
    exponent = F.coalesce(F.nullif(F.regexp_extract(c, r"[eE]([+-]?\d+)$", 1), F.lit("")).cast("int"), F.lit(0)) + scale
    whole, fraction = F.regexp_extract(mantissa, r"^(\d+)", 1), F.regexp_extract(mantissa, r"\.(\d*)$", 1)
    digits, point = F.concat(whole, fraction), F.length(whole) + exponent
    left = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substring(digits, F.lit(1), point), F.greatest(point, F.lit(1)), "0"))
    next_digit = F.when(point >= 0, F.substring(digits, point + 1, F.lit(1))).otherwise(F.lit("0"))
    return F.when(ok & (point <= 38), (left.try_cast("decimal(38,0)") + F.when(next_digit >= "5", 1).otherwise(0)).try_cast("long"))


def nanos_to_text(c: Column) -> Column:
    """Nanos as decimal text without trailing zeros."""
    whole = F.call_function("div", c, F.lit(NANOS)).cast("string")
    return F.regexp_replace(F.concat(whole, F.lit("."), F.lpad((c % NANOS).cast("string"), 9, "0")), r"\.?0+$", "")


def sum_options(a: Column, b: Column) -> Column:
    """Null-aware addition: null only if both are."""
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def normalize_model_key(c: Column) -> Column:
    """Lower-cased name without vendor prefix and without date suffix."""
    v = ascii_lower(strip(c))
    v = F.regexp_replace(v, "^(?:openai/|anthropic/|deepseek/)", "")
    v = F.regexp_replace(v, r"^([^@]*)@[0-9]{8}$", "$1")
    v = F.regexp_replace(v, r"-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "")
    return F.regexp_replace(v, r"-[0-9]{8}$", "")


def price_model(source: Column, model: Column) -> Column:
    """The model key that prices are looked up by."""
    key = normalize_model_key(model)
    return F.when(source == "claude", F.translate(key, ".", "-")).otherwise(key)


def with_price_model(rows: DataFrame, name: str) -> DataFrame:
    """Adds price_model of `source` and `model` under a name, step by step: each pattern is only tried on names that can match it."""
    c = F.col(name)
    rows = rows.withColumn(name, ascii_lower(strip(F.col("model"))))
    rows = rows.withColumn(name, F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "^(?:openai/|anthropic/|deepseek/)", "")).otherwise(c))
    rows = rows.withColumn(name, F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, r"^([^@]*)@[0-9]{8}$", "$1")).otherwise(c))
    rows = rows.withColumn(name, F.when(F.substring(c, -11, 1) == "-", F.regexp_replace(c, r"-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "")).otherwise(c))
    rows = rows.withColumn(name, F.when(F.substring(c, -9, 1) == "-", F.regexp_replace(c, r"-[0-9]{8}$", "")).otherwise(c))
    return rows.withColumn(name, F.when((F.col("source") == "claude") & F.contains(c, F.lit(".")), F.translate(c, ".", "-")).otherwise(c))


def audit_model_key(c: Column) -> Column:
    """The audit's own rule: no anthropic/ prefix is known, and everything from `@` on is cut."""
    v = F.regexp_replace(F.lower(F.trim(c)), "^openai/", "")
    v = F.regexp_replace(v, "@.*$", "")
    return F.regexp_replace(v, r"-(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})$", "")


def model_matches(model: Column, prefix: Column) -> Column:
    """Equal, or the prefix followed by a dash and a calendar date."""
    rest = F.substring(model, F.length(prefix) + 2, F.length(model))
    dated = F.when(rest.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(rest, F.lit("yyyy-MM-dd"))).when(rest.rlike(r"^\d{8}$"), F.try_to_timestamp(rest, F.lit("yyyyMMdd")))
    return (model == prefix) | (F.startswith(model, F.concat(prefix, F.lit("-"))) & dated.isNotNull())


def ranges_overlap(from_a: Column, until_a: Column, from_b: Column, until_b: Column) -> Column:
    """Half-open ranges with open ends."""
    return F.coalesce(from_b < until_a, F.lit(True)) & F.coalesce(from_a < until_b, F.lit(True))


def slug(c: Column) -> Column:
    """Lower case, runs of other than letters and digits become one dash; empty becomes `unspecified`."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unspecified"))


def remaining_percent(used: Column) -> Column:
    return F.when(used.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - used)))


def whole_percent(remaining: Column) -> Column:
    """What history keeps: rounded, then clamped."""
    return F.when(remaining.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.round(remaining).cast("int"))))


def window_kind(seconds: Column) -> Column:
    """18 000 s is the five-hour window, 604 800 s the weekly one."""
    return F.when(seconds == 18_000, "five_hour").when(seconds == 604_800, "weekly").otherwise("unknown")


def epoch_seconds(c: Column) -> Column:
    """An instant from seconds in floating point, rounded to milliseconds; null when not finite."""
    return F.when(~F.isnan(c) & (F.abs(c) < 1e12), F.timestamp_millis(F.round(c * 1000).cast("long")))


def reset_time(reset_at: Column, reset_after: Column, captured: Column) -> Column:
    """Absolute seconds win over seconds from the capture."""
    relative = F.timestamp_millis((F.unix_millis(captured) + F.round(reset_after * 1000)).cast("long"))
    return F.coalesce(epoch_seconds(reset_at), relative)


def hash_parts(*parts: Column) -> Column:
    """SHA-256, in hex, of every part's little-endian 64-bit byte length and bytes."""
    pieces = []
    for p in parts:
        n = F.lpad(F.hex(F.octet_length(p)), 16, "0")
        little = F.concat(*[F.substring(n, 15 - 2 * i, 2) for i in range(8)])
        pieces += [F.unhex(little), F.encode(p, "UTF-8")]
    return F.sha2(F.concat(*pieces), 256)


def identity_key(provider: Column, *parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, each after a unit separator."""
    joined = F.concat(provider, *[F.concat(F.lit("\u001f"), p) for p in parts])
    return F.substring(F.sha2(F.encode(joined, "UTF-8"), 256), 1, 16)


def apple_day(seconds: Column, zone: str = "UTC") -> Column:
    """Local date of seconds since 2001-01-01."""
    return local_day(F.timestamp_seconds(seconds + 978_307_200), zone)


def speed_badge(fast: Column, total: Column) -> Column:
    return F.when((fast > 0) & (fast >= total), "fast").when(fast > 0, "mixed")


def quota_tone(remaining: Column, filled: Column | None = None) -> Column:
    """danger at 0, low under 20, warning to 50, ok above; none without a value."""
    tone = F.when(remaining <= 0, "danger").when(remaining < 20, "low").when(remaining <= 50, "warning").when(remaining.isNotNull(), "ok").otherwise("none")
    return tone if filled is None else F.when(filled, tone).otherwise("none")


def percent_text(c: Column) -> Column:
    """`<1%` for what would round to nothing but is something."""
    return F.when((c > 0) & (c < 1), "<1%").otherwise(F.concat(F.round(c).cast("int").cast("string"), F.lit("%")))


def _div(n: Column, by: int) -> Column:
    return F.call_function("div", n, F.lit(by))


def _half_up(n: Column, unit: int) -> Column:
    """A non-negative integer in units, rounded half up in whole numbers."""
    n = n.cast("long")
    return _div(n, unit) + F.when(n % unit * 2 >= unit, 1).otherwise(0)


def _hundredths(n: Column, unit: int) -> Column:
    """Rounded hundredths of a unit: one division of the exact multiple in floating point, as SQL states it."""
    return F.round((n.cast("decimal(36,0)") * 100).cast("double") / unit).cast("long")


def _grouped(n: Column, digits: int = 0) -> Column:
    """A non-negative integer of hundredths (or of ones) with thousands separators, as `format_number` writes it."""
    if not digits:
        return F.format_number(n, 0)
    return F.concat(F.format_number(_div(n, 100), 0), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def compact_tokens(c: Column, chinese: bool = False) -> Column:
    """Two digits with K, M, B, or with the Chinese units for ten thousand and hundred million."""
    short = lambda n: F.regexp_replace(_grouped(_hundredths(c, n), 2), r"\.?0+$", "")
    if chinese:
        return F.when(c >= 10**8, F.concat(short(10**8), F.lit("亿"))).when(c >= 10**4, F.concat(short(10**4), F.lit("万"))).otherwise(c.cast("string"))
    return F.when(c >= 10**9, F.concat(short(10**9), F.lit("B"))).when(c >= 10**6, F.concat(short(10**6), F.lit("M"))).when(c >= 1000, F.concat(short(1000), F.lit("K"))).otherwise(c.cast("string"))


def cost_text(nanos: Column, priced: Column) -> Column:
    """Full dollars and cents; null when nothing is priced; a marker for what is under one cent but not nothing."""
    return F.when(priced <= 0, F.lit(None)).when((nanos > 0) & (nanos < NANOS // 100), "<$0.01").otherwise(F.concat(F.lit("$"), _grouped(_half_up(F.greatest(nanos, F.lit(0)), NANOS // 100), 2)))


def compact_cost_text(nanos: Column) -> Column:
    """Whole dollars; `$0` for nothing, `<$1` below one."""
    return F.when(nanos <= 0, "$0").when(nanos < NANOS, "<$1").otherwise(F.concat(F.lit("$"), _grouped(_half_up(nanos, NANOS))))


def duration_text(seconds: Column) -> Column:
    """The two largest units of days, hours and minutes, without a second one that is zero; `<1m` below a minute."""
    m = F.floor(F.greatest(seconds, F.lit(0)) / 60)
    h, d = F.floor(m / 60), F.floor(m / 1440)
    s = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    rest = lambda x, unit: F.when(x > 0, s(x, unit)).otherwise("")
    return F.when(m < 1, "<1m").when(h < 1, s(m, "m")).when(d < 1, F.concat(s(h, "h"), rest(m % 60, "m"))).otherwise(F.concat(s(d, "d"), rest(h % 24, "h")))


def age_text(seconds: Column) -> Column:
    """Seconds within the first minute; null within the first second, which readers are told in words."""
    return F.when(seconds < 1, F.lit(None)).when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s"))).otherwise(duration_text(seconds))


def rounded_minutes_text(first: Column, last: Column) -> Column:
    """Length of a conversation in rounded minutes."""
    m = F.round((F.unix_millis(last) - F.unix_millis(first)) / 60_000).cast("long")
    h = F.floor(m / 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit("m")))


def like_escape(c: Column) -> Column:
    r"""`\`, `%` and `_` escaped for LIKE ... ESCAPE '\'."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def contains_text(c: Column, needle: str) -> Column:
    """Substring search that folds ASCII case only; null counts as empty."""
    return F.contains(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(needle.translate(str.maketrans(_UPPER, _LOWER))))


def http_class(status: Column) -> Column:
    return F.when(status.between(200, 299), "ok").when(status == 429, "rate_limited").when(status.isin(401, 403), "unauthorized").otherwise("error")


def service_indicator(c: Column) -> Column:
    """Known indicator texts; anything else is unknown."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("none", "minor", "major", "critical", "maintenance"), s).otherwise("unknown")


def provider_severity(availability: Column, freshness: Column, refreshing: Column, error_kind: Column) -> Column:
    """50 no or bad credentials or unsupported, 40 a failure without a snapshot, 30 one with a snapshot or a stale one,
    20 loading or refreshing, 10 live."""
    shown = freshness != "empty"
    failed = availability.isin("offline", "rate_limited", "error")
    return (
        F.when(availability.isin("no_credentials", "unsupported"), 50).when((availability == "error") & error_kind.eqNullSafe("credentials"), 50)
        .when(failed & shown, 30).when(failed, 40).when(refreshing | ~shown, 20).when(freshness == "stale", 30).otherwise(10)
    )


def tray_visible(availability: Column) -> Column:
    """Whether the short text shows a value: a rate limit keeps the last one."""
    return ~availability.isin("no_credentials", "unsupported", "offline", "error")


def plan_label(c: Column) -> Column:
    return F.initcap(F.regexp_replace(F.trim(c), "[_-]+", " "))
