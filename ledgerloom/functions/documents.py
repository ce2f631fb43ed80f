"""Strict readers of JSON lines, over the VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import clean_title


def parse(line: Column) -> Column:
    """Null when the line is not JSON."""
    return F.try_parse_json(line)


def node(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str) -> Column:
    """VOID, BOOLEAN, BIGINT, DECIMAL(...), DOUBLE, STRING, ARRAY<...> or OBJECT<...>; null when absent."""
    return F.schema_of_variant(node(v, path))


def has(v: Column, path: str) -> Column:
    """Present, be it as a JSON null."""
    return node(v, path).isNotNull()


def text(v: Column, path: str) -> Column:
    """The string at the path; null if it is absent or no string."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def filled(v: Column, path: str) -> Column:
    return F.nullif(text(v, path), F.lit(""))


def boolean(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def number(v: Column, path: str) -> Column:
    return F.when(kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, path, "double"))


def integer(v: Column, path: str) -> Column:
    """A non-negative integer of 63 bits; null if it is absent or anything else."""
    n = F.when(kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    return F.when(n >= 0, n)


def integer_or_zero(v: Column, path: str) -> Column:
    """0 when absent, null when present but no such integer."""
    return F.when(~has(v, path), F.lit(0).cast("long")).otherwise(integer(v, path))


def broken(v: Column, path: str) -> Column:
    """Present, but not a non-negative integer."""
    return has(v, path) & integer(v, path).isNull()


def content_title(v: Column, path: str) -> Column:
    """A string, or the first item of an array that has a text, cleaned as a title."""
    items = F.try_variant_get(v, path, "array<variant>")
    texts = F.filter(F.transform(items, lambda x: text(x, "$.text")), lambda x: x.isNotNull())
    return F.coalesce(clean_title(text(v, path)), F.when(F.size(texts) > 0, clean_title(F.get(texts, F.lit(0)))))
