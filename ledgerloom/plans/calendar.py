"""Calendar ranges: local midnights, exclusive ends, weeks from Monday."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

PRESETS = ("today", "yesterday", "week", "last_week", "month", "last_month", "year", "all")


@dataclass(frozen=True)
class Range:
    """Half-open; None is open."""

    start: datetime | None
    end: datetime | None


def _shift_month(day: datetime, months: int) -> datetime:
    k = day.year * 12 + day.month - 1 + months
    return day.replace(year=k // 12, month=k % 12 + 1, day=1)


def preset(name: str, now: datetime, zone: str = "UTC") -> Range:
    local = now.astimezone(ZoneInfo(zone))
    day = local.replace(hour=0, minute=0, second=0, microsecond=0)
    on = lambda d: d.replace(tzinfo=ZoneInfo(zone))
    days = lambda d, n: on((d.replace(tzinfo=None) + timedelta(days=n)))
    monday, first = days(day, -day.weekday()), day.replace(day=1)
    table = {
        "today": (day, days(day, 1)), "yesterday": (days(day, -1), day), "week": (monday, days(monday, 7)), "last_week": (days(monday, -7), monday),
        "month": (first, _shift_month(first, 1)), "last_month": (_shift_month(first, -1), first), "year": (first.replace(month=1), first.replace(month=1, year=first.year + 1)), "all": (None, None),
    }
    if name not in table:
        raise ValueError(f"unknown range {name}")
    return Range(*table[name])


def custom(first_day: datetime, last_day: datetime, zone: str = "UTC") -> Range:
    """Both days included."""
    z = ZoneInfo(zone)
    start = first_day.replace(tzinfo=z, hour=0, minute=0, second=0, microsecond=0)
    end = (last_day.replace(tzinfo=None, hour=0, minute=0, second=0, microsecond=0) + timedelta(days=1)).replace(tzinfo=z)
    if start >= end:
        raise ValueError("the range is empty")
    return Range(start, end)


def last_included_day(r: Range) -> datetime | None:
    """What a date picker shows as the end."""
    return None if r.end is None else r.end - timedelta(days=1)


def previous(name: str, r: Range) -> Range | None:
    """The range of equal length before; none for all time and custom ranges."""
    if name in ("all", "custom") or r.start is None or r.end is None:
        return None
    return Range(r.start - (r.end - r.start), r.start)


def chart(r: Range) -> Range:
    """A range of at most a day and a half is shown within the 14 days to its end."""
    if r.start is None or r.end is None or r.end - r.start > timedelta(days=1.5):
        return r
    return Range(r.end - timedelta(days=14), r.end)
