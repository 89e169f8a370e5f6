"""Date functions. Invalid text gives null; nothing reads a clock."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from email.utils import parsedate_to_datetime
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_iso(c: Column) -> Column:
    """YYYY-MM-DD only, a real day, and no year below 100."""
    day = F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), "yyyy-MM-dd")
    return F.when(F.year(day) >= 100, day)


def day_month_year(c: Column) -> Column:
    """D/M/YY or D/M/YYYY; two digits mean 20YY."""
    shape = r"^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\s*$"
    part = lambda i: F.regexp_extract(c, shape, i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    iso = F.concat(year, F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"))
    return F.when(c.rlike(shape), strict_iso(iso))


def long_date(c: Column) -> Column:
    """"Monday, 3 November 2025", the weekday optional."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]+,\s*", "")
    return F.coalesce(F.try_to_date(bare, "d MMMM yyyy"), F.try_to_date(bare, "d MMM yyyy"))


def show_date(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def day_index(c: Column) -> Column:
    return F.unix_date(c)


def from_day_index(c: Column) -> Column:
    return F.date_from_unix_date(c)


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(c, high), low)


def normalize_range(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Missing ends take the bounds, both are clamped, crossed ends are swapped."""
    a, b = clamp(F.coalesce(start, low), low, high), clamp(F.coalesce(end, high), low, high)
    return F.least(a, b), F.greatest(a, b)


def is_full_range(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (start == low) & (end == high)


def in_range(day: Column, start: Column, end: Column) -> Column:
    """Inclusive; false for a day that isn't one."""
    return F.coalesce(day.between(start, end), F.lit(False))


def announcement_day(c: Column) -> Column:
    """Saturday and Sunday roll back to Friday."""
    return F.date_sub(c, F.greatest(F.weekday(c) - 4, F.lit(0)))


def overlap_start(end: Column, last: Column, days: int = 2) -> Column:
    return F.date_sub(F.least(end, F.coalesce(last, end)), days)


def range_to_params(start: date, end: date, low: date, high: date, others: str = "") -> str:
    """URL parameters with the range, which is left out where it is the full one."""
    kept = [(k, v) for k, v in parse_qsl(others) if k not in ("from", "to")]
    if (start, end) != (low, high):
        kept += [("from", start.isoformat()), ("to", end.isoformat())]
    return urlencode(kept)


def range_from_params(params: str, low: date, high: date) -> tuple[date, date]:
    given = dict(parse_qsl(params))

    def read(name: str, default: date) -> date:
        try:
            day = date.fromisoformat(given.get(name, "")) if len(given.get(name, "")) == 10 else default
        except ValueError:
            day = default
        return min(max(day, low), high)

    a, b = read("from", low), read("to", high)
    return min(a, b), max(a, b)


def mail_time(text: str) -> str:
    """An RFC 2822 time as a UTC second."""
    at = parsedate_to_datetime(text)
    return at.astimezone(UTC).replace(microsecond=0, tzinfo=None).isoformat() + "Z"


def plan_window(end: date, last: date | None, overlap: int = 2) -> tuple[date, date]:
    """Start and end of a run's coverage."""
    end -= timedelta(days=max(end.weekday() - 4, 0))
    return min(end, last or end) - timedelta(days=overlap), end


def utc_second(at: datetime) -> str:
    return at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def submission_second(c: Column) -> Column:
    """An RFC 2822 time ("Mon, 3 Nov 2025 18:00:05 -0500", or UTC or GMT) as a UTC second in ISO form; null without a zone."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s+(?:UTC|GMT|UT|Z)$", " +0000")
    at = F.try_to_timestamp(F.when(zoned.rlike(r"[+\-]\d{4}$"), zoned), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def instant(c: Column) -> Column:
    """The instant of an ISO time that states its zone; null for one that doesn't."""
    return F.when(c.rlike(r"T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+\-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))


def range_query(start: Column, end: Column, low: Column, high: Column) -> Column:
    """``range_to_params`` of one row's range, without other parameters."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.when((start == low) & (end == high), "").otherwise(F.concat(F.lit("from="), day(start), F.lit("&to="), day(end)))


def range_of_query(params: Column, low: Column, high: Column) -> Column:
    """struct<start, end> that the parameters name, kept inside the bounds and in order; the bound itself where a day is absent or
    no day."""
    def read(name: str, default: Column) -> Column:
        day = strict_iso(F.regexp_extract(params, rf"(?:^|&){name}=([^&]*)", 1))
        return F.least(F.greatest(F.coalesce(day, default), low), high)

    a, b = read("from", low), read("to", high)
    return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))
