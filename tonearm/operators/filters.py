"""Filters: validated date cascades as half-open ranges (pushed to the scan), windows, case-blind patterns, pages."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.sources.tables import has_column

PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90, "last-year": 365}


def parse_cascade(year=None, month=None, day=None) -> tuple[int | None, int | None, int | None]:
    """(year, month, day) as far as each is valid; a month counts only with a year, a day only with a month."""
    y = int(year) if isinstance(year, str) and re.fullmatch(r"\d{4}", year) else None
    m = int(month) if y is not None and isinstance(month, str) and re.fullmatch(r"\d{1,2}", month) else None
    m = m if m and 1 <= m <= 12 else None
    d = int(day) if m is not None and isinstance(day, str) and re.fullmatch(r"\d{1,2}", day) else None
    return y, m, d if d and 1 <= d <= 31 else None


def cascade_range(year: int, month: int | None = None, day: int | None = None) -> tuple[datetime, datetime] | None:
    """[from, to) of a year, month or day; None for a date that does not exist."""
    if month is None:
        return datetime(year, 1, 1), datetime(year + 1, 1, 1)
    if day is None:
        return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)
    if day > calendar.monthrange(year, month)[1]:
        return None
    return datetime(year, month, day), datetime(year, month, day) + timedelta(days=1)


def moment(when: datetime) -> Column:
    return F.lit(when.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def between(df: DataFrame, column: str, start: datetime | None, end: datetime | None, inclusive: bool = False) -> DataFrame:
    """Rows of [start, end), or [start, end] where ``inclusive``; a missing bound is open."""
    if start is not None:
        df = df.where(F.col(column) >= moment(start))
    if end is not None:
        df = df.where(F.col(column) <= moment(end) if inclusive else F.col(column) < moment(end))
    return df


def seconds_between(df: DataFrame, column: str, start: datetime | None, end: datetime | None) -> DataFrame:
    """``between`` on a column of epoch seconds, as plain numbers that reach the scan."""
    seconds = lambda when: int((when - datetime(1970, 1, 1)).total_seconds())
    if start is not None:
        df = df.where(F.col(column) >= seconds(start))
    if end is not None:
        df = df.where(F.col(column) < seconds(end))
    return df


def cascade(df: DataFrame, column: str, year: int | None, month: int | None = None, day: int | None = None) -> DataFrame:
    if year is None:
        return df
    bounds = cascade_range(year, month, day)
    return between(df, column, *bounds) if bounds else df.where(F.lit(False))


def period(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """``YYYY`` or ``YYYY-MM``; anything else is no filter."""
    if text and re.fullmatch(r"\d{4}(-\d{2})?", text):
        return cascade(df, column, *(int(x) for x in text.split("-")))
    return df


def period_bounds(name: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    if name == "all-time":
        return None, None
    return now - timedelta(days=PERIOD_DAYS[name]), now


def months_back(now: datetime, months: int) -> datetime:
    """``now`` minus months, with the overflow of a day that the target month lacks carried into the next."""
    total = now.year * 12 + now.month - 1 - months
    first = now.replace(year=total // 12, month=total % 12 + 1, day=1)
    return first + timedelta(days=now.day - 1)


def pattern(column: str, text: str) -> Column:
    """Case-blind ``%text%``; the caller's wildcards stay live."""
    return F.lower(F.col(column)).like(f"%{text.lower()}%")


def history_filter(df: DataFrame, user=None, artist=None, title=None, status=None, year=None, month=None, day=None) -> DataFrame:
    """The combined history filter; status ``unmatched`` also takes rows without a sync row."""
    if user:
        df = df.where(F.col("lastfm_user") == user)
    df = cascade(df, "played_at", year, month, day)
    for column, text in (("artist", artist), ("title", title)):
        if text:
            df = df.where(pattern(column, text))
    if status == "unmatched":
        df = df.where((F.col("status") == "unmatched") | F.col("status").isNull())
    elif status and status != "all":
        df = df.where(F.col("status") == status)
    return df


def without_identifiers(media_file: DataFrame) -> DataFrame:
    """Tracks whose every identifier column that exists is missing."""
    known = [c for c in ("mbz_track_id", "mbz_recording_id") if has_column(media_file, c)]
    if not known:
        return media_file.where(F.lit(False))
    return media_file.where(reduce(Column.__and__, [F.coalesce(F.col(c), F.lit("")) == "" for c in known]))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page under a total order."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(max(limit, 1))


def search(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows of which some column holds the text, whatever the case; a blank text is no filter."""
    if not text.strip():
        return df
    return df.where(reduce(Column.__or__, [pattern(c, text.strip()) for c in columns]))


def runs_filter(runs: DataFrame, kind: str | None = None, status: str | None = None, label: str | None = None) -> DataFrame:
    """Run-log rows of a kind, a status and a part of the label; newest first is the caller's page order."""
    for column, wanted in (("type", kind), ("status", status)):
        if wanted:
            runs = runs.where(F.col(column) == wanted)
    return runs.where(pattern("label", label)) if label else runs
