"""Dates and sizes: bounds folded on the driver into literals (FN11-FN15).

Message dates are TIMESTAMP_NTZ wall-clock values in the archive's time zone
``tz``; bounds are computed as epoch seconds (reference semantics) and turned
into wall-clock literals so Catalyst pushes ``date BETWEEN lo AND hi`` to the
Parquet scan.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Open range ends and the templates that fill partial dates.
OPEN_LOW = 0
OPEN_HIGH = 9999999999
LOW_TEMPLATE = "19700101000000"
HIGH_TEMPLATE = "29991231235959"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _epoch(local: dt.datetime, tz: str) -> int:
    return int(local.replace(tzinfo=ZoneInfo(tz)).timestamp())


def _add_months(d: dt.datetime, months: int) -> dt.datetime:
    y, m = divmod(d.month - 1 + months, 12)
    y += d.year
    day = min(d.day, calendar.monthrange(y, m + 1)[1])
    return d.replace(year=y, month=m + 1, day=day)


def parse_date_bound(expr: str | None, is_lower: bool, as_of: dt.datetime, tz: str = "UTC") -> int:
    """FN13: a user date expression -> epoch seconds of the range end.

    Partial ISO dates are filled low/high; a day past the month end becomes
    the last second of the month; ``now``/``today``; ages like ``3d``, ``2w``,
    ``1m``, ``1y``, ``5h``, ``10M``, ``30s``; anything invalid is an open end.
    ``as_of`` is the local wall-clock "now" in ``tz``.
    """
    if not expr:
        return OPEN_LOW if is_lower else OPEN_HIGH
    if expr == "now":
        return _epoch(as_of, tz)
    if expr == "today":
        midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
        if not is_lower:
            midnight += dt.timedelta(days=1)
        return max(0, _epoch(midnight, tz))
    if any(c in expr for c in "ymdwhMs"):
        m = re.match(r"^\s*([+-]?\d+)(.*)$", expr)
        if not m:
            return OPEN_LOW
        num, unit = int(m.group(1)), m.group(2)
        if num <= 0 or num > 9999 or not unit:
            return OPEN_LOW
        u = unit[0]
        if u == "s":
            then = as_of - dt.timedelta(seconds=num)
        elif u == "M":
            then = as_of - dt.timedelta(minutes=num)
        elif u == "h":
            then = as_of - dt.timedelta(hours=num)
        elif u == "d":
            then = as_of - dt.timedelta(days=num)
        elif u == "w":
            then = as_of - dt.timedelta(weeks=num)
        elif u == "m":
            then = _add_months(as_of, -num)
        elif u == "y":
            then = _add_months(as_of, -12 * num)
        else:
            return OPEN_LOW
        return max(0, _epoch(then, tz))
    digits = "".join(c for c in expr if c.isdigit())[:14]
    template = LOW_TEMPLATE if is_lower else HIGH_TEMPLATE
    full = digits + template[len(digits):]
    y, mo, d, h, mi, s = (int(full[0:4]), int(full[4:6]), int(full[6:8]),
                          int(full[8:10]), int(full[10:12]), int(full[12:14]))
    if not (1 <= mo <= 12 and 1 <= d <= 31 and h <= 23 and mi <= 59 and s <= 61):
        return OPEN_LOW if is_lower else OPEN_HIGH
    last = calendar.monthrange(y, mo)[1]
    if d > last:
        d, h, mi, s = last, 23, 59, 59
    try:
        t = _epoch(dt.datetime(y, mo, d, h, mi, min(s, 59)), tz)
    except (ValueError, OverflowError):
        return OPEN_LOW if is_lower else OPEN_HIGH
    if t < 0 or t > OPEN_HIGH:
        return OPEN_LOW if is_lower else OPEN_HIGH
    return t


def ntz_lit(d: dt.datetime | dt.date) -> Column:
    """A wall-clock TIMESTAMP_NTZ literal (no time-zone conversion on the way)."""
    if not isinstance(d, dt.datetime):
        d = dt.datetime(d.year, d.month, d.day)
    return F.lit(d.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def epoch_to_local(t: int, tz: str) -> dt.datetime:
    return dt.datetime.fromtimestamp(t, ZoneInfo(tz)).replace(tzinfo=None)


def date_between(c: Column | str, lo: str | None, hi: str | None, as_of: dt.datetime,
                 tz: str = "UTC") -> Column:
    """FLT17: inclusive range on a wall-clock date column; reversed bounds are swapped."""
    a = parse_date_bound(lo, True, as_of, tz)
    b = parse_date_bound(hi, False, as_of, tz)
    if a > b:
        a, b = parse_date_bound(hi, True, as_of, tz), parse_date_bound(lo, False, as_of, tz)
    col = _col(c)
    pred = col.isNotNull()
    if a != OPEN_LOW:
        pred = pred & (col >= ntz_lit(epoch_to_local(a, tz)))
    if b != OPEN_HIGH:
        pred = pred & (col <= ntz_lit(epoch_to_local(b, tz)))
    return pred


SIZE_RX = re.compile(r"(\d+)(b|k|kb|m|mb|g|gb)?", re.IGNORECASE)


def parse_size(expr: str | None, is_lower: bool) -> int:
    """FN15: '10k', '2mb', '1g' (1024-based) -> bytes; empty/invalid is an open end."""
    if not expr:
        return OPEN_LOW if is_lower else OPEN_HIGH
    m = SIZE_RX.search(expr)
    if not m:
        return OPEN_LOW if is_lower else OPEN_HIGH
    n = int(m.group(1))
    unit = (m.group(2) or "").lower()[:1]
    return n * {"k": 1024, "m": 1024 ** 2, "g": 1024 ** 3}.get(unit, 1)


def size_between(c: Column | str, lo: str | None, hi: str | None) -> Column:
    """FLT18: inclusive size range, reversed bounds swapped."""
    a, b = parse_size(lo, True), parse_size(hi, False)
    if a > b:
        a, b = parse_size(hi, True), parse_size(lo, False)
    return _col(c).between(F.lit(a), F.lit(b))


def size_display(c: Column | str) -> Column:
    """FN11: '123 bytes', '12.3 kB', '4.5 MB', '1.2 GB' (1000-based, one decimal,
    rounded half up on the integer byte count)."""
    n = _col(c).cast("bigint")

    def unit(div: int, label: str) -> Column:
        tenths = F.floor((n * 10 + F.lit(div // 2)) / F.lit(div)).cast("bigint")
        return F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."),
                        (tenths % 10).cast("string"), F.lit(label))

    return (F.when(n < 1000, F.concat(n.cast("string"), F.when(n == 1, F.lit(" byte")).otherwise(F.lit(" bytes"))))
            .when(n < 1000 ** 2, unit(1000, " kB"))
            .when(n < 1000 ** 3, unit(1000 ** 2, " MB"))
            .otherwise(unit(1000 ** 3, " GB")))


def size_short(c: Column | str) -> Column:
    """FN11 variant: '1.2M', '3.4K' or the plain number."""
    n = _col(c).cast("bigint")

    def unit(div: int, label: str) -> Column:
        tenths = F.floor((n * 10 + F.lit(div // 2)) / F.lit(div)).cast("bigint")
        return F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."),
                        (tenths % 10).cast("string"), F.lit(label))

    return F.when(n >= 1000000, unit(1000000, "M")).when(n >= 1000, unit(1000, "K")).otherwise(n.cast("string"))


def format_date(c: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """FN14: date formatted with a Spark datetime pattern."""
    return F.date_format(_col(c), fmt)


def human_date(c: Column | str, as_of: dt.datetime, time_fmt: str = "HH:mm:ss",
               date_fmt: str = "yyyy-MM-dd") -> Column:
    """FN12: time of day when on the as_of day, else the date."""
    col = _col(c)
    same_day = F.to_date(col) == F.lit(as_of.date())
    return F.when(same_day, F.date_format(col, time_fmt)).otherwise(F.date_format(col, date_fmt))
