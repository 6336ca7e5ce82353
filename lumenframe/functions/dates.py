"""Date and time functions over text values, with modifiers applied from left to right.

A value is ``yyyy-MM-dd`` with an optional ``[ T]HH:mm[:ss[.SSS]]`` and zone; anything else is null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def moment(x: Column, *modifiers: str) -> Column:
    """A timestamp (the session runs in UTC)."""
    out = F.when(x.rlike(TEXT), F.try_to_timestamp(x))
    for m in modifiers:
        out = modified(out, m.strip().lower())
    return out


def _whole(ts: Column, n: int, keep_day: bool) -> Column:
    """n months on. A day the month lacks rolls forward, or (keep_day) becomes the month's last."""
    clock = ts.cast("long") - F.unix_seconds(F.date_trunc("day", ts))
    micros = F.unix_micros(ts) - F.unix_seconds(ts) * 1_000_000
    month = F.add_months(ts.cast("date"), n)
    day = month if keep_day else F.date_add(F.trunc(month, "MM"), F.dayofmonth(ts) - 1)
    return F.timestamp_micros((F.unix_seconds(day.cast("timestamp")) + clock) * 1_000_000 + micros)


def _seconds(ts: Column, seconds: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(round(seconds * 1_000_000)))


# The length of the units of a modifier in seconds.
UNITS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}


def modified(ts: Column, modifier: str) -> Column:
    if m := re.fullmatch(r"([+-]?[0-9.]+) (day|hour|minute|second)s?", modifier):
        return _seconds(ts, float(m[1]) * UNITS[m[2]])
    if m := re.fullmatch(r"([+-]?[0-9]+) (month|year)s?( floor| ceiling)?", modifier):
        return _whole(ts, int(m[1]) * (12 if m[2] == "year" else 1), (m[3] or "").strip() == "floor")
    if m := re.fullmatch(r"start of (day|month|year)", modifier):
        return F.date_trunc(m[1], ts)
    if m := re.fullmatch(r"weekday ([0-6])", modifier):
        return _seconds_column(ts, F.pmod(F.lit(int(m[1])) - (F.dayofweek(ts) - 1), F.lit(7)) * 86400)
    if modifier == "localtime":
        return F.from_utc_timestamp(ts, F.current_timezone())
    if modifier == "utc":
        return F.to_utc_timestamp(ts, F.current_timezone())
    if modifier == "subsec":
        return ts
    raise ValueError(f"unknown modifier: {modifier}")


def _seconds_column(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("bigint") * 1_000_000)


def paired(modifiers: tuple[str, ...]) -> tuple[str, ...]:
    """``floor`` and ``ceiling`` say how the month arithmetic before them ends."""
    out: list[str] = []
    for m in modifiers:
        if m in ("floor", "ceiling") and out:
            out[-1] += f" {m}"
        else:
            out.append(m)
    return tuple(out)


def date(x: Column, *modifiers: str) -> Column:
    return F.date_format(moment(x, *paired(modifiers)), "yyyy-MM-dd")


def time(x: Column, *modifiers: str) -> Column:
    return F.date_format(moment(x, *paired(modifiers)), "HH:mm:ss.SSS" if "subsec" in modifiers else "HH:mm:ss")


def datetime(x: Column, *modifiers: str) -> Column:
    return F.date_format(moment(x, *paired(modifiers)), "yyyy-MM-dd HH:mm:ss.SSS" if "subsec" in modifiers else "yyyy-MM-dd HH:mm:ss")


def julian_day(x: Column, *modifiers: str) -> Column:
    return F.unix_micros(moment(x, *paired(modifiers))) / F.lit(86_400_000_000.0) + F.lit(2440587.5)


def unix_epoch(x: Column, *modifiers: str) -> Column:
    ts = moment(x, *paired(modifiers))
    return F.unix_micros(ts) / F.lit(1_000_000.0) if "subsec" in modifiers else F.unix_seconds(ts)


# Format tokens that have a pattern of their own.
TOKENS = {"d": "dd", "H": "HH", "M": "mm", "m": "MM", "S": "ss", "Y": "yyyy", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm"}


def strftime(template: str, x: Column, *modifiers: str) -> Column:
    ts = moment(x, *paired(modifiers))
    parts: list[Column] = []
    for literal, token in re.findall(r"([^%]+)|%(.)", template):
        if literal:
            parts.append(F.lit(literal))
        elif token in TOKENS:
            parts.append(F.date_format(ts, TOKENS[token]))
        elif token == "f":
            parts.append(F.date_format(ts, "ss.SSS"))
        elif token == "j":
            parts.append(F.lpad(F.dayofyear(ts).cast("string"), 3, "0"))
        elif token == "w":
            parts.append((F.dayofweek(ts) - 1).cast("string"))
        elif token == "u":
            parts.append((F.weekday(ts) + 1).cast("string"))
        elif token == "W":
            parts.append(F.lpad(_week(ts).cast("string"), 2, "0"))
        elif token == "s":
            parts.append(F.unix_seconds(ts).cast("string"))
        elif token == "J":
            parts.append(julian_day(x, *modifiers).cast("string"))
        elif token == "%":
            parts.append(F.lit("%"))
        else:
            return F.lit(None).cast("string")
    # A part of a missing moment is null, and so is the whole; a condition around them would parse the text once for each part.
    dated = "%" in template.replace("%%", "")
    return F.concat(*parts) if dated else F.when(ts.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def _week(ts: Column) -> Column:
    return F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("bigint")


def year(x: Column) -> Column:
    return F.year(moment(x)).cast("bigint")


def month(x: Column) -> Column:
    return F.month(moment(x)).cast("bigint")


def day(x: Column) -> Column:
    return F.dayofmonth(moment(x)).cast("bigint")


def hour(x: Column) -> Column:
    return F.hour(moment(x)).cast("bigint")


def minute(x: Column) -> Column:
    return F.minute(moment(x)).cast("bigint")


def second(x: Column) -> Column:
    return F.second(moment(x)).cast("bigint")


def day_of_year(x: Column) -> Column:
    return F.dayofyear(moment(x)).cast("bigint")


def day_of_week(x: Column) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(moment(x)) - 1).cast("bigint")


def week_of_year(x: Column) -> Column:
    """Weeks begin on Monday; days before the first Monday are in week 0."""
    return _week(moment(x))
