"""Capture dates: text as cameras write it, read in the two ways the catalogue needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shots of one camera up to so many seconds apart are a burst, not duplicates.
BURST_SECONDS = 60


def exif_key(date: Column, model: Column) -> Column:
    """Date and camera of a capture; null without a date; a missing model counts as the name `unknown`."""
    return F.concat(date, F.lit("|"), F.coalesce(model, F.lit("unknown")))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _numbers(token: Column, separators: str) -> Column:
    """The whole numbers between separators, with a sign or without; other parts are left out."""
    parts = F.filter(F.split(token, separators), lambda x: x.rlike("^[+-]?[0-9]{1,18}$"))
    return F.transform(parts, lambda x: x.cast("long"))


def exif_seconds(text: Column) -> Column:
    """A second count with months of 31 days and a leap day every fourth year, for short differences only; null if unreadable."""
    tokens = _tokens(text)
    day, time = _numbers(F.get(tokens, F.lit(0)), "[:-]"), _numbers(F.get(tokens, F.lit(1)), ":")
    y, m, d = (F.get(day, F.lit(i)) for i in range(3))
    h, mi, s = (F.get(time, F.lit(i)) for i in range(3))
    days = y * 365 + F.call_function("div", y, F.lit(4).cast("long")) + m * 31 + d
    return F.when((F.size(tokens) >= 2) & (F.size(day) >= 3) & (F.size(time) >= 3), days * 86400 + h * 3600 + mi * 60 + s)


def sequential(model1: Column, date1: Column, model2: Column, date2: Column) -> Column:
    """Whether two captures are shots of a burst: one camera, different date texts, at most 60 seconds apart."""
    gap = F.abs(exif_seconds(date1) - exif_seconds(date2))
    return F.coalesce((model1 == model2) & (date1 != date2) & (gap <= BURST_SECONDS), F.lit(False))


def sequential_seconds(model1: Column, date1: Column, sec1: Column, model2: Column, date2: Column, sec2: Column) -> Column:
    """`sequential` over seconds computed before."""
    return F.coalesce((model1 == model2) & (date1 != date2) & (F.abs(sec1 - sec2) <= BURST_SECONDS), F.lit(False))


def exif_date(text: Column) -> Column:
    """struct(year, month, day) of the first token, null unless its first three parts are in range (no calendar check)."""
    parts = F.split(F.get(_tokens(text), F.lit(0)), "[:-]")
    y, m, d = (F.when(F.get(parts, F.lit(i)).rlike("^[+]?[0-9]{1,9}$"), F.get(parts, F.lit(i)).cast("int")) for i in range(3))
    good = (F.size(parts) >= 3) & y.between(1970, 2100) & m.between(1, 12) & d.between(1, 31)
    return F.when(good, F.struct(y.alias("year"), m.alias("month"), d.alias("day")))


def asset_date(text: Column, mtime: Column) -> Column:
    """struct(year, month, day) of the capture date, or else of the modification time in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(mtime / 86400).cast("int"))
    by_mtime = F.struct(F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"))
    return F.coalesce(exif_date(text), by_mtime)
