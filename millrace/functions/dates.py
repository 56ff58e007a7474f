"""Dates from parts, text and epoch values. The clock is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import zero_pad


def parts_to_iso(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-MM-dd``; month and day default to 1. Text, so 2024-13-01 passes as it did at the source."""
    one = F.lit(1)
    return F.when(year.isNull(), F.lit("")).otherwise(
        F.concat_ws("-", year.cast("string"), zero_pad(F.coalesce(month, one)),
                    zero_pad(F.coalesce(day, one))))


def parts_to_compact(year: Column, month: Column, day: Column) -> Column:
    one = F.lit(1)
    return F.concat(F.coalesce(year.cast("string"), F.lit("")), zero_pad(F.coalesce(month, one)),
                    zero_pad(F.coalesce(day, one)))


def compact(text: Column) -> Column:
    """Drop the dashes; null becomes blank."""
    return F.coalesce(F.replace(text.cast("string"), F.lit("-"), F.lit("")), F.lit(""))


def year_prefix(text: Column, run_date: dt.date) -> Column:
    """First four characters, or the run year when the text is shorter."""
    return F.when(F.length(text) >= 4, F.left(text, F.lit(4))).otherwise(F.lit(str(run_date.year)))


def epoch_ms_to_date(milliseconds: Column) -> Column:
    return F.date_format(F.timestamp_millis(milliseconds.try_cast("bigint")), "yyyy-MM-dd")


def real_date(year: Column, month: Column, day: Column) -> Column:
    """A DATE, or null when the parts name no day. ``make_date`` would fail the job instead."""
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), zero_pad(month), zero_pad(day)
                       ).try_cast("date")
