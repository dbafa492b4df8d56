"""Dates, freshness and windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOWS = ((30, "30 days"), (90, "3 months"), (180, "6 months"))


def invoice_date(raw: Column) -> Column:
    """ISO, or day first with slashes or hyphens; null for anything else."""
    return F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")), F.try_to_timestamp(raw, F.lit("dd/MM/yyyy")), F.try_to_timestamp(raw, F.lit("dd-MM-yyyy"))).cast("date")


def chronology(issued: Column, uploaded: Column) -> Column:
    """The issue date at noon, else the upload; null sorts first where ascending."""
    return F.coalesce(issued.cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS"), uploaded.cast("timestamp_ntz"))


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def days_since(at: Column, as_of: Column) -> Column:
    """Whole days of 24 hours; 0 for the future."""
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.greatest(F.floor(seconds / 86_400_000_000.0), F.lit(0)).cast("int")


def freshness(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days < 30, "fresh").when(days < 90, "aging").when(days < 180, "stale").otherwise("critical")


def narrowest_window(days: Column) -> Column:
    """The first window that holds the event; what is older counts to the last."""
    out = F.lit(WINDOWS[-1][1])
    for size, name in reversed(WINDOWS):
        out = F.when(days < size, name).otherwise(out)
    return out
