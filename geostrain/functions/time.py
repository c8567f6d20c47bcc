"""Date and time expressions (columns in, columns out).

Two lengths of a year are in use: differences and rates divide by 365.25 days,
widths of moving windows multiply whole years of 365 days.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_DAYS = 365.25
WINDOW_YEAR_DAYS = 365
MJD_EPOCH = "1858-11-17"
#: Two-digit years up to this one are in the 2000s.
PIVOT = 68
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def parse_yymmmdd(text: Column) -> Column:
    """Dates like ``15JAN01``; the pivot of two-digit years is explicit."""
    year = F.substring(text, 1, 2).cast("int")
    month = F.floor((F.instr(F.lit(MONTHS), F.upper(F.substring(text, 3, 3))) + 2) / 3).cast("int")
    full = year + F.when(year <= PIVOT, 2000).otherwise(1900)
    return F.make_date(full, F.when(month > 0, month), F.substring(text, 6, 2).cast("int"))


def parse_any(text: Column) -> Column:
    """Timestamps from text of 8, 10, 15 or 19 characters."""
    n = F.length(text)
    return (
        F.when(n == 8, F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .when(n == 10, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
        .when(n == 15, F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")))
        .otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    )


def years_between(first: Column, second: Column) -> Column:
    """Signed years between two dates."""
    return F.datediff(second, first) / YEAR_DAYS


def years_between_times(first: Column, second: Column) -> Column:
    """Signed years between two timestamps, to the second."""
    return F.timestamp_diff("SECOND", first, second) / 86400.0 / YEAR_DAYS


def decimal_year(date: Column) -> Column:
    return F.year(date) + (F.dayofyear(date) - 1) / YEAR_DAYS


def decimal_year_of_time(t: Column) -> Column:
    day = 24.0
    part = F.hour(t) / (YEAR_DAYS * day) + F.minute(t) / (YEAR_DAYS * day * 60) + F.second(t) / (YEAR_DAYS * day * 3600)
    return F.year(t) + (F.dayofyear(t) - 1) / YEAR_DAYS + part


def from_decimal_year(y: Column) -> Column:
    whole = F.floor(y)
    return F.date_add(F.make_date(whole.cast("int"), F.lit(1), F.lit(1)), F.floor((y - whole) * YEAR_DAYS).cast("int"))


def mjd(date: Column) -> Column:
    return F.datediff(date, F.lit(MJD_EPOCH).cast("date"))


def mjd_to_decimal_year(m: Column) -> Column:
    return (m - 51544) / YEAR_DAYS + 2000


def from_mjd(m: Column) -> Column:
    return F.date_add(F.lit(MJD_EPOCH).cast("date"), m.cast("int"))


def epoch_of_parts(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """A timestamp from six numeric columns."""
    i = lambda c: c.cast("int")
    return F.make_timestamp_ntz(i(y), i(mo), i(d), i(h), i(mi), s.cast("decimal(8,6)"))


def temporal_baseline(first: Column, second: Column) -> Column:
    return F.datediff(second, first)
