"""Dates and months. A month is always its first day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockweave.functions.text import col, normalize_text, strip


def spreadsheet_serial(value: Column | str) -> Column:
    """Date of a spreadsheet day number; below 1 it is a time of day: NULL.

    The 1900 system counts a 29 February that did not exist, hence the shift
    for numbers under 60.
    """
    text = strip(value)
    number = F.when(text.rlike(r"^\d{1,7}(\.\d+)?$"), text.try_cast("double"))
    day = F.floor(number).cast("int") + F.when(number < 60, 1).otherwise(0)
    return F.when((number >= 1) & (number < 2958466), F.date_add(F.lit("1899-12-30").cast("date"), day))


def _ymd(text: Column, separators: str) -> Column:
    same = text.rlike(rf"^\d{{4}}([{separators}])\d{{1,2}}\1\d{{1,2}}$")
    return F.when(same, F.try_to_date(F.translate(text, separators, "-" * len(separators)), "yyyy-M-d"))


def _iso_day(value: Column | str, other: Column) -> Column:
    """Date of an ISO text as it stands, read without patterns; of any other cell ``other``."""
    plain = col(value).rlike(r"^[1-9][0-9]{3}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\z")
    return F.when(plain, col(value).try_cast("date")).otherwise(other)


def _compact(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def sales_date(value: Column | str) -> Column:
    """``y-m-d`` or ``y/m/d``, each with an optional time of day, or a serial."""
    text = strip(value)
    clock = r"(0?\d|1\d|2[0-3]):(0?\d|[1-5]\d):(0?\d|[1-5]\d|6[01])"
    day = F.regexp_replace(text, rf"\s+{clock}$", "")
    return _iso_day(value, F.coalesce(_ymd(day, "/-"), spreadsheet_serial(text)))


def planning_day(text: Column) -> Column:
    """`planning_date` of a text that is normalised already."""
    return _iso_day(text, F.coalesce(_ymd(text, "/.-"), _compact(text), F.when(~text.rlike(r"^\d{8}$"), spreadsheet_serial(text))))


def planning_date(value: Column | str) -> Column:
    """``y-m-d``, ``y/m/d``, ``y.m.d``, ``yyyymmdd`` or a serial."""
    return planning_day(normalize_text(value))


def planning_date_invalid(value: Column | str, required: bool) -> Column:
    absent = normalize_text(value).isNull()
    return planning_date(value).isNull() & (F.lit(required) | ~absent)


def master_date(value: Column | str) -> Column:
    """ISO text of a master-file date.

    Accepted: ISO date, ISO date and time, year-month-day with ``.``, ``/`` or
    ``-``, eight digits, six digits (years 2000-2099), a serial of 1 to 60000.
    Everything else is ambiguous: NULL.
    """
    text = normalize_text(value)
    stamp = r"^(\d{4}-\d{2}-\d{2})[T ](([01]\d|2[0-3]):[0-5]\d)(:[0-5]\d)?(\.\d{1,6})?([+-]\d{2}:\d{2}|Z)?$"
    stamp_day = F.try_to_date(F.when(text.rlike(stamp), F.substring(text, 1, 10)), "yyyy-MM-dd")
    seconds = F.regexp_extract(text, stamp, 4)
    fraction = F.regexp_extract(text, stamp, 5)
    zone = F.regexp_replace(F.regexp_extract(text, stamp, 6), "^Z$", "+00:00")
    stamp_iso = F.when(
        stamp_day.isNotNull(),
        F.concat(
            F.substring(text, 1, 10),
            F.lit("T"),
            F.regexp_extract(text, stamp, 2),
            F.when(seconds == "", F.lit(":00")).otherwise(seconds),
            F.when(fraction == "", F.lit("")).otherwise(F.rpad(fraction, 7, "0")),
            zone,
        ),
    )
    ymd = F.coalesce(
        F.when(text.rlike(r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}$"), F.try_to_date(F.regexp_replace(text, "[./]", "-"), "yyyy-M-d")),
        _compact(text),
        F.when(text.rlike(r"^\d{6}$"), F.try_to_date(F.concat(F.lit("20"), text), "yyyyMMdd")),
    )
    serial = F.when(
        text.rlike(r"^\d{1,5}(\.\d+)?$") & (text.try_cast("double").between(1, 60000)), spreadsheet_serial(text)
    )
    serial_iso = F.concat(F.date_format(serial, "yyyy-MM-dd"), F.lit("T00:00:00"))
    return F.coalesce(stamp_iso, F.date_format(ymd, "yyyy-MM-dd"), serial_iso)


def month_start(value: Column | str) -> Column:
    return F.trunc(col(value), "MM")


def month_offset(month: Column | str, offset: Column | int) -> Column:
    return F.add_months(month_start(month), offset)


def is_complete_month(start: Column | str, end: Column | str) -> Column:
    start, end = col(start), col(end)
    return (F.dayofmonth(start) == 1) & (end == F.last_day(start))


def month_count(first: Column | str, last: Column | str) -> Column:
    """Months from first to last, both counted."""
    first, last = col(first), col(last)
    return (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1
