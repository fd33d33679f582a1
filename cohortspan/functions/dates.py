"""Ages and durations. The reference date is always an argument, never the clock."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a typed duration, in which a month counts 31 days and a year 365.
DAYS_PER_UNIT = {"day": 1, "week": 7, "month": 31, "year": 365}
_DURATION = r"^\s*(\d+)\s*(day|week|month|year)s?\s*$"


def as_date(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def full_years(birth: Column, as_of: dt.date | str) -> Column:
    """Completed years of life at ``as_of``."""
    return F.timestamp_diff("YEAR", birth, as_date(as_of)).cast("int")


def calendar_years(birth: Column, as_of: dt.date | str) -> Column:
    """Difference of the calendar years, which the reference population is selected by."""
    return F.year(as_date(as_of)) - F.year(birth)


def duration_days(text: Column) -> Column:
    """Days in a text such as ``6 months``; NULL if the text is not a duration."""
    lowered = F.lower(text)
    number = F.regexp_extract(lowered, _DURATION, 1).try_cast("bigint")
    unit = F.regexp_extract(lowered, _DURATION, 2)
    factor = F.coalesce(*[F.when(unit == name, F.lit(days)) for name, days in DAYS_PER_UNIT.items()])
    return F.try_multiply(number, factor.cast("bigint"))


def literal_days(text: str) -> int | None:
    """The same for one text at hand."""
    found = re.match(_DURATION, text.lower(), re.ASCII)
    return int(found[1]) * DAYS_PER_UNIT[found[2]] if found else None


def iso_date(text: Column) -> Column:
    """Date in the form yyyy-MM-dd, NULL for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
