"""Calendar parts of a date column.

Plain column expressions, so the same function serves a table column, a window
result and the variable of a higher-order function over future dates.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weekday domain in display order.
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# The month columns of the season table, January first.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Periods of the cyclic encodings.
MONTHS_IN_YEAR, DAYS_IN_WEEK, DAYS_IN_MONTH = 12, 7, 31


def weekend_flag(day: Column) -> Column:
    return F.weekday(day).isin(5, 6).cast("int")


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMM")


def day_name(day: Column) -> Column:
    return F.date_format(day, "E")


def month_label(day: Column) -> Column:
    """``Jan 2014``"""
    return F.date_format(day, "MMM yyyy")


def iso_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def week_end(day: Column) -> Column:
    """The Sunday that closes the Monday-to-Sunday week of ``day``."""
    return F.date_add(F.trunc(day, "week"), 6)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def line_calendar(day: Column) -> dict[str, Column]:
    """The nine calendar columns carried by each clean sales line."""
    return {
        "Year": F.year(day),
        "Quarter": F.quarter(day),
        "Month": F.month(day),
        "Month_Name": month_name(day),
        "Week": F.weekofyear(day),
        "Day": F.dayofmonth(day),
        "Day_of_Week": F.weekday(day),
        "Day_Name": day_name(day),
        "Is_Weekend": weekend_flag(day),
    }


# The eight calendar features known in advance for any day.
CALENDAR_FEATURES: dict[str, Callable[[Column], Column]] = {
    "day_of_week": F.weekday,
    "day_of_month": F.dayofmonth,
    "month": F.month,
    "quarter": F.quarter,
    "year": F.year,
    "is_weekend": weekend_flag,
    "day_of_year": F.dayofyear,
    "week_of_year": F.weekofyear,
}

# The parts that get a sine and a cosine, with their periods.
CYCLES: dict[str, tuple[Callable[[Column], Column], int]] = {
    "month": (F.month, MONTHS_IN_YEAR),
    "dow": (F.weekday, DAYS_IN_WEEK),
    "day": (F.dayofmonth, DAYS_IN_MONTH),
}

FEATURE_NAMES = [*CALENDAR_FEATURES, *[f"{wave}_{name}" for name in CYCLES for wave in ("sin", "cos")]]


def calendar_features(day: Column) -> dict[str, Column]:
    """Calendar parts and cyclic encodings of ``day``, in the order of ``FEATURE_NAMES``."""
    columns = {name: part(day) for name, part in CALENDAR_FEATURES.items()}
    for name, (part, period) in CYCLES.items():
        angle = F.lit(2 * math.pi) * part(day) / period
        columns[f"sin_{name}"] = F.sin(angle)
        columns[f"cos_{name}"] = F.cos(angle)
    return columns
