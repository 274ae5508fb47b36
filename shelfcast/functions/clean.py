"""Cleaning rules for sales lines that arrive as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for a missing value in a CSV cell.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Beside ISO dates, with or without a time of day, which need no pattern.
DATE_FORMATS = ("M/d/yyyy", "yyyy/MM/dd", "M-d-yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")


def text_or_null(text: Column) -> Column:
    """The text itself, or null where it is one of the missing-value tokens."""
    return F.when(~text.isin(MISSING_TOKENS), text)


def number_or(text: Column, default: float) -> Column:
    """Text to double; what is missing or no number becomes ``default``.

    The JVM also reads the literals ``1.5d`` and ``1.5f``; those are no numbers here.
    """
    trimmed = F.trim(text.cast("string"))
    literal = F.right(trimmed, F.lit(1)).isin("d", "D", "f", "F") & ~F.lower(trimmed).endswith("inf")
    value = F.when(~literal, trimmed.try_cast("double"))
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(float(default)))


def whole_number_or(text: Column, default: int) -> Column:
    """As ``number_or``, then cut toward zero (``'2.9'`` is 2)."""
    return number_or(text, default).cast("int")


def parse_date(
    text: Column, name: str, required: bool, formats: Sequence[str] = DATE_FORMATS
) -> Column:
    """Text to date: ISO, else by the first format that fits.

    A value that fits none fails the job, and so does a blank one if ``required``.
    """
    value = text_or_null(F.trim(text))
    patterns = [F.to_date(F.try_to_timestamp(value, F.lit(f))) for f in formats]
    parsed = F.coalesce(value.try_cast("date"), *patterns)
    bad = value.isNotNull() & parsed.isNull()
    if required:
        bad = bad | value.isNull()
    message = F.concat(F.lit(f"{name}: not a date: "), F.coalesce(text, F.lit("(blank)")))
    return F.when(bad, F.raise_error(message).cast("date")).otherwise(parsed)


def unit_price(sales: Column, quantity: Column) -> Column:
    return F.when(quantity > 0, sales / quantity).otherwise(sales)


def line_margin(sales: Column, profit: Column) -> Column:
    """Profit in percent of sales; 0 for lines without positive sales."""
    return F.when(sales > 0, profit / sales * 100).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, null where ``whole`` is zero (ANSI division would fail the job)."""
    return F.try_divide(part, whole)


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def percent_or_zero(part: Column, whole: Column) -> Column:
    """Headline form of ``percent``: 0 unless the whole is positive."""
    return F.when(whole > 0, ratio(part, whole) * 100).otherwise(F.lit(0.0))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, ratio(part, whole)).otherwise(F.lit(0.0))


def not_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))
