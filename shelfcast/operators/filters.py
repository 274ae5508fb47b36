"""The slice a user picks: dates, categories, regions, segments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slice:
    """``None`` means no restriction. An empty list matches nothing.

    The date range needs both ends; with one end missing the full span is taken.
    """

    start: dt.date | None = None
    end: dt.date | None = None
    categories: Sequence[str] | None = None
    regions: Sequence[str] | None = None
    segments: Sequence[str] | None = None

    @property
    def has_dates(self) -> bool:
        return self.start is not None and self.end is not None


ALL = Slice()


def date_range(day: Column, start: dt.date | None, end: dt.date | None) -> Column:
    """Inclusive on both ends, on the date part."""
    if start is None or end is None:
        return F.lit(True)
    return day.cast("date").between(F.lit(start), F.lit(end))


def in_set(value: Column, wanted: Sequence[str] | None) -> Column:
    return F.lit(True) if wanted is None else value.isin(list(wanted))


def apply_slice(lines: DataFrame, chosen: Slice) -> DataFrame:
    """The rows of the slice; one conjunction that Catalyst pushes to the scan."""
    if chosen.has_dates:
        lines = lines.where(date_range(F.col("Order Date"), chosen.start, chosen.end))
    wanted_sets = {
        "Category": chosen.categories, "Region": chosen.regions, "Segment": chosen.segments,
    }
    for name, wanted in wanted_sets.items():
        if wanted is not None:
            lines = lines.where(in_set(F.col(name), wanted))
    return lines


def complete_keys(df: DataFrame, *names: str) -> DataFrame:
    """Rows whose grouping keys are all present."""
    return df.dropna(subset=list(names)) if names else df
