"""Calendar series: aggregation by day, week and month, and filling of gaps.

Each function takes ``keys``: none for the one series over everything, or columns such
as ``Region`` for one series per key. Windows run over aggregated rows only, at most one
per key and calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.functions import calendar
from shelfcast.operators import measures as m
from shelfcast.operators.filters import complete_keys

DISPLAY_WINDOWS = (7, 30)
RECENT_DAYS = 90

# The last label before a following one, and the distance between labels.
STEPS = {
    "day": (lambda following: F.date_sub(following, 1), "interval 1 day"),
    "week": (lambda following: F.date_sub(following, 7), "interval 7 days"),
    "month": (lambda following: F.add_months(following, -1).cast("date"), "interval 1 month"),
}


def fill_gaps(
    series: DataFrame,
    keys: Sequence[str] = (),
    step: str = "day",
    date: str = "Date",
    start: Column | None = None,
) -> DataFrame:
    """Zero rows for the labels missing between the first and the last of each series.

    Each row stretches to just before its successor, so the aggregates are read once and
    nothing is joined. ``start`` moves the first label of a series back.
    """
    order = W.partitionBy(*keys).orderBy(date)
    before, length = STEPS[step]
    here = F.col(date)
    begin = here
    if start is not None:
        begin = F.when(F.lag(here).over(order).isNull(), F.least(start, here)).otherwise(here)
    stretched = series.withColumns(
        {"_begin": begin, "_end": F.coalesce(before(F.lead(here).over(order)), here)}
    )
    every = stretched.withColumn(
        "_label", F.explode(F.sequence("_begin", "_end", F.expr(length)))
    )
    values = [c for c in series.columns if c != date and c not in keys]
    types = dict(series.dtypes)
    return every.select(
        *keys,
        F.col("_label").alias(date),
        *[
            F.when(F.col("_label") == here, F.col(c)).otherwise(F.lit(0)).cast(types[c]).alias(c)
            for c in values
        ],
    )


def _by_period(
    facts: DataFrame, keys: Sequence[str], label: Column, with_discount: bool
) -> DataFrame:
    dated = complete_keys(facts.withColumn("Date", label), "Date", *keys)
    columns = [
        m.total(facts, "Sales").alias("Sales"),
        m.total_quantity().alias("Quantity"),
        m.total(facts, "Profit").alias("Profit"),
        m.distinct_orders(facts).alias("Orders"),
        m.distinct_customers(facts).alias("Customers"),
    ]
    if with_discount:
        columns.append(m.mean_discount(facts).alias("Avg_Discount"))
    return dated.groupBy(*keys, "Date").agg(*columns)


def daily_series(facts: DataFrame, keys: Sequence[str] = (), fill: bool = True) -> DataFrame:
    """Sales, quantity, profit, orders, customers and mean discount per day."""
    daily = _by_period(facts, keys, F.col("Order Date").cast("date"), True)
    return fill_gaps(daily, keys, "day") if fill else daily


def weekly_series(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Monday-to-Sunday weeks, each labelled by its Sunday; empty weeks are zero."""
    weekly = _by_period(facts, keys, calendar.week_end(F.col("Order Date")), False)
    return fill_gaps(weekly, keys, "week")


def monthly_series(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Months labelled by their first day; empty months are zero."""
    monthly = _by_period(facts, keys, calendar.month_start(F.col("Order Date")), False)
    return fill_gaps(monthly, keys, "month")


def _sums_by(facts: DataFrame, keys: Sequence[str], label: Column, names: Sequence[str]) -> DataFrame:
    dated = complete_keys(facts.withColumn("Date", label), "Date", *keys)
    return dated.groupBy(*keys, "Date").agg(*[m.total(facts, c).alias(c) for c in names])


def daily_totals(
    facts: DataFrame, keys: Sequence[str] = (), names: Sequence[str] = ("Sales",), start: Column | None = None
) -> DataFrame:
    """Gap-filled daily sums of the named measures only; ``start`` moves the first day back."""
    return fill_gaps(_sums_by(facts, keys, F.col("Order Date").cast("date"), names), keys, "day", start=start)


def monthly_totals(
    facts: DataFrame, keys: Sequence[str] = (), names: Sequence[str] = ("Sales", "Profit")
) -> DataFrame:
    """Gap-filled monthly sums with year, month and a label such as ``Jan 2014``."""
    monthly = _sums_by(facts, keys, calendar.month_start(F.col("Order Date")), names)
    return fill_gaps(monthly, keys, "month").withColumns(
        {
            "Year": F.year("Date"),
            "Month": F.month("Date"),
            "Month_Label": calendar.month_label(F.col("Date")),
        }
    )


def moving_averages(
    daily: DataFrame,
    keys: Sequence[str] = (),
    windows: Sequence[int] = DISPLAY_WINDOWS,
    value: str = "Sales",
) -> DataFrame:
    """``MA_w``: mean of the current and the ``w - 1`` days before; null until w days exist."""
    order = W.partitionBy(*keys).orderBy("Date")
    position = F.row_number().over(order)
    return daily.withColumns(
        {
            f"MA_{w}": F.when(position >= w, F.avg(value).over(order.rowsBetween(1 - w, 0)))
            for w in windows
        }
    )


def recent_daily(
    facts: DataFrame, keys: Sequence[str] = (), days: int = RECENT_DAYS
) -> DataFrame:
    """Daily sales from ``days`` before the last day on, that cutoff day included.

    The last day is read off the daily sums, so the lines are scanned once.
    """
    daily = _sums_by(facts, keys, F.col("Order Date").cast("date"), ["Sales"])
    last = F.max("Date").over(W.partitionBy(*keys))
    kept = daily.withColumn("_cutoff", F.date_sub(last, days)).where(F.col("Date") >= F.col("_cutoff"))
    filled = fill_gaps(kept, [*keys, "_cutoff"], "day", start=F.col("_cutoff"))
    return filled.drop("_cutoff")


def last_days(daily: DataFrame, days: int = 120, keys: Sequence[str] = ()) -> DataFrame:
    """The newest ``days`` rows of each series."""
    if not keys:
        return daily.orderBy(F.desc("Date")).limit(days)
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("Date")))
    return daily.withColumn("_n", newest).where(F.col("_n") <= days).drop("_n")


def by_year(monthly: DataFrame, year: int | None = None) -> DataFrame:
    """Monthly rows as one line per year, or the months of a single year."""
    picked = monthly if year is None else monthly.where(F.col("Year") == year)
    return picked.orderBy("Year", "Month")


def years(monthly: DataFrame) -> DataFrame:
    return monthly.select("Year").distinct().orderBy("Year")


def season_pivot(monthly: DataFrame) -> DataFrame:
    """Sales by year (rows) and month (columns January to December)."""
    wide = monthly.groupBy("Year").pivot("Month", list(range(1, 13))).agg(F.sum("Sales"))
    return wide.select(
        "Year",
        *[F.col(str(i)).alias(name) for i, name in enumerate(calendar.MONTH_NAMES, start=1)],
    )
