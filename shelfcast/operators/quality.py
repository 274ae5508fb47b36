"""Checks on the clean sales lines: size, span, nulls, duplicates, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions import calendar, clean
from shelfcast.operators import measures as m
from shelfcast.session import settle

DUPLICATE_KEY = ("Order ID", "Product ID")


def _nulls(name: str) -> Column:
    return F.count_if(F.col(f"`{name}`").isNull())


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column as (Column, Nulls) rows, in one pass."""
    counts = df.agg(*[_nulls(name).alias(name) for name in df.columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("Column"), F.col(f"`{c}`").alias("Nulls")) for c in df.columns]
    )
    return counts.select(F.inline(pairs))


def columns_with_nulls(df: DataFrame) -> DataFrame:
    return null_counts(df).where(F.col("Nulls") > 0)


def duplicate_lines(lines: DataFrame, key: Sequence[str] = DUPLICATE_KEY) -> DataFrame:
    """Rows beyond the first per key. Nulls count as equal, as ``groupBy`` takes them."""
    per_key = lines.groupBy(*key).count()
    return per_key.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("Duplicate_Rows"))


def date_bounds(facts: DataFrame) -> DataFrame:
    day = F.col("Order Date")
    return facts.agg(F.min(day).alias("Start_Date"), F.max(day).alias("End_Date"))


def _distinct(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*names).distinct()


def _known(rows: DataFrame, name: str) -> DataFrame:
    return _distinct(rows.where(F.col(name).isNotNull()), name).agg(F.count(F.lit(1)).alias("n"))


def _values(rows: DataFrame, name: str) -> DataFrame:
    return _distinct(rows, name).agg(F.sort_array(F.collect_list(name)).alias(name))


def quality_report(lines: DataFrame) -> DataFrame:
    """The data-quality report as one row.

    One pass over the lines writes what the counts need of each, without summing: lines hardly share
    an order and a product, so groups would be as many and fill the memory of a task. Every count is
    then a scalar subquery of its own over those narrow rows: it reads a column or two and combines
    on the map side, where a single aggregate over all of them would copy every line once per
    distinct column.
    """
    missing = sum((F.col(f"`{c}`").isNull().cast("int") for c in lines.columns), F.lit(0))
    keys = ["Order ID", "Product ID", "Customer ID", "Category", "Region"]
    narrow = settle(lines.select(*keys, "Order Date", missing.alias("_missing"), "Sales", "Profit"))
    nothing = F.lit(0).cast("bigint")
    base = narrow.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("Order Date").alias("_first"),
        F.max("Order Date").alias("_last"),
        F.coalesce(F.sum("_missing"), nothing).alias("missing_values"),
        m.total(narrow, "Sales").alias("total_sales"),
        m.total(narrow, "Profit").alias("total_profit"),
    )
    pairs = _distinct(narrow, *DUPLICATE_KEY).agg(F.count(F.lit(1)).alias("n"))
    return base.select(
        "total_rows",
        F.lit(len(lines.columns)).alias("total_columns"),
        calendar.iso_text(F.col("_first")).alias("start_date"),
        calendar.iso_text(F.col("_last")).alias("end_date"),
        (F.datediff("_last", "_first") + 1).alias("total_days_span"),
        "missing_values",
        (F.col("total_rows") - pairs.scalar()).alias("duplicate_rows"),
        "total_sales",
        "total_profit",
        clean.percent(F.col("total_profit"), F.col("total_sales")).alias("overall_profit_margin"),
        _known(narrow, "Order ID").scalar().alias("unique_orders"),
        _known(narrow, "Customer ID").scalar().alias("unique_customers"),
        _known(narrow, "Product ID").scalar().alias("unique_products"),
        _values(narrow, "Category").scalar().alias("categories"),
        _values(narrow, "Region").scalar().alias("regions"),
    )
