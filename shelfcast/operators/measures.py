"""Additive measures of sales lines and what is read off them.

Lines carry ``Sales``, ``Quantity``, ``Profit`` and ``Discount``. Facts, which are lines
summed to a coarser grain, carry additive columns only: ``Quantity``, ``Discount_Sum``,
``Lines``, where a row stands for whole orders ``Orders``, and money either as it is or
exactly, in two whole numbers. Every operator takes lines and facts alike.

Exact money counts ten-thousandths. Splitting that count into ``_Hi`` and ``_Lo`` keeps
each sum a plain machine integer, far from overflow for any table, where a decimal sum
would cost several times the time per line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY_UNITS = 10_000
LOW_BITS = 20
MONEY = ("Sales", "Profit")

ADDITIVE = [
    "Sales", "Profit", "Sales_Hi", "Sales_Lo", "Profit_Hi", "Profit_Lo", "Quantity", "Discount_Sum", "Lines", "Orders",
]


def money_parts(name: str, amount: Column) -> dict[str, Column]:
    """An amount in whole ten-thousandths, split into a high and a low part."""
    units = F.rint(amount * MONEY_UNITS).cast("bigint")
    return {
        f"{name}_Hi": F.shiftright(units, LOW_BITS),
        f"{name}_Lo": units.bitwiseAND(F.lit((1 << LOW_BITS) - 1)),
    }


def _whole(high: Column, low: Column) -> Column:
    """The amount behind two parts, as a double nearest to the exact decimal."""
    units = high.cast("decimal(19,0)") * F.lit(1 << LOW_BITS).cast("decimal(7,0)") + low.cast("decimal(19,0)")
    return (units * F.expr("0.0001BD")).cast("double")


def amount(df: DataFrame, name: str) -> Column:
    """The money of a single row."""
    if f"{name}_Hi" in df.columns:
        return _whole(F.col(f"{name}_Hi"), F.col(f"{name}_Lo"))
    return F.col(name).cast("double")


def total(df: DataFrame, name: str) -> Column:
    """The money of a group of rows; null for no rows."""
    if f"{name}_Hi" in df.columns:
        return _whole(F.sum(f"{name}_Hi"), F.sum(f"{name}_Lo"))
    return F.sum(name).cast("double")


def total_quantity() -> Column:
    return F.sum("Quantity").cast("bigint")


def with_line_measures(df: DataFrame) -> DataFrame:
    """Lines get ``Discount_Sum`` and ``Lines``; facts have them already."""
    extra = {}
    if "Discount_Sum" not in df.columns and "Discount" in df.columns:
        extra["Discount_Sum"] = F.col("Discount")
    if "Lines" not in df.columns:
        extra["Lines"] = F.lit(1).cast("bigint")
    return df.withColumns(extra) if extra else df


def sum_measures(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum all additive measures present to the grain of ``by``."""
    facts = with_line_measures(df)
    present = [name for name in ADDITIVE if name in facts.columns]
    return facts.groupBy(*by).agg(*[F.sum(name).alias(name) for name in present])


def order_facts(lines: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """Flat lines summed per order, customer, date and the asked columns.

    Distinct counts of orders and customers then read far fewer rows. An order may still
    hold several rows here, so no ``Orders`` count is claimed.
    """
    by = list(dict.fromkeys([*attributes, "Order ID", "Customer ID", "Order Date"]))
    return sum_measures(lines, by)


def distinct_orders(df: DataFrame) -> Column:
    if "Orders" in df.columns:
        return F.sum("Orders").cast("bigint")
    return F.count_distinct("Order ID")


def distinct_customers(df: DataFrame) -> Column:
    return F.count_distinct("Customer ID")


def mean_discount(df: DataFrame) -> Column:
    """Mean discount per line."""
    if "Discount_Sum" not in df.columns:
        return F.avg("Discount")
    discounts = F.sum("Discount_Sum").cast("double")
    if dict(df.dtypes)["Discount_Sum"] == "bigint":
        discounts = discounts / MONEY_UNITS
    return F.try_divide(discounts, F.sum("Lines").cast("double"))
