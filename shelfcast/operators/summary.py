"""Rankings and breakdowns by category, region, product, segment and weekday."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfcast.functions import calendar, clean
from shelfcast.operators import measures as m
from shelfcast.operators.filters import complete_keys
from shelfcast.operators.quantiles import MOST_BROADCAST_GROUPS, exact_quantiles, small
from shelfcast.session import settle


def group_summary(facts: DataFrame, key: str) -> DataFrame:
    """Sales, profit, quantity, orders, margin and share of total per key, best first."""
    known = complete_keys(facts, key)
    summary = known.groupBy(key).agg(
        m.total(facts, "Sales").alias("Sales"),
        m.total(facts, "Profit").alias("Profit"),
        m.total_quantity().alias("Quantity"),
        m.distinct_orders(facts).alias("Orders"),
    )
    everything = F.sum("Sales").over(W.partitionBy())
    return summary.withColumns(
        {
            "Profit_Margin": clean.percent(F.col("Profit"), F.col("Sales")),
            "Sales_Share": clean.percent(F.col("Sales"), everything),
        }
    ).orderBy(F.desc("Sales"), key)


def group_margin(facts: DataFrame, key: str) -> DataFrame:
    """Sales, profit, orders and margin per key."""
    known = complete_keys(facts, key)
    summary = known.groupBy(key).agg(
        m.total(facts, "Sales").alias("Sales"),
        m.total(facts, "Profit").alias("Profit"),
        m.distinct_orders(facts).alias("Orders"),
    )
    return summary.withColumn("Profit_Margin", clean.percent(F.col("Profit"), F.col("Sales")))


def subcategory_summary(facts: DataFrame) -> DataFrame:
    known = complete_keys(facts, "Category", "Sub-Category")
    return known.groupBy("Category", "Sub-Category").agg(
        m.total(facts, "Sales").alias("Sales"), m.total(facts, "Profit").alias("Profit")
    )


def category_tree(subcategories: DataFrame) -> DataFrame:
    """Both levels of the hierarchy: sales, and profit weighted by sales.

    A leaf keeps its own profit; a category gets the sales-weighted mean of its leaves.
    The sub-category of a category row is null.
    """
    weighted = subcategories.withColumn("_weighted", F.col("Profit") * F.col("Sales"))
    levels = weighted.rollup("Category", "Sub-Category").agg(
        F.sum("Sales").alias("Sales"),
        F.try_divide(F.sum("_weighted"), F.sum("Sales")).alias("Profit_Weighted"),
        F.grouping_id().alias("_level"),
    )
    kinds = F.when(F.col("_level") == 0, "Sub-Category").otherwise("Category")
    return (
        levels.where(F.col("_level") < 3)
        .withColumn("Level", kinds)
        .select("Level", "Category", "Sub-Category", "Sales", "Profit_Weighted")
    )


def top_products(
    facts: DataFrame, keys: Sequence[str] = ("Product Name", "Category"), n: int = 10
) -> DataFrame:
    """The ``n`` best-selling products; ``keys`` decides what counts as one product."""
    known = complete_keys(facts, *keys)
    products = known.groupBy(*keys).agg(
        m.total(facts, "Sales").alias("Sales"),
        m.total(facts, "Profit").alias("Profit"),
        m.total_quantity().alias("Units_Sold"),
    )
    best = products.orderBy(F.desc("Sales"), *keys).limit(n)
    return best.withColumn("Margin_%", clean.percent(F.col("Profit"), F.col("Sales")))


def order_totals(facts: DataFrame) -> DataFrame:
    """Sales, quantity and segment per order.

    The segment of an order is the first one known: by date, then product, then name.
    Facts with one row per order carry it already.
    """
    known = complete_keys(facts, "Order ID")
    sums = [m.total(facts, "Sales").alias("Order_Sales"), m.total_quantity().alias("Order_Quantity")]
    if "Orders" in facts.columns:
        return known.select(
            "Order ID",
            m.amount(facts, "Sales").alias("Order_Sales"),
            F.col("Quantity").cast("bigint").alias("Order_Quantity"),
            "Segment",
        )
    rank = [c for c in ["Order Date", "Product ID"] if c in facts.columns]
    # Null segments get a null rank, which min_by passes over.
    position = F.when(F.col("Segment").isNotNull(), F.struct(*rank, "Segment"))
    return known.groupBy("Order ID").agg(*sums, F.min_by("Segment", position).alias("Segment"))


def segment_order_value(orders: DataFrame) -> DataFrame:
    """Total, number, mean and exact median of order values per segment.

    The orders are read several times and are written to the shared folder once. With the few
    brackets broadcast, a segment's orders are summed where they are and never brought together.
    """
    known = settle(complete_keys(orders.select("Segment", "Order_Sales"), "Segment"))
    means = known.groupBy("Segment").agg(
        F.sum(F.col("Order_Sales").cast("decimal(38,4)")).cast("double").alias("Total_Sales"),
        F.count("Order_Sales").alias("Order_Count"),
    )
    medians = exact_quantiles(known, ["Segment"], "Order_Sales", {"Median_OV": 0.5})
    return means.join(medians, "Segment", "left").select(
        "Segment",
        "Total_Sales",
        "Order_Count",
        F.try_divide("Total_Sales", F.col("Order_Count").cast("double")).alias("AOV"),
        "Median_OV",
    )


def segment_order_box(orders: DataFrame) -> DataFrame:
    """Quartiles, whiskers within 1.5 quartile ranges, and outliers per segment."""
    known = settle(complete_keys(orders.select("Segment", "Order_Sales"), "Segment"))
    quartiles = exact_quantiles(known, ["Segment"], "Order_Sales", {"Q1": 0.25, "Median": 0.5, "Q3": 0.75})
    quartiles = small(quartiles, MOST_BROADCAST_GROUPS)
    reach = 1.5 * (F.col("Q3") - F.col("Q1"))
    value = F.col("Order_Sales")
    inside = value.between(F.col("Q1") - reach, F.col("Q3") + reach)
    return (
        known.join(quartiles, "Segment")
        .groupBy("Segment", "Q1", "Median", "Q3")
        .agg(
            F.min(F.when(inside, value)).alias("Whisker_Low"),
            F.max(F.when(inside, value)).alias("Whisker_High"),
            F.count_if(~inside).alias("Outliers"),
        )
    )


def weekday_sales(facts: DataFrame) -> DataFrame:
    """Sum and mean of line sales per weekday, all seven days, Monday first.

    A weekday without lines stays null.
    """
    lines = m.with_line_measures(facts)
    found = (
        complete_keys(lines, "Order Date")
        .groupBy(calendar.day_name(F.col("Order Date")).alias("Day_Name"))
        .agg(m.total(facts, "Sales").alias("Sales_Sum"), F.sum("Lines").cast("double").alias("_lines"))
    )
    spark = facts.sparkSession
    days = spark.createDataFrame(list(enumerate(calendar.WEEKDAY_NAMES)), "Day_Order int, Day_Name string")
    return (
        days.join(found, "Day_Name", "left")
        .orderBy("Day_Order")
        .select(
            "Day_Order", "Day_Name", "Sales_Sum", F.try_divide("Sales_Sum", "_lines").alias("Sales_Mean")
        )
    )


def choices(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The known values of some columns as (Filter, Value) rows, from one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("Filter"), F.col(n).alias("Value")) for n in names])
    return df.select(F.inline(pairs)).where(F.col("Value").isNotNull()).distinct()


def filter_options(lines: DataFrame, names: Sequence[str] = ("Category", "Region", "Segment")) -> DataFrame:
    """The choices of each filter, sorted."""
    return choices(lines, names).orderBy("Filter", "Value")


def headline(facts: DataFrame) -> DataFrame:
    """Sales, profit, blended margin, orders and sales per order as one row."""
    totals = facts.agg(
        F.coalesce(m.total(facts, "Sales"), F.lit(0.0)).alias("Total_Sales"),
        F.coalesce(m.total(facts, "Profit"), F.lit(0.0)).alias("Total_Profit"),
        F.coalesce(m.distinct_orders(facts), F.lit(0)).cast("bigint").alias("Total_Orders"),
    )
    sales, orders = F.col("Total_Sales"), F.col("Total_Orders").cast("double")
    return totals.withColumns(
        {
            "Blended_Margin": clean.percent_or_zero(F.col("Total_Profit"), sales),
            "Avg_Order_Value": clean.ratio_or_zero(sales, orders),
        }
    )


def best_category(facts: DataFrame) -> DataFrame:
    """The category with the highest sales; the first by name among equals."""
    known = complete_keys(facts, "Category")
    sums = known.groupBy("Category").agg(m.total(facts, "Sales").alias("Sales"))
    return sums.orderBy(F.desc("Sales"), "Category").limit(1)
