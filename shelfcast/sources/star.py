"""Sales lines out of a star schema of orders, line items, parts and customers.

A sales line is a line item with what its order, part and customer add. Keys of the
dimension tables are unique, and every lookup is a left join, so a query joins only the
tables whose columns it asks for and gets the same rows either way.

``lines`` gives that flat table. The ``*_facts`` tables give the same measures
summed to a coarser grain *before* the lookup join: line items are summed by the join
key with a map-side combine, so a key that holds a large part of all lines reaches the
join as a few rows. Money is exact: a decimal in flat lines, a pair of whole numbers in
facts, so sums do not depend on the order in which partitions arrive.

A line whose order, part or customer is unknown counts in every total that does not need
what is missing. Without an order it has no date, so no dated slice and no series holds it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.filters import ALL, Slice, apply_slice
from shelfcast.operators.measures import MONEY_UNITS, money_parts, sum_measures
from shelfcast.session import settle
from shelfcast.sources.columns import SALES_COLUMNS

MONEY = "decimal(18,4)"
RATE = "decimal(9,4)"

def _item_expressions() -> dict[str, Column]:
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    sales = price * (1 - discount)
    # Stand-in for the missing profit column: discounts above 8 % lose money.
    profit = price * (0.08 - discount)
    return {
        "Order ID": F.col("l_orderkey"),
        "Product ID": F.col("l_partkey"),
        "Ship Date": F.col("l_shipdate").cast("date"),
        "Quantity": F.col("l_quantity").cast("int"),
        "Discount": discount.cast(RATE),
        "Sales": sales.cast(MONEY),
        "Profit": profit.cast(MONEY),
        **money_parts("Sales", sales),
        **money_parts("Profit", profit),
        "Discount_Sum": F.rint(discount * MONEY_UNITS).cast("bigint"),
    }


def _order_expressions() -> dict[str, Column]:
    return {
        "Customer ID": F.col("o_custkey"),
        "Order Date": F.col("o_orderdate").cast("date"),
        "Ship Mode": F.col("o_orderpriority"),
    }


def _part_expressions() -> dict[str, Column]:
    return {
        "Product Name": F.col("p_name"),
        "Category": F.col("p_type"),
        "Sub-Category": F.col("p_brand"),
    }


CUSTOMER_COLUMNS = ("Segment", "City", "State", "Region")
LINE_MEASURES = ("Sales_Hi", "Sales_Lo", "Profit_Hi", "Profit_Lo", "Quantity", "Discount_Sum")


def _known_order() -> Column:
    """Lines without an order id have their sums, but are no order."""
    return F.col("Order ID").isNotNull().cast("bigint")


class SalesStar:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def _items(self, columns: Iterable[str]) -> DataFrame:
        known = _item_expressions()
        return self.table("lineitem").select(*[known[c].alias(c) for c in known if c in set(columns)])

    def _parts(self, columns: Iterable[str]) -> DataFrame:
        known = _part_expressions()
        picked = [known[c].alias(c) for c in known if c in set(columns)]
        return self.table("part").select(F.col("p_partkey").alias("Product ID"), *picked)

    def _customers(self, columns: Iterable[str]) -> DataFrame:
        wanted = set(columns)
        customers = self.table("customer").select(
            F.col("c_custkey").alias("Customer ID"), F.col("c_mktsegment").alias("Segment"), "c_nationkey"
        )
        if wanted & {"City", "State", "Region"}:
            nations = self.table("nation").select(
                F.col("n_nationkey").alias("c_nationkey"),
                F.col("n_name").alias("City"),
                F.col("n_name").alias("State"),
                "n_regionkey",
            )
            customers = customers.join(nations, "c_nationkey", "left")
        if "Region" in wanted:
            regions = self.table("region").select(
                F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("Region")
            )
            customers = customers.join(regions, "n_regionkey", "left")
        return customers.select("Customer ID", *[c for c in CUSTOMER_COLUMNS if c in wanted])

    def _orders(self, columns: Iterable[str], chosen: Slice = ALL) -> DataFrame:
        """Orders with the asked order and customer columns; the date range reaches the scan."""
        wanted = set(columns)
        known = _order_expressions()
        orders = self.table("orders")
        if chosen.has_dates:
            # On the stored type, so the range is pushed down; a cast to date would not be.
            as_stored = dict(orders.dtypes)["o_orderdate"]
            first, after = (
                F.lit(day.isoformat()).cast(as_stored)
                for day in (chosen.start, chosen.end + dt.timedelta(days=1))
            )
            orders = orders.where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < after))
        of_customer = wanted & set(CUSTOMER_COLUMNS)
        if of_customer:
            wanted.add("Customer ID")
        orders = orders.select(
            F.col("o_orderkey").alias("Order ID"), *[known[c].alias(c) for c in known if c in wanted]
        )
        if of_customer:
            orders = orders.join(self._customers(of_customer), "Customer ID", "left")
        return orders

    def lines(self, columns: Sequence[str] | None = None, chosen: Slice = ALL) -> DataFrame:
        """Flat sales lines with the asked columns (all by default), restricted to a slice.

        Customers are looked up per order, not per line; line items then move once by
        order and once by part, each only if a column of that side is asked for.
        """
        asked = list(columns) if columns is not None else list(SALES_COLUMNS)
        wanted = set(asked) | _slice_columns(chosen)
        order_side = (wanted & set(_order_expressions())) | (wanted & set(CUSTOMER_COLUMNS))
        part_side = wanted & set(_part_expressions())
        needed = wanted | ({"Order ID"} if order_side else set()) | ({"Product ID"} if part_side else set())

        lines = self._items(needed)
        if order_side:
            how = "inner" if chosen.has_dates else "left"
            lines = lines.join(self._orders(order_side, chosen), "Order ID", how)
        if part_side:
            lines = lines.join(self._parts(part_side), "Product ID", "left")
        restricted = Slice(categories=chosen.categories, regions=chosen.regions, segments=chosen.segments)
        return apply_slice(lines, restricted).select(*asked)

    def order_facts(self, attributes: Sequence[str] = (), chosen: Slice = ALL) -> DataFrame:
        """One row per order: its customer, date, measures and the asked customer columns.

        The sum by order and the join with the orders share one shuffle of the line items.
        """
        items = self._items(["Order ID", *LINE_MEASURES, *(["Product ID"] if chosen.categories is not None else [])])
        if chosen.categories is not None:
            parts = apply_slice(self._parts(["Category"]), Slice(categories=chosen.categories))
            items = items.join(parts, "Product ID", "left_semi")
        per_order = sum_measures(items, ["Order ID"]).withColumn("Orders", _known_order())
        wanted = {"Customer ID", "Order Date", *attributes}
        if chosen.regions is not None:
            wanted.add("Region")
        if chosen.segments is not None:
            wanted.add("Segment")
        how = "inner" if chosen.has_dates else "left"
        facts = per_order.join(self._orders(wanted, chosen), "Order ID", how)
        return apply_slice(facts, Slice(regions=chosen.regions, segments=chosen.segments))

    def order_facts_of_days(self, first: dt.date, last: dt.date) -> DataFrame:
        """``order_facts`` of a short span of days. The span is pushed to the scan of the orders, and
        their join comes before the sum: where so few orders can be broadcast, no other line moves."""
        orders = self._orders(["Customer ID", "Order Date"], Slice(first, last))
        items = self._items(["Order ID", *LINE_MEASURES]).join(orders, "Order ID")
        return sum_measures(items, ["Order ID", "Customer ID", "Order Date"]).withColumn("Orders", _known_order())

    def sale_days(self) -> tuple[dt.date, dt.date] | None:
        """The first and the last order date that has a line, or None.

        Searched from both ends of the order dates: the orders of a month, then of spans eight times
        as long, are joined with the lines until one has a line. Only order keys and dates are read.
        """
        day = F.col("o_orderdate").cast("date")
        ends = self.table("orders").agg(F.min(day).alias("first"), F.max(day).alias("last")).first()
        if ends["first"] is None:
            return None

        def edge(pick, span_of) -> dt.date | None:
            days = 32
            while True:
                span = span_of(dt.timedelta(days=days))
                found = self._items(["Order ID"]).join(self._orders(["Order Date"], span), "Order ID").agg(pick("Order Date")).first()[0]
                if found is not None or (span.start <= ends["first"] and span.end >= ends["last"]):
                    return found
                days *= 8

        last = edge(F.max, lambda d: Slice(max(ends["first"], ends["last"] - d), ends["last"]))
        if last is None:
            return None
        return edge(F.min, lambda d: Slice(ends["first"], min(ends["last"], ends["first"] + d))), last

    def part_order_facts(
        self, attributes: Sequence[str], order_columns: Sequence[str] = ("Customer ID", "Order Date")
    ) -> DataFrame:
        """One row per order and combination of part columns; each row counts as one order.

        That count is right for groups that keep all of ``attributes``. Orders come in
        only if a column of theirs is asked for.
        """
        items = self._items(["Order ID", "Product ID", *LINE_MEASURES])
        known = items.join(self._parts(attributes), "Product ID", "left")
        facts = sum_measures(known, ["Order ID", *attributes]).withColumn("Orders", _known_order())
        return facts.join(self._orders(order_columns), "Order ID", "left") if order_columns else facts

    def line_keys(self) -> DataFrame:
        """(kind, id): the distinct orders and parts of all lines, from one scan, written once."""
        both = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).cast("bigint").alias("id")) for n in ("Order ID", "Product ID")])
        return settle(self._items(["Order ID", "Product ID"]).select(F.inline(both)).where("id is not null").distinct())

    def sold_parts(self, columns: Sequence[str], keys: DataFrame) -> DataFrame:
        """The asked columns of parts that have a line, by the keys of all lines."""
        sold = keys.where(F.col("kind") == "Product ID").select(F.col("id").alias("Product ID"))
        return self._parts(columns).join(sold, "Product ID", "left_semi")

    def buyers(self, columns: Sequence[str], keys: DataFrame) -> DataFrame:
        """The asked columns of customers with an order that has a line, by the keys of all lines."""
        placed = keys.where(F.col("kind") == "Order ID").select(F.col("id").alias("Order ID"))
        orders = self._orders(["Customer ID"]).join(placed, "Order ID", "left_semi")
        return self._customers(columns).join(orders, "Customer ID", "left_semi")

    def customer_facts(
        self, attributes: Sequence[str], period=None, chosen: Slice = ALL
    ) -> DataFrame:
        """Measures per customer (and period), then the asked customer columns.

        ``period`` maps the order date to the label of its period. Each customer is one
        row per period, whatever the number of its orders, when the lookup join sees it.
        """
        facts = self.order_facts((), chosen)
        by = ["Customer ID"]
        if period is not None:
            facts = facts.withColumn("Order Date", period(F.col("Order Date")))
            by.append("Order Date")
        return sum_measures(facts, by).join(self._customers(attributes), "Customer ID", "left")

    def product_facts(self, attributes: Sequence[str], chosen: Slice = ALL) -> DataFrame:
        """Measures per part, then the asked part columns.

        Only restrictions on order or customer bring the orders in.
        """
        restricted = chosen.has_dates or chosen.regions is not None or chosen.segments is not None
        if restricted:
            by_order = Slice(chosen.start, chosen.end, None, chosen.regions, chosen.segments)
            items = self.lines(["Product ID", *LINE_MEASURES], by_order)
        else:
            items = self._items(["Product ID", *LINE_MEASURES])
        wanted = set(attributes) | ({"Category"} if chosen.categories is not None else set())
        facts = sum_measures(items, ["Product ID"]).join(self._parts(wanted), "Product ID", "left")
        return apply_slice(facts, Slice(categories=chosen.categories))


def _slice_columns(chosen: Slice) -> set[str]:
    names = set()
    if chosen.has_dates:
        names.add("Order Date")
    if chosen.categories is not None:
        names.add("Category")
    if chosen.regions is not None:
        names.add("Region")
    if chosen.segments is not None:
        names.add("Segment")
    return names
