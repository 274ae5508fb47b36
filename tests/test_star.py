"""Facts out of a star schema with hot keys and holes, against plain arithmetic."""

import collections
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import calendar
from shelfcast.operators import quality, series, summary
from shelfcast.operators.filters import Slice
from shelfcast.plans.catalogue import QUERIES
from shelfcast.sources.star import SalesStar

HOT = 7  # this order, part and customer each hold a third of all lines


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    regions = [(0, "NORTH"), (1, "SOUTH")]
    nations = [(i, f"N{i}", i % 2) for i in range(4)]
    customers = [(i, i % 4, ["HOME", "SHOP"][i % 2]) for i in range(20)]
    parts = [(i, f"part {i % 9}", f"B{i % 5}", ["X", "Y", "Z"][i % 3]) for i in range(30)]
    orders = [
        (i, HOT if i % 3 == 0 else rng.randrange(22), dt.datetime(1997, 1, 1) + dt.timedelta(days=rng.randrange(90)), "1-URGENT")
        for i in range(200)
    ]
    lines = [
        (
            HOT if rng.random() < 1 / 3 else rng.randrange(205),
            HOT if rng.random() < 1 / 3 else rng.randrange(32),
            float(rng.randrange(1, 50)), round(rng.uniform(900, 90000), 2), rng.randrange(11) / 100,
            dt.datetime(1997, 6, 1),
        )
        for _ in range(6000)
    ]
    return regions, nations, customers, parts, orders, lines


@pytest.fixture(scope="module")
def star(spark, data, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("star"))
    schemas = {
        "region": "r_regionkey int, r_name string",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
        "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
        "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
        "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
        "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, "
        "l_discount double, l_shipdate timestamp_ntz",
    }
    for (name, schema), rows in zip(schemas.items(), data):
        spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{root}/{name}.parquet")
    return SalesStar(spark, root)


@pytest.fixture(scope="module")
def flat(data):
    """Every line with its dimensions, by dictionary lookups; None where a key is unknown."""
    regions, nations, customers, parts, orders, lines = data
    region_of = {n: dict(regions)[r] for n, _, r in nations}
    customer = {c: (region_of[n], s) for c, n, s in customers}
    part = {p: (name, brand, kind) for p, name, brand, kind in parts}
    order = {o: (c, d.date()) for o, c, d, _ in orders}
    result = []
    for o, p, q, price, discount, _ in lines:
        c, d = order.get(o, (None, None))
        region, segment = customer.get(c, (None, None))
        name, brand, kind = part.get(p, (None, None, None))
        cents, percent = Decimal(str(price)), Decimal(str(discount))
        sales, profit = cents * (1 - percent), cents * (Decimal("0.08") - percent)
        result.append(
            dict(order=o, customer=c, date=d, region=region, segment=segment, name=name, brand=brand, kind=kind,
                 quantity=int(q), sales=sales, profit=profit, discount=percent)
        )
    return result


def grouped(flat, *names):
    groups = collections.defaultdict(list)
    for row in flat:
        key = tuple(row[n] for n in names)
        if None not in key:
            groups[key].append(row)
    return groups


def money(rows, name):
    return float(sum(r[name] for r in rows))


def distinct(rows, name):
    return len({r[name] for r in rows} - {None})


@pytest.fixture(params=["broadcast", "shuffled"], autouse=True)
def join_strategy(spark, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB" if request.param == "broadcast" else "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_daily(star, flat):
    got = {r["Date"]: r for r in series.daily_series(star.order_facts(), fill=False).collect()}
    expected = grouped(flat, "date")
    assert set(got) == {d for d, in expected}
    for (d,), rows in expected.items():
        assert got[d]["Sales"] == money(rows, "sales") and got[d]["Profit"] == money(rows, "profit")
        assert got[d]["Quantity"] == sum(r["quantity"] for r in rows)
        assert got[d]["Orders"] == distinct(rows, "order") and got[d]["Customers"] == distinct(rows, "customer")
        assert got[d]["Avg_Discount"] == pytest.approx(money(rows, "discount") / len(rows), rel=1e-14)


def test_daily_by_region(star, flat):
    facts = star.customer_facts(["Region"], lambda d: d)
    got = {(r["Region"], r["Date"]): r for r in series.daily_series(facts, ["Region"], fill=False).collect()}
    expected = grouped(flat, "region", "date")
    assert set(got) == set(expected)
    for key, rows in expected.items():
        assert got[key]["Sales"] == money(rows, "sales")
        assert (got[key]["Orders"], got[key]["Customers"]) == (distinct(rows, "order"), distinct(rows, "customer"))


def test_monthly_by_category(star, flat):
    got = series.monthly_series(star.part_order_facts(["Category"]), ["Category"]).collect()
    expected = collections.defaultdict(list)
    for (kind, d), rows in grouped(flat, "kind", "date").items():
        expected[kind, d.replace(day=1)] += rows
    assert {(r["Category"], r["Date"]) for r in got} == set(expected)
    for r in got:
        rows = expected[r["Category"], r["Date"]]
        assert r["Sales"] == money(rows, "sales")
        assert (r["Orders"], r["Customers"]) == (distinct(rows, "order"), distinct(rows, "customer"))


def test_summaries(star, flat):
    for key, name, facts in [
        ("Category", "kind", star.part_order_facts(["Category"], ())),
        ("Category", "kind", star.lines()),
        ("Region", "region", star.customer_facts(["Region"])),
        ("Region", "region", star.lines()),
    ]:
        got = {r[key]: r for r in summary.group_summary(facts, key).collect()}
        expected = grouped(flat, name)
        assert set(got) == {k for k, in expected}
        for (k,), rows in expected.items():
            assert got[k]["Sales"] == money(rows, "sales") and got[k]["Profit"] == money(rows, "profit")
            assert got[k]["Orders"] == distinct(rows, "order")


def test_products(star, flat):
    got = summary.top_products(star.product_facts(["Product Name", "Category"]), n=1000).collect()
    expected = grouped(flat, "name", "kind")
    assert {(r["Product Name"], r["Category"]): r["Sales"] for r in got} == {
        k: money(rows, "sales") for k, rows in expected.items()
    }


def test_order_values(star, flat):
    got = {r["Order ID"]: r for r in summary.order_totals(star.order_facts(["Segment"])).collect()}
    expected = grouped(flat, "order")
    assert set(got) == {o for o, in expected}
    for (o,), rows in expected.items():
        assert got[o]["Order_Sales"] == money(rows, "sales") and got[o]["Segment"] == rows[0]["segment"]


def test_slices_agree_with_the_flat_table(star, flat):
    chosen = Slice(dt.date(1997, 1, 10), dt.date(1997, 2, 20), ["X", "Y"], ["NORTH"], ["HOME"])
    rows = [
        r for r in flat
        if r["date"] and chosen.start <= r["date"] <= chosen.end
        and r["kind"] in chosen.categories and r["region"] == "NORTH" and r["segment"] == "HOME"
    ]
    expected = (money(rows, "sales"), distinct(rows, "order"))
    for facts in (star.order_facts((), chosen), star.lines(chosen=chosen)):
        got = summary.headline(facts).first()
        assert (got["Total_Sales"], got["Total_Orders"]) == expected
    by_part = star.product_facts(["Category"], chosen)
    assert sum(r["Sales"] for r in summary.top_products(by_part, ["Category"]).collect()) == pytest.approx(expected[0])
    by_customer = star.customer_facts(["Region"], calendar.month_start, chosen)
    got = summary.headline(by_customer).first()
    assert (got["Total_Sales"], got["Total_Orders"]) == expected


def test_only_needed_tables_and_columns_are_read(star):
    plan = star.lines(["Category", "Sales"]).groupBy("Category").agg(F.sum("Sales"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" in text and "orders.parquet" not in text and "customer.parquet" not in text
    assert "p_name" not in text and "l_shipdate" not in text


def test_dates_reach_the_scan(star):
    chosen = Slice(dt.date(1997, 1, 10), dt.date(1997, 2, 20))
    text = star.order_facts((), chosen)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1997-01-10T00:00)" in text


def test_lines_without_an_order_id_are_no_order(spark, data, tmp_path):
    names = ["region", "nation", "customer", "part", "orders", "lineitem"]
    schemas = [
        "r_regionkey int, r_name string", "n_nationkey int, n_name string, n_regionkey int",
        "c_custkey bigint, c_nationkey int, c_mktsegment string", "p_partkey bigint, p_name string, p_brand string, p_type string",
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
        "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz",
    ]
    day = dt.datetime(1997, 6, 1)
    lines = [(1, 1, 1.0, 10.0, 0.0, day), (None, 1, 1.0, 10.0, 0.0, day), (None, 1, 1.0, 5.0, 0.0, day), (999, 1, 1.0, 100.0, 0.0, day)]
    for name, schema, rows in zip(names, schemas, [*data[:5], lines]):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    star = SalesStar(spark, str(tmp_path))
    got = summary.headline(star.order_facts()).first()
    # Two orders have an id; the order of one of them is unknown, and counts in totals.
    assert (got["Total_Sales"], got["Total_Orders"], got["Avg_Order_Value"]) == (125.0, 2, 62.5)
    assert got["Total_Orders"] == summary.headline(star.lines()).first()["Total_Orders"]
    category = summary.group_summary(star.part_order_facts(["Category"], ()), "Category").first()
    assert (category["Sales"], category["Orders"]) == (125.0, 2)
    # Without an order there is no date: no series holds such lines.
    assert series.daily_totals(star.order_facts()).agg(F.sum("Sales")).first()[0] == 10.0


def test_days_of_sales_are_searched_from_both_ends(spark, tmp_path):
    """Orders without lines at both ends, and a long time without any."""
    days = ["1990-01-01", "1995-03-01", "1995-03-02", "2001-08-01", "2020-01-01"]
    orders = [(i, 1, day, "1-URGENT") for i, day in enumerate(days)]
    frame = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, day string, o_orderpriority string")
    frame.withColumn("o_orderdate", F.col("day").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    schema = "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz, l_quantity double, l_discount double, l_extendedprice double"
    rows = [(1, 1, None, 1.0, 0.0, 5.0), (3, 1, None, 1.0, 0.0, 7.0), (99, 1, None, 1.0, 0.0, 9.0), (None, 1, None, 1.0, 0.0, 9.0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    star = SalesStar(spark, str(tmp_path))
    assert [d.isoformat() for d in star.sale_days()] == ["1995-03-01", "2001-08-01"]
    facts = star.order_facts_of_days(*star.sale_days())
    assert sorted((r["Order ID"], r["Orders"]) for r in facts.collect()) == [(1, 1), (3, 1)]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert SalesStar(spark, str(tmp_path)).sale_days() is None


@pytest.mark.parametrize("name", ["recent_actuals", "last_120_days"])
def test_newest_days_push_their_date_to_the_orders(spark, root, name):
    plan = QUERIES[name](spark, root)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "o_orderdate" in line and "Scan" in line)
    assert "GreaterThanOrEqual(o_orderdate" in scan.split("PushedFilters")[1]


@pytest.mark.parametrize("name", ["quality_report", "filter_options"])
def test_lines_are_read_once_beforehand(spark, root, name):
    """What is left to run reads the written groups or keys."""
    plan = QUERIES[name](spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "l_partkey" not in plan


def test_quality_report_does_not_group_the_lines(spark, root, monkeypatch):
    """What is written beforehand has a row for each line: no task holds groups of nearly all lines in memory."""
    written = []
    monkeypatch.setattr(quality, "settle", lambda df: written.append(df) or df)
    QUERIES["quality_report"](spark, root)
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(written) == 1 and "l_orderkey" in plan and "Aggregate" not in plan
