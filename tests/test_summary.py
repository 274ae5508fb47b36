import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import measures, quality, summary
from shelfcast.operators.quantiles import ACCURACY, exact_quantiles
from shelfcast.plans.dashboard import Dashboard
from shelfcast.operators.filters import Slice

from helpers import line, lines


@pytest.fixture(scope="module")
def shop(spark):
    return lines(
        spark,
        line(order="o1", category="B", sub="x", name="n1", product="p1", sales=10.0, profit=1.0),
        line(order="o1", category="A", sub="y", name="n1", product="p2", sales=10.0, profit=3.0, date="2017-01-03"),
        line(order="o2", category="C", sub="z", name="n2", product="p3", sales=0.0, profit=-1.0, segment=None),
        line(order="o2", category="C", sub="z", name="n2", product="p3", sales=0.0, profit=-1.0, segment="Corporate"),
        line(order="o3", category=None, sub="w", name="n3", product="p4", sales=5.0, profit=1.0, date="2017-01-07"),
        line(order=None, category="A", sub="y", name="n1", product="p2", sales=2.0, profit=0.0, region="East"),
        line(order=None, category="A", sub="y", name="n1", product="p2", sales=3.0, profit=0.0, region="East"),
    )


def test_summary_ranks_and_guards(shop):
    got = {r["Category"]: r for r in summary.group_summary(shop, "Category").collect()}
    assert list(got) == ["A", "B", "C"]
    assert got["A"]["Sales"] == 15.0 and got["A"]["Sales_Share"] == 60.0 and got["A"]["Orders"] == 1
    assert got["C"]["Profit_Margin"] is None


def test_best_category_takes_the_first_of_equals(spark):
    frame = lines(spark, line(category="B", sales=4.0), line(category="A", sales=4.0))
    assert summary.best_category(frame).first()["Category"] == "A"


def test_products_by_name_and_by_id_differ(spark):
    frame = lines(
        spark,
        line(product="p1", name="Pen", sales=3.0),
        line(product="p2", name="Pen", sales=4.0),
        line(product="p3", name="Ink", sales=5.0),
    )
    assert [r["Product Name"] for r in summary.top_products(frame).collect()] == ["Pen", "Ink"]
    by_id = summary.top_products(frame, ["Product ID", "Product Name", "Category"]).collect()
    assert [r["Product ID"] for r in by_id] == ["p3", "p2", "p1"]
    assert summary.top_products(frame, n=1).count() == 1


def test_tree_weights_profit_by_sales(shop):
    tree = summary.category_tree(summary.subcategory_summary(shop))
    got = {(r["Category"], r["Sub-Category"]): r["Profit_Weighted"] for r in tree.collect()}
    assert got[("A", None)] == 3.0 and got[("C", None)] is None and ("A", "y") in got and len(got) == 6


@pytest.mark.parametrize("summed", [False, True])
def test_first_known_segment_of_an_order(shop, summed):
    facts = measures.order_facts(shop, ["Segment"]) if summed else shop
    got = {r["Order ID"]: r for r in summary.order_totals(facts).collect()}
    assert set(got) == {"o1", "o2", "o3"}
    assert got["o2"]["Segment"] == "Corporate" and got["o1"]["Order_Sales"] == 20.0


def test_weekdays_are_complete(shop):
    got = summary.weekday_sales(shop).collect()
    assert [r["Day_Name"] for r in got] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert got[0]["Sales_Sum"] == 15.0 and got[0]["Sales_Mean"] == 3.0
    assert got[2]["Sales_Sum"] is None and got[5]["Sales_Mean"] == 5.0


def test_headline_of_nothing_is_zero(shop):
    got = summary.headline(shop.where("false")).first()
    assert tuple(got) == (0.0, 0.0, 0, 0.0, 0.0)
    got = summary.headline(shop).first()
    assert got["Total_Orders"] == 3 and got["Blended_Margin"] == pytest.approx(10.0)


def test_duplicates_count_nulls_as_equal(shop):
    assert quality.duplicate_lines(shop).first()[0] == 2
    assert quality.duplicate_lines(shop.where("false")).first()[0] == 0


def test_nulls_per_column(shop):
    got = {r["Column"]: r["Nulls"] for r in quality.columns_with_nulls(shop).collect()}
    assert got == {"Order ID": 2, "Category": 1, "Segment": 1}


def test_options_are_sorted(shop):
    got = [tuple(r) for r in summary.filter_options(shop).collect()]
    assert got == [
        ("Category", "A"), ("Category", "B"), ("Category", "C"), ("Region", "East"), ("Region", "West"),
        ("Segment", "Consumer"), ("Segment", "Corporate"),
    ]


def quantile_truth(values, p):
    return float(np.quantile(np.array(values), p))


def test_quantiles_of_small_groups(spark):
    random.seed(1)
    groups = {f"g{n}": [random.choice([1.5, 2.25, 7.0, random.random()]) for _ in range(n)] for n in range(1, 30)}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("g1", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    wanted = {"a": 0.0, "q1": 0.25, "m": 0.5, "q3": 0.75, "z": 1.0}
    got = exact_quantiles(frame, ["g"], "v", wanted).collect()
    assert len(got) == len(groups)
    for r in got:
        for name, p in wanted.items():
            assert r[name] == pytest.approx(quantile_truth(groups[r["g"]], p), abs=1e-12)


def test_quantiles_beyond_the_sketch(spark):
    rng = np.random.default_rng(7)
    n = 6 * ACCURACY
    smooth = rng.lognormal(3, 1, n).round(4)
    # a third of the rows share one value that lies between the quartiles
    hot = np.concatenate([np.full(n // 3, 20.0), rng.lognormal(3, 1, n - n // 3).round(4)])
    frame = spark.createDataFrame(
        [("smooth", float(v)) for v in smooth] + [("hot", float(v)) for v in hot], "g string, v double"
    ).repartition(8)
    wanted = {"q1": 0.25, "m": 0.5, "q3": 0.75}
    got = {r["g"]: r for r in exact_quantiles(frame, ["g"], "v", wanted).collect()}
    for g, values in [("smooth", smooth), ("hot", hot)]:
        for name, p in wanted.items():
            assert got[g][name] == pytest.approx(quantile_truth(values, p), rel=1e-12)


def test_segment_values_and_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    orders = spark.createDataFrame([("s", v) for v in values] + [(None, 9.0)], "Segment string, Order_Sales double")
    got = summary.segment_order_value(orders).collect()
    assert [tuple(r) for r in got] == [("s", 110.0, 5, 22.0, 3.0)]
    box = summary.segment_order_box(orders).first()
    assert (box["Q1"], box["Median"], box["Q3"]) == (2.0, 3.0, 4.0)
    assert (box["Whisker_Low"], box["Whisker_High"], box["Outliers"]) == (1.0, 4.0, 1)


def test_dashboard_follows_the_slice(spark, shop):
    board = Dashboard(shop, Slice(regions=["East"]))
    assert board.headline().first()["Total_Sales"] == 5.0
    assert [r["Category"] for r in board.categories().collect()] == ["A"]
    assert board.recent_actuals().agg(F.sum("Sales")).first()[0] == 30.0
    assert board.options().count() == 7 and not board.is_empty()
    assert Dashboard(shop, Slice(segments=[])).is_empty()
    assert board.daily_trend().columns == ["Date", "Sales", "MA_7", "MA_30"]
    assert board.best_category().first()["Category"] == "A"
    assert board.top_products().count() == 1 and board.category_tree().count() == 2
    assert board.weekdays().count() == 7 and board.monthly_trend().count() == 1
    assert tuple(board.date_bounds().first()) == (shop.agg(F.min("Order Date")).first()[0], shop.agg(F.max("Order Date")).first()[0])


def test_a_quantile_outside_its_bracket_fails(spark, monkeypatch):
    from shelfcast.operators import quantiles

    monkeypatch.setattr(quantiles, "MARGIN", -0.2)  # brackets that miss
    frame = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="outside its bracket"):
        exact_quantiles(frame, ["g"], "v", {"m": 0.5}).collect()


@pytest.mark.parametrize("most", [0, 10_000])
def test_quantiles_with_and_without_a_broadcast(spark, monkeypatch, most):
    from shelfcast.operators import quantiles

    monkeypatch.setattr(quantiles, "MOST_BROADCAST_GROUPS", most)
    frame = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.pmod(F.col("id") * 7919, F.lit(20_011)).cast("double").alias("v"))
    wanted = {"a": 0.25, "b": 0.5, "c": 0.999}
    got = {r["g"]: r for r in exact_quantiles(frame, ["g"], "v", wanted).collect()}
    for g in range(3):
        values = [i * 7919 % 20_011 for i in range(30_000) if i % 3 == g]
        for name, p in wanted.items():
            assert got[g][name] == pytest.approx(quantile_truth(values, p), rel=1e-12)


def test_orders_of_a_segment_are_not_brought_together(spark):
    orders = spark.range(5000).select((F.col("id") % 2).cast("string").alias("Segment"), F.col("id").cast("double").alias("Order_Sales"))
    plan = summary.segment_order_box(orders)._jdf.queryExecution().executedPlan().toString()
    # The one exchange by segment is above a partial aggregate.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
