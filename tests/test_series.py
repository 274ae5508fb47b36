import pytest
from pyspark.sql import functions as F

from shelfcast.operators import measures, series
from shelfcast.operators.filters import Slice, apply_slice

from helpers import daily, day, line, lines


@pytest.fixture(scope="module")
def gapped(spark):
    return lines(
        spark,
        line(order="o1", date="2017-12-29", sales=1.0, discount=0.2),
        line(order="o1", date="2017-12-29", sales=2.0, product="p2"),
        line(order="o2", customer="c2", date="2017-12-29", sales=4.0),
        line(order="o3", customer=None, date="2018-01-01", sales=8.0, quantity=3),
        line(order=None, customer="c2", date="2018-01-01", sales=16.0),
        line(order="o4", date="2018-03-05", sales=32.0, region=None),
    )


def rows(df):
    return [tuple(r) for r in df.orderBy("Date").collect()]


@pytest.mark.parametrize("summed", [False, True])
def test_daily_fills_gaps(gapped, summed):
    facts = measures.order_facts(gapped) if summed else gapped
    got = rows(series.daily_series(facts))
    assert len(got) == 67
    assert got[0] == (day("2017-12-29"), 7.0, 3, 3.0, 2, 2, pytest.approx(0.2 / 3))
    assert got[1] == (day("2017-12-30"), 0.0, 0, 0.0, 0, 0, 0.0)
    # null orders and customers do not count
    assert got[3] == (day("2018-01-01"), 24.0, 4, 2.0, 1, 1, 0.0)
    assert sum(r[1] for r in got) == 63.0


def test_daily_without_fill(gapped):
    assert [r[0] for r in rows(series.daily_series(gapped, fill=False))] == [
        day("2017-12-29"), day("2018-01-01"), day("2018-03-05"),
    ]


def test_weeks_end_on_sunday_and_empty_ones_are_zero(gapped):
    got = rows(series.weekly_series(gapped))
    assert [r[:2] for r in got[:3]] == [(day("2017-12-31"), 7.0), (day("2018-01-07"), 24.0), (day("2018-01-14"), 0.0)]
    assert got[-1][:2] == (day("2018-03-11"), 32.0) and len(got) == 11


def test_months_start_on_the_first_and_empty_ones_are_zero(gapped):
    got = [r[:2] for r in rows(series.monthly_series(gapped))]
    assert got == [
        (day("2017-12-01"), 7.0), (day("2018-01-01"), 24.0), (day("2018-02-01"), 0.0), (day("2018-03-01"), 32.0),
    ]


def test_keys_have_their_own_span_and_null_keys_go(gapped):
    got = series.daily_series(gapped, ["Region"])
    assert got.select("Region").distinct().count() == 1 and got.count() == 4


def test_moving_average_waits_for_a_full_window(spark):
    got = series.moving_averages(daily(spark, range(10)), windows=(3,)).orderBy("Date").collect()
    assert [r["MA_3"] for r in got] == [None, None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]


def test_recent_days_start_at_the_cutoff(gapped):
    got = rows(series.recent_daily(gapped, days=63))
    assert got[0] == (day("2018-01-01"), 24.0) and got[-1] == (day("2018-03-05"), 32.0) and len(got) == 64
    got = rows(series.recent_daily(gapped, days=10))
    assert len(got) == 11 and got[0] == (day("2018-02-23"), 0.0)


def test_last_days(spark):
    frame = daily(spark, range(10))
    assert sorted(r["Sales"] for r in series.last_days(frame, 3).collect()) == [7.0, 8.0, 9.0]
    keyed = daily(spark, range(5), key="a").unionByName(daily(spark, range(5), key="b"))
    assert series.last_days(keyed, 2, ["Region"]).count() == 4


def test_season_table_keeps_missing_months_null(gapped):
    got = series.season_pivot(series.monthly_totals(gapped)).orderBy("Year").collect()
    assert got[0].asDict()["Dec"] == 7.0 and got[0]["Nov"] is None
    assert (got[1]["Jan"], got[1]["Feb"], got[1]["Mar"], got[1]["Apr"]) == (24.0, 0.0, 32.0, None)
    labels = series.monthly_totals(gapped).orderBy("Date").select("Month_Label").collect()
    assert [r[0] for r in labels] == ["Dec 2017", "Jan 2018", "Feb 2018", "Mar 2018"]


def test_slices(gapped):
    assert apply_slice(gapped, Slice()).count() == 6
    assert apply_slice(gapped, Slice(categories=[])).count() == 0
    assert apply_slice(gapped, Slice(regions=["West"])).count() == 5
    both = Slice(start=day("2017-12-29"), end=day("2018-01-01"))
    assert apply_slice(gapped, both).count() == 5
    # one end alone means the full span
    assert apply_slice(gapped, Slice(start=day("2018-01-01"))).count() == 6


def test_fill_from_an_earlier_start(spark):
    frame = daily(spark, [5.0], start="2018-01-03")
    got = rows(series.fill_gaps(frame, start=F.lit(day("2018-01-01"))))
    assert got == [(day("2018-01-01"), 0.0), (day("2018-01-02"), 0.0), (day("2018-01-03"), 5.0)]
