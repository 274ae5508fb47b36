import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.calendar import FEATURE_NAMES, calendar_features
from shelfcast.operators.features import (
    FeatureSpec, build_features, chronological_split, next_features, short_series, split_frames, split_parts,
)

from helpers import buffer_features, daily, day

SPEC = FeatureSpec()


def test_default_names():
    assert len(SPEC.names) == 36 and SPEC.memory == 30
    assert SPEC.names[:3] == ["day_of_week", "day_of_month", "month"]
    assert SPEC.names[8:10] == ["sin_month", "cos_month"]
    assert SPEC.names[-2:] == ["momentum_7_30", "sales_diff_1_7"]


def test_empty_means_none_and_absent_means_default():
    assert FeatureSpec(lags=[]).lags == () and FeatureSpec().lags[-1] == 30
    bare = FeatureSpec(lags=(1, 2), windows=(7,))
    assert "momentum_7_30" not in bare.names and "sales_diff_1_7" not in bare.names


def test_ramp(spark):
    matrix = build_features(daily(spark, range(1, 61)), SPEC).orderBy("Date").collect()
    assert len(matrix) == 30
    first = matrix[0]
    assert first["Sales"] == 31.0 and first["lag_1"] == 30.0 and first["lag_30"] == 1.0
    assert first["rolling_mean_7"] == 27.0 and first["rolling_min_14"] == 17.0 and first["rolling_max_30"] == 30.0
    assert first["rolling_std_7"] == pytest.approx(np.std(range(24, 31), ddof=1))
    assert first["momentum_7_30"] == pytest.approx(27 / (15.5 + 1e-5))
    assert first["sales_diff_1_7"] == 6.0


def test_short_series_has_no_complete_row(spark):
    assert build_features(daily(spark, range(30)), SPEC).count() == 0


def test_today_does_not_leak(spark):
    values = list(np.random.default_rng(3).uniform(0, 100, 80))
    changed = [*values[:50], 9999.0, *values[51:]]
    target = day("2016-01-01") + dt.timedelta(days=50)
    before, after = (
        build_features(daily(spark, v), SPEC).where(F.col("Date") <= F.lit(target)).drop("Sales").orderBy("Date").collect()
        for v in (values, changed)
    )
    assert before == after


def test_other_measures_do_not_pass(spark):
    frame = daily(spark, range(40)).withColumns({"Profit": F.lit(1.0), "Orders": F.lit(2)})
    assert build_features(frame, SPEC).columns == ["Date", "Sales", *SPEC.names]


def test_missing_targets_count_as_zero(spark):
    frame = spark.createDataFrame([(day("2016-01-01"), None), (day("2016-01-02"), float("nan"))], "Date date, Sales double")
    got = build_features(frame, SPEC, drop_incomplete=False).orderBy("Date").collect()
    assert [r["Sales"] for r in got] == [0.0, 0.0] and got[1]["lag_1"] == 0.0


def test_calendar(spark):
    frame = spark.createDataFrame([(day(t),) for t in ("2018-12-31", "2016-02-29", "2017-12-31")], "d date")
    got = [r.asDict() for r in frame.select("d", *[c.alias(n) for n, c in calendar_features(F.col("d")).items()]).collect()]
    for row in got:
        d = row["d"]
        assert row["week_of_year"] == d.isocalendar()[1] and row["day_of_week"] == d.weekday()
        assert row["day_of_year"] == d.timetuple().tm_yday and row["is_weekend"] == int(d.weekday() >= 5)
        assert row["sin_month"] == pytest.approx(math.sin(2 * math.pi * d.month / 12))
        assert row["cos_dow"] == pytest.approx(math.cos(2 * math.pi * d.weekday() / 7))
        assert row["sin_day"] == pytest.approx(math.sin(2 * math.pi * d.day / 31))


def test_split_takes_the_newest_per_series(spark):
    frame = daily(spark, range(50), key="a").unionByName(daily(spark, range(40), key="b"))
    train, test = split_frames(frame, 10, ["Region"])
    assert train.count() == 70 and test.count() == 20
    bounds = train.groupBy("Region").agg(F.max("Date").alias("x")).join(
        test.groupBy("Region").agg(F.min("Date").alias("y")), "Region"
    )
    assert bounds.where("x < y").count() == 2


def test_split_sizes_are_checked(spark):
    frame = daily(spark, range(10))
    with pytest.raises(ValueError):
        chronological_split(frame, 0)
    with pytest.raises(Exception, match="no training rows"):
        chronological_split(frame, 10).collect()


def test_buffer_and_window_forms_agree(spark):
    values = np.random.default_rng(5).uniform(0, 50, 70)
    matrix = build_features(daily(spark, values), SPEC).orderBy("Date").toPandas()
    for i in (30, 45, 69):
        row = matrix.iloc[i - 30]
        known = row[FEATURE_NAMES].to_numpy(dtype=float)[None, :]
        got = buffer_features(SPEC, values[None, i - 30 : i], np.array([30]), known, ddof=1)[0]
        assert got == pytest.approx(row[SPEC.names].to_numpy(dtype=float), rel=1e-9)


@pytest.mark.parametrize("ddof", [0, 1])
def test_features_of_the_next_day_as_columns(spark, ddof):
    """Histories of every kind of length against the plain form, and against the windows."""
    rng = np.random.default_rng(6)
    lengths = [1, 2, 6, 7, 8, 13, 29, 30, 31, 50]
    histories = [rng.uniform(0, 50, n).tolist() for n in lengths]
    rows = spark.createDataFrame([(i, h, day("2016-02-28")) for i, h in enumerate(histories)], "i int, h array<double>, d date")
    columns = next_features(SPEC, F.col("h"), F.col("d"), ddof)
    assert list(columns) == SPEC.names
    got = rows.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
    for row, history in zip(got, histories):
        buffer, known = np.zeros((1, 30)), min(len(history), 30)
        buffer[0, 30 - known :] = history[-known:]
        days = np.array([[row[n] for n in FEATURE_NAMES]])
        assert [row[n] for n in SPEC.names] == pytest.approx(buffer_features(SPEC, buffer, np.array([known]), days, ddof)[0], rel=1e-9)
    if ddof == 1:
        values = histories[-1]
        last = build_features(daily(spark, [*values, 0.0]), SPEC).orderBy(F.desc("Date")).first()
        assert [last[n] for n in SPEC.names[14:]] == pytest.approx([got[-1][n] for n in SPEC.names[14:]], rel=1e-9)


def test_short_buffers_fall_back():
    buffer = np.zeros((2, 30))
    buffer[0, -2:] = [4.0, 8.0]
    buffer[1, -1:] = [5.0]
    got = buffer_features(SPEC, buffer, np.array([2, 1]), np.zeros((2, 14)))
    by_name = {n: got[:, i].tolist() for i, n in enumerate(SPEC.names)}
    assert by_name["lag_1"] == [8.0, 5.0] and by_name["lag_2"] == [4.0, 5.0] and by_name["lag_30"] == [6.0, 5.0]
    assert by_name["rolling_mean_7"] == [6.0, 5.0] and by_name["rolling_std_7"] == [2.0, 0.0]
    assert by_name["rolling_min_30"] == [4.0, 5.0] and by_name["rolling_max_14"] == [8.0, 5.0]


def test_split_parts(spark):
    parts = split_parts(build_features(daily(spark, range(60)), SPEC), SPEC, 10)
    assert [p.count() for p in parts] == [20, 10, 20, 10, 20, 10]
    assert parts.x_test.columns == ["Date", *SPEC.names] and parts.y_test.columns == ["Date", "Sales"]
    assert parts.dates_test.columns == ["Date"]


def test_a_short_series_does_not_stop_the_others(spark):
    both = daily(spark, range(50), key="West").unionByName(daily(spark, range(8), key="East"))
    marked = chronological_split(both, 10, ["Region"])
    counts = {(r["Region"], r["split"]): r["count"] for r in marked.groupBy("Region", "split").count().collect()}
    assert counts == {("West", "train"): 40, ("West", "test"): 10, ("East", "short"): 8}
    assert [tuple(r) for r in short_series(marked, ["Region"]).collect()] == [("East", 8)]
    train, test = split_frames(both, 10, ["Region"])
    assert (train.count(), test.count()) == (40, 10)
