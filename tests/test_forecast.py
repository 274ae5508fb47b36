import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import forecast as fc
from shelfcast.operators import models
from shelfcast.operators.features import FeatureSpec, build_features
from shelfcast.operators.models import ModelSettings

from helpers import daily, day

SPEC = FeatureSpec()
QUICK = ModelSettings(forest_trees=4, forest_depth=4, boosting_rounds=5, boosting_depth=3)

# Published forecast rows (step, forecast, lower and upper 80, upper 95) and sigma.
PUBLISHED_SIGMA = 2781.011
PUBLISHED = [
    (1, 2933.12, 0.0, 6519.42, 0.0, 8424.63),
    (2, 3038.83, 0.0, 6651.52, 0.0, 8570.77),
    (8, 3968.04, 200.82, 7735.27, 0.0, 9736.61),
    (15, 2370.8, 0.0, 6310.65, 0.0, 8403.71),
    (29, 2520.67, 0.0, 6784.88, 0.0, 9050.24),
]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    t = np.arange(400)
    values = 100 + 30 * np.sin(2 * np.pi * t / 7) + 0.1 * t + rng.normal(0, 3, 400)
    return daily(spark, values).cache()


@pytest.fixture(scope="module")
def matrix(series):
    return build_features(series, SPEC).cache()


@pytest.fixture(scope="module")
def fitted(matrix):
    return models.fit(matrix, spec=SPEC, settings=QUICK)


def test_ridge_is_the_closed_form(spark, matrix, fitted):
    table = matrix.toPandas()
    x, y = table[SPEC.names].to_numpy(dtype=float), table["Sales"].to_numpy()
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1.0
    z = (x - mean) / spread
    beta = np.linalg.solve(z.T @ z + 10 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    expected = y.mean() + z @ beta
    got = fitted[models.RIDGE].transform(matrix).orderBy("Date").toPandas()["prediction"]
    ordered = table.sort_values("Date").index
    np.testing.assert_allclose(got, expected[ordered], rtol=1e-8)


def test_scorer_equals_transform(spark, matrix, fitted):
    scored = fitted[models.RIDGE].transform(matrix).toPandas()
    value = fc.score(fc.scorer_of(fitted[models.RIDGE]), {n: F.col(n) for n in SPEC.names})
    got = spark.createDataFrame(scored[["Date", *SPEC.names]]).select("Date", value.alias("v")).orderBy("Date").toPandas()["v"]
    scored = scored.sort_values("Date")
    np.testing.assert_allclose(got, scored["prediction"], rtol=1e-10)


def test_forecasts_of_linear_models_run_without_python(spark, series):
    state = fc.series_state(series, SPEC)
    for scorer in (fc.baseline_scorer(SPEC), {"kind": "linear", "weights": [0.1] * 36, "intercept": 1.0}):
        plan = fc.recursive_forecast(state, scorer, "m", SPEC)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def step_by_step(spark, series, model, horizon):
    """Append one predicted day at a time and rebuild the window features of the whole series."""
    days = [tuple(r) for r in series.orderBy("Date").collect()]
    for _ in range(horizon):
        tomorrow = days[-1][0] + dt.timedelta(days=1)
        longer = spark.createDataFrame([*days, (tomorrow, 0.0)], "Date date, Sales double")
        seen = build_features(longer, SPEC).where(F.col("Date") == F.lit(tomorrow))
        days.append((tomorrow, max(0.0, model.transform(seen).first()["prediction"])))
    return days[-horizon:]


@pytest.mark.parametrize("name", models.FITTED)
def test_walk_equals_step_by_step(spark, monkeypatch, series, fitted, name):
    monkeypatch.setattr(fc, "STEPS_PER_CUT", 4)
    state = fc.series_state(series, SPEC)
    got = fc.recursive_forecast(state, fc.scorer_of(fitted[name]), name, SPEC, horizon=6, ddof=1)
    got = [(r["Date"], r["Predicted"]) for r in got.orderBy("Step").collect()]
    expected = step_by_step(spark, series, fitted[name], 6)
    assert [d for d, _ in got] == [d for d, _ in expected]
    np.testing.assert_allclose([v for _, v in got], [v for _, v in expected], rtol=1e-9)


def test_baseline_walk_of_a_short_series(spark):
    got = fc.recursive_forecast(
        fc.series_state(daily(spark, [4.0, 8.0]), SPEC), fc.baseline_scorer(SPEC), "b", SPEC, horizon=3
    )
    assert [r["Predicted"] for r in got.orderBy("Step").collect()] == pytest.approx([6.0, 6.0, 6.0])


def test_series_do_not_mix(spark):
    both = daily(spark, [1.0] * 40, key="a").unionByName(daily(spark, [9.0] * 50, start="2017-05-01", key="b"))
    state = fc.series_state(both, SPEC, ["Region"])
    got = fc.recursive_forecast(state, fc.baseline_scorer(SPEC), "b", SPEC, ["Region"], horizon=5)
    rows = got.groupBy("Region").agg(F.min("Predicted"), F.max("Predicted"), F.min("Date"), F.count("*")).collect()
    assert {tuple(r) for r in rows} == {("a", 1.0, 1.0, day("2016-02-10"), 5), ("b", 9.0, 9.0, day("2017-06-20"), 5)}


def test_predictions_are_never_negative(spark):
    state = fc.series_state(daily(spark, [1.0] * 40), SPEC)
    falling = {"kind": "linear", "weights": np.zeros(36), "intercept": -5.0}
    got = fc.recursive_forecast(state, falling, "m", SPEC, horizon=4)
    assert {r["Predicted"] for r in got.collect()} == {0.0}


def test_no_history_gives_no_forecast(spark):
    empty = daily(spark, [1.0]).where("false")
    assert fc.series_state(empty, SPEC).count() == 0


def test_bands_match_published_rows(spark):
    rows = [("m", step, day("2017-12-30") + dt.timedelta(days=step), value) for step, value, *_ in PUBLISHED]
    path = spark.createDataFrame(rows, "Model string, Step int, Date date, Predicted double")
    sigma = spark.createDataFrame([("m", PUBLISHED_SIGMA)], "Model string, Sigma double")
    got = fc.with_bands(path, sigma).orderBy("Step").collect()
    for row, expected in zip(got, PUBLISHED):
        actual = [row[c] for c in fc.BAND_COLUMNS]
        assert actual == pytest.approx(expected[1:], abs=0.015)


def test_bands_are_nested_and_widen(spark):
    path = spark.range(1, 91).select(
        F.lit("m").alias("Model"), F.col("id").cast("int").alias("Step"),
        F.date_add(F.lit(day("2018-01-01")), F.col("id").cast("int")).alias("Date"), F.lit(50.0).alias("Predicted"),
    )
    sigma = spark.createDataFrame([("m", 10.0)], "Model string, Sigma double")
    banded = fc.with_bands(path, sigma)
    bad = "not (0 <= Lower_95 and Lower_95 <= Lower_80 and Lower_80 <= Forecast_Sales " \
          "and Forecast_Sales <= Upper_80 and Upper_80 <= Upper_95)"
    assert banded.where(bad).count() == 0
    widths = [r["Upper_95"] - r["Forecast_Sales"] for r in banded.orderBy("Step").collect()]
    assert widths == sorted(widths) and widths[0] < widths[-1]


def test_kpis_of_nothing_are_zero(spark):
    empty = spark.createDataFrame([], "Date date, Forecast_Sales double, Upper_95 double, Lower_95 double")
    assert tuple(fc.forecast_kpis(empty).first()) == (0.0, 0.0, 0.0, 0.0)


def test_first_days_with_and_without_steps(spark):
    plain = daily(spark, range(9)).withColumnRenamed("Sales", "Forecast_Sales")
    assert fc.first_days(plain, 4).agg(F.sum("Forecast_Sales")).first()[0] == 6.0
    keyed = daily(spark, range(5), key="a").unionByName(daily(spark, range(5), key="b"))
    assert fc.first_days(keyed, 2, ["Region"]).count() == 4


def test_importances_are_the_top_shares(spark, fitted):
    got = models.feature_importance(fitted[models.BOOSTING], SPEC, spark, top=5).collect()
    shares = [r["Importance"] for r in got]
    assert len(got) == 5 and shares == sorted(shares, reverse=True) and 0 < sum(shares) <= 1 + 1e-9
    assert {r["Feature"] for r in got} <= set(SPEC.names)


def test_fit_needs_rows(matrix):
    with pytest.raises(ValueError, match="no training rows"):
        models.fit(matrix.where("false"), [models.RIDGE], SPEC)
    with pytest.raises(ValueError, match="unknown model"):
        models.fit(matrix, ["other"], SPEC)
