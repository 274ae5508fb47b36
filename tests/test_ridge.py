"""Ridge from mergeable sums, against the closed form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import forecast as fc
from shelfcast.operators import models, ridge
from shelfcast.operators.features import FeatureSpec, build_features
from shelfcast.plans.trainer import OWN_RIDGE, ForecastTrainer

from helpers import daily

SPEC = FeatureSpec()


def seasonal(n, seed, level=100.0):
    t = np.arange(n)
    return level + 40 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(seed).normal(0, 2, n)


def closed_form(table, alpha=10.0):
    x, y = table[SPEC.names].to_numpy(dtype=float), table["Sales"].to_numpy()
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1.0
    z = (x - mean) / spread
    weights = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / spread
    return y.mean() - weights @ mean, weights


@pytest.fixture(scope="module")
def two(spark):
    return daily(spark, seasonal(200, 2), key="a").unionByName(daily(spark, seasonal(180, 3, 3000.0), key="b"))


def test_merged_sums_are_the_sums_of_all():
    x = np.random.default_rng(0).normal(1e6, 1, (50, 4))
    whole = ridge.sums_of(x)
    n, mean, products = ridge.merge(ridge.merge(ridge.sums_of(x[:1]), ridge.sums_of(x[1:30])), ridge.sums_of(x[30:]))
    assert n == 50
    np.testing.assert_allclose(mean, whole[1], rtol=1e-14)
    np.testing.assert_allclose(products, whole[2], rtol=1e-6, atol=1e-7)


def test_models_of_splits_and_of_all(spark, two):
    trained = ForecastTrainer(two, ["Region"], test_size=30, candidates=[models.RIDGE])
    table = trained.feat_df.toPandas()
    for splits in ((), ("train",)):
        for by in ((), ("Region",)):
            rows = {tuple(r[k] for k in by): r for r in trained.ridge_model(splits, by).collect()}
            for key in [()] if not by else [("a",), ("b",)]:
                own = table[table["split"].isin(splits)] if splits else table
                own = own[own["Region"] == key[0]] if key else own
                intercept, weights = closed_form(own)
                np.testing.assert_allclose(rows[key]["Weights"], weights, rtol=1e-6, atol=1e-8)
                assert rows[key]["Intercept"] == pytest.approx(intercept, rel=1e-6)
            assert len(rows) == (2 if by else 1)


def test_refit_is_that_of_spark(spark, two):
    trained = ForecastTrainer(two.where("Region = 'a'").drop("Region"), test_size=30, candidates=[models.RIDGE])
    fitted = trained.refit(models.RIDGE).stages[-1]
    row = trained.ridge_model().first()
    np.testing.assert_allclose(row["Weights"], fitted.coefficients.toArray(), rtol=1e-6, atol=1e-8)
    assert row["Intercept"] == pytest.approx(fitted.intercept, rel=1e-6)


def test_null_keys_odd_names_and_constant_columns(spark):
    frame = daily(spark, seasonal(60, 5), key=None).withColumn("a b", F.when(F.dayofmonth("Date") > 15, F.lit("x")))
    matrix = build_features(frame.select("Date", "Sales", "a b"), SPEC).join(frame.select("Date", "a b"), "Date")
    rows = ridge.moments(matrix, SPEC, ["a b"]).collect()
    assert {r["a b"]: r["n"] for r in rows} == {None: matrix.where("`a b` is null").count(), "x": matrix.where("`a b` = 'x'").count()}
    flat = build_features(daily(spark, [5.0] * 40), SPEC)
    model = ridge.ridge(ridge.moments(flat, SPEC), 10.0).first()
    assert model["Intercept"] == pytest.approx(5.0) and np.abs(model["Weights"]).max() < 1e-12
    assert ridge.ridge(ridge.moments(flat.where("false"), SPEC), 10.0).count() == 0


def test_each_series_has_its_own_model(spark, two):
    trained = ForecastTrainer(two, ["Region"], test_size=30, candidates=[models.RIDGE])
    ahead = trained.ridge_by_series(5).collect()
    assert {(r["Region"], r["Step"]) for r in ahead} == {(k, s) for k in "ab" for s in range(1, 6)} and {r["Model"] for r in ahead} == {OWN_RIDGE}
    own = {r["Region"]: r for r in trained.ridge_model(by=["Region"]).collect()}
    for key in "ab":
        alone = two.where(F.col("Region") == key).drop("Region")
        scorer = {"kind": "linear", "weights": own[key]["Weights"], "intercept": own[key]["Intercept"]}
        path = fc.recursive_forecast(fc.series_state(alone, SPEC), scorer, "m", SPEC, horizon=5).collect()
        got = {r["Step"]: r["Forecast_Sales"] for r in ahead if r["Region"] == key}
        assert all(abs(got[r["Step"]] - r["Predicted"]) <= 0.0051 for r in path)
    assert all(r["Lower_95"] < r["Forecast_Sales"] < r["Upper_95"] for r in ahead)
    plan = trained.ridge_by_series(5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan.split("MapInArrow")[0]


def test_rows_of_coefficients(spark, two):
    trained = ForecastTrainer(two, ["Region"], test_size=30)
    table = ridge.coefficients(trained.ridge_model(by=["Region"]), SPEC, ["Region"])
    assert table.columns == ["Region", "Feature", "Weight"]
    assert table.groupBy("Region").count().where("count = 37").count() == 2
