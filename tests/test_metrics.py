import numpy as np
import pytest

from shelfcast.operators import metrics

from helpers import day

SCHEMA = "Model string, Date date, Actual double, Predicted double"

# A published comparison of four models.
PUBLISHED = [
    ("XGBoost Regressor", 1953.24, 2827.49, 0.1141, 63.45, 375.23),
    ("Random Forest", 2033.11, 2886.71, 0.0766, 66.04, 468.34),
    ("Ridge Regression", 2052.61, 2911.41, 0.0607, 66.67, 533.89),
    ("Baseline (7-Day MA)", 2537.62, 3307.36, -0.2121, 82.43, 983.8),
]


def predictions(spark, *groups):
    rows = [(m, day("2017-01-01"), float(a), float(p)) for m, pairs in groups for a, p in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def test_values(spark):
    pairs = [(10, 12), (0, -5), (20, 15), (0, 3), (7, 7)]
    got = metrics.evaluate(predictions(spark, ("m", pairs)), rounded=False).first()
    y, p = np.array(pairs, dtype=float).T
    e = y - np.maximum(p, 0)
    assert got["MAE"] == pytest.approx(np.abs(e).mean())
    assert got["RMSE"] == pytest.approx(np.sqrt((e**2).mean()))
    assert got["R2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["WAPE_%"] == pytest.approx(np.abs(e).sum() / (y.sum() + 1e-8) * 100)
    assert got["MAPE_%"] == pytest.approx(np.abs(e[y > 0] / y[y > 0]).mean() * 100)
    basic = metrics.evaluate_basic(predictions(spark, ("m", pairs)), rounded=False).first()
    assert basic["WAPE_%"] == pytest.approx(np.abs(e).sum() / y.sum() * 100) and len(basic) == 5


def test_no_positive_actuals(spark):
    frame = predictions(spark, ("m", [(0, 0), (0, 2)]))
    got = metrics.evaluate(frame).first()
    assert got["MAPE_%"] == 0.0 and got["R2"] == 0.0 and got["WAPE_%"] > 1e9
    assert metrics.evaluate_basic(frame).first()["WAPE_%"] is None
    assert metrics.evaluate(predictions(spark, ("m", [(3, 3), (3, 3)]))).first()["R2"] == 1.0


def test_ranking_of_published_figures(spark):
    table = spark.createDataFrame(PUBLISHED, "Model string, MAE double, RMSE double, R2 double, `WAPE_%` double, `MAPE_%` double")
    assert [r["Model"] for r in metrics.rank_models(table).collect()] == [r[0] for r in PUBLISHED]
    assert metrics.champion(table).first()["Model"] == "XGBoost Regressor"
    best = {r["Model"]: r for r in metrics.mark_best(table).collect()}
    flags = ["Best_MAE", "Best_RMSE", "Best_WAPE_%", "Best_R2"]
    assert all(best["XGBoost Regressor"][f] for f in flags)
    assert not any(best[m][f] for m in best if m != "XGBoost Regressor" for f in flags)


def test_baseline_cannot_win(spark):
    frame = predictions(spark, (metrics.BASELINE, [(1, 1), (2, 2)]), ("other", [(1, 2), (2, 3)]))
    assert metrics.champion(metrics.evaluate(frame)).first()["Model"] == "other"


def test_sigma_drops_the_mean_error(spark):
    frame = predictions(spark, ("m", [(10, 5), (10, 3), (10, -4)]))
    residuals = np.array([5.0, 7.0, 10.0])
    assert metrics.residual_sigma(frame).first()["Sigma"] == pytest.approx(residuals.std())
    raw = metrics.residual_sigma(frame, clipped=False).first()["Sigma"]
    assert raw == pytest.approx(np.array([5.0, 7.0, 14.0]).std())
