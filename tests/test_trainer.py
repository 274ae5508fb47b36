import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast import session
from shelfcast.operators import metrics, models
from shelfcast.operators.features import FeatureSpec
from shelfcast.operators.forecast import BAND_COLUMNS
from shelfcast.operators.models import ModelSettings
from shelfcast.plans.dashboard import Dashboard
from shelfcast.plans.trainer import ForecastTrainer
from shelfcast.sources import files
from shelfcast.sources.artifacts import load_artifact

from helpers import daily, line, lines

QUICK = ModelSettings(forest_trees=5, forest_depth=5, boosting_rounds=15, boosting_depth=3, boosting_rate=0.3)


def seasonal(n, seed, level=100.0):
    t = np.arange(n)
    return level + 40 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(seed).normal(0, 2, n)


@pytest.fixture(scope="module")
def trained(spark):
    return ForecastTrainer(daily(spark, seasonal(330, 1)), settings=QUICK)


def test_split_sizes(trained):
    train, test = trained.prepare_data()
    assert (train.count(), test.count()) == (330 - 30 - 90, 90)
    assert train.agg(F.max("Date")).first()[0] < test.agg(F.min("Date")).first()[0]


def test_comparison(trained):
    table = trained.train_and_evaluate().collect()
    wape = {r["Model"]: r["WAPE_%"] for r in table}
    assert set(wape) == {metrics.BASELINE, *models.FITTED}
    assert [r["WAPE_%"] for r in table] == sorted(wape.values())
    # every fitted model sees the planted weekly pattern, the moving average does not
    assert all(wape[m] < wape[metrics.BASELINE] / 2 for m in models.FITTED)
    assert trained.best_model_name == table[0]["Model"]


def test_importances_are_sorted_shares(trained):
    for name in (models.FOREST, models.BOOSTING):
        rows = [tuple(r) for r in trained.feature_importance(name, 12).collect()]
        assert len(rows) == 12 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        check = models.importance_check(trained.feature_importance(name, 99), FeatureSpec()).first()
        assert (check["Features"], check["Known"], check["Negative"]) == (36, 36, 0)
        assert check["Total"] == pytest.approx(1.0)


def test_properties_that_trees_must_have(spark, trained):
    train, _ = trained.prepare_data()
    row = models.range_check(trained.predictions_of(models.FOREST), train, "Sales").first()
    assert (row["Test_Days"], row["Outside"]) == (90, 0)
    far = spark.createDataFrame([("m", 1e9), ("m", float("nan")), ("m", None), ("m", 100.0)], "Model string, Predicted double")
    assert models.range_check(far, train, "Sales").first()["Outside"] == 3
    assert models.training_gain(trained.models[models.BOOSTING], "b", train, "Sales").first()["Gained"]


def test_champion_forecast(trained):
    ahead = trained.generate_recursive_forecast(30).orderBy("Date").collect()
    assert len(ahead) == 30 and {r["Model"] for r in ahead} == {trained.best_model_name}
    assert ahead[0]["Date"].isoformat() == "2016-11-26"
    assert all(np.isfinite([r[c] for c in BAND_COLUMNS]).all() for r in ahead)
    other = trained.generate_recursive_forecast(10, metrics.BASELINE).collect()
    assert {r["Model"] for r in other} == {metrics.BASELINE} and len(other) == 10


def test_artifacts(spark, trained, tmp_path):
    places = [str(tmp_path / n) for n in ("model", "forecast", "comparison")]
    trained.save_artifacts(*places, horizon_days=20)
    back = load_artifact(spark, places[0])
    assert back.model_name == trained.best_model_name and back.test_size == 90
    assert back.feature_names == FeatureSpec().names and back.last_training_date == "2016-11-25"
    assert set(back.models) == set(models.FITTED) and set(back.metrics) == {metrics.BASELINE, *models.FITTED}
    assert back.residual_sigma > 0
    _, test = trained.prepare_data()
    for mine, loaded in [
        (trained.refit(back.model_name), back.deployed),
        (trained.models[models.RIDGE], back.models[models.RIDGE]),
    ]:
        a, b = (m.transform(test).select("Date", "prediction").orderBy("Date").collect() for m in (mine, loaded))
        assert a == b
    forecast = files.read_forecast(spark, places[1])
    assert forecast.count() == 20 and forecast.columns == ["Date", *BAND_COLUMNS]
    comparison = files.read_metrics(spark, places[2])
    assert {tuple(r) for r in comparison.collect()} == {tuple(r) for r in trained.train_and_evaluate().collect()}

    board = Dashboard(lines(spark, line(date="2016-11-25", sales=70.0)), forecast=forecast, comparison=comparison)
    assert board.forecast_view(15).count() == 15 and board.actual_and_forecast(15).count() == 106
    assert board.forecast_kpis(15).first()["Projected_Sales"] > 0
    assert board.comparison_table().where("`Best_WAPE_%`").count() == 1
    board.export_forecast(15, str(tmp_path / "export"))
    assert files.read_forecast(spark, str(tmp_path / "export")).count() == 15


def test_missing_files_are_empty(spark, tmp_path):
    nowhere = str(tmp_path / "nowhere")
    assert files.read_forecast(spark, nowhere).count() == 0
    assert files.read_metrics(spark, nowhere).columns[0] == "Model"
    assert load_artifact(spark, nowhere) is None


def test_many_series(spark):
    both = daily(spark, seasonal(200, 2), key="a").unionByName(daily(spark, seasonal(180, 3, 300.0), key="b"))
    pooled = ForecastTrainer(both, ["Region"], test_size=30, candidates=[models.RIDGE])
    assert pooled.predictions.groupBy("Model", "Region").count().where("count = 30").count() == 4
    ahead = pooled.generate_recursive_forecast(14)
    sums = {r["Region"]: r["avg"] for r in ahead.groupBy("Region").agg(F.avg("Forecast_Sales").alias("avg")).collect()}
    assert sums["a"] == pytest.approx(100, rel=0.2) and sums["b"] == pytest.approx(300, rel=0.2)
    assert pooled.residual_sigma(models.RIDGE).count() == 2


def test_forecast_deviation_form_is_a_choice(spark):
    series = daily(spark, seasonal(200, 4))
    one, two = (
        ForecastTrainer(series, test_size=30, candidates=[models.RIDGE], forecast_ddof=d)
        .generate_recursive_forecast(5).orderBy("Step").collect()
        for d in (0, 1)
    )
    assert [r["Forecast_Sales"] for r in one] != [r["Forecast_Sales"] for r in two]


def test_every_model_has_its_own_forecast(trained):
    ahead = trained.forecast_all_models(12)
    assert ahead.groupBy("Model").count().where("count = 12").count() == 4
    own = trained.generate_recursive_forecast(12)
    mine = ahead.where(F.col("Model") == trained.best_model_name)
    assert mine.orderBy("Step").collect() == own.orderBy("Step").collect()


def test_shared_folder_follows_the_session(spark):
    folder = session.shared_folder(spark)
    assert folder == spark.sparkContext.getCheckpointDir()
    settled = session.settle(spark.range(5).withColumnRenamed("id", "a b"))
    assert settled.count() == 5 and all(folder.rsplit("/", 1)[-1] in f for f in settled.inputFiles())
    assert session.settle(spark.range(0)).count() == 0


def test_trees_do_not_depend_on_the_number_of_other_rows(spark):
    """The settings decide where rows go; nothing follows from the size of the table."""
    few, many = (models.ModelSettings(forest_trees=3, boosting_rounds=3, partitions=n) for n in (2, 5))
    for settings in (few, many):
        for rows in (1, 10**9):
            size = models.TrainingSize(rows, 1.0)
            forest = models.estimator(models.FOREST, models.FeatureSpec(), size, settings).getStages()[-1]
            assert forest.getMaxMemoryInMB() == settings.statistics_mb
    assert models.TrainingSize.__dataclass_fields__.keys() == {"rows", "spread"}
