"""From sales lines to a forecast: features, split, candidates, champion, bands."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict
from functools import cached_property, reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.clean import not_negative
from shelfcast.operators import features, forecast, metrics, models, ridge
from shelfcast.operators.features import FeatureSpec
from shelfcast.operators.metrics import BASELINE
from shelfcast.operators.models import BOOSTING, FITTED, RIDGE, ModelSettings
from shelfcast.session import settle
from shelfcast.sources import files
from shelfcast.sources.artifacts import ForecastArtifact, save_artifact

OWN_RIDGE = "Ridge by Series"


class ForecastTrainer:
    """Trains on a continuous daily series (one, or one per key) and forecasts it.

    Every step is computed when first asked for and kept. The daily series and the
    feature matrix are written to the shared folder once, because training reads them
    many times; they are as small as the calendar times the number of series.

    Accuracy figures are one step ahead: test rows know the actual days before them.
    """

    def __init__(
        self,
        daily: DataFrame,
        keys: Sequence[str] = (),
        test_size: int = features.TEST_DAYS,
        spec: FeatureSpec = FeatureSpec(),
        settings: ModelSettings = ModelSettings(),
        candidates: Sequence[str] = FITTED,
        forecast_ddof: int = 0,
    ):
        self.keys = list(keys)
        self.test_size = test_size
        self.spec = spec
        self.settings = settings
        self.candidates = list(candidates)
        self.forecast_ddof = forecast_ddof
        self._daily = daily
        self.spark = daily.sparkSession
        self._fitted: dict[str, PipelineModel] = {}
        self._refits: dict[str, PipelineModel] = {}

    @cached_property
    def daily_df(self) -> DataFrame:
        return settle(self._daily.select(*self.keys, self.spec.date, self.spec.target))

    @cached_property
    def feat_df(self) -> DataFrame:
        """The feature matrix with its ``split`` column."""
        matrix = features.build_features(self.daily_df, self.spec, self.keys)
        return settle(features.chronological_split(matrix, self.test_size, self.keys, self.spec.date))

    def prepare_data(self) -> tuple[DataFrame, DataFrame]:
        marked = self.feat_df
        return tuple(marked.where(F.col("split") == side) for side in ("train", "test"))

    def fitted(self, *names: str) -> dict[str, PipelineModel]:
        """The named candidates, fitted on training rows only; new ones are fitted together."""
        missing = [n for n in names if n not in self._fitted]
        if missing:
            train, _ = self.prepare_data()
            self._fitted.update(models.fit(train, missing, self.spec, self.settings, self.keys))
        return {n: self._fitted[n] for n in names}

    @property
    def models(self) -> dict[str, PipelineModel]:
        return self.fitted(*self.candidates)

    def predictions_of(self, *names: str) -> DataFrame:
        """Test days of the named models; the baseline is one of them."""
        _, test = self.prepare_data()
        found = self.fitted(*[n for n in names if n != BASELINE])
        return models.predict(found, test, self.spec, self.keys, BASELINE in names)

    @cached_property
    def predictions(self) -> DataFrame:
        """Test days of all candidates, and of the baseline if its window is among the features."""
        baseline = [BASELINE] if "rolling_mean_7" in self.spec.names else []
        return settle(self.predictions_of(*baseline, *self.candidates))

    def train_and_evaluate(self) -> DataFrame:
        """The comparison table, best first."""
        return metrics.rank_models(metrics.evaluate(self.predictions))

    @cached_property
    def best_model_name(self) -> str:
        return metrics.champion(metrics.evaluate(self.predictions)).first()["Model"]

    def residual_sigma(self, *names: str) -> DataFrame:
        """Per model, and per series where there are several; of all models if none is named."""
        predictions = self.predictions_of(*names) if names else self.predictions
        return metrics.residual_sigma(predictions, ["Model", *self.keys])

    def refit(self, name: str) -> PipelineModel:
        """The named candidate on training and test rows together."""
        if name not in self._refits:
            self._refits.update(models.fit(self.feat_df, [name], self.spec, self.settings, self.keys))
        return self._refits[name]

    @cached_property
    def ridge_sums(self) -> DataFrame:
        """What ridge needs of the rows of each split and series; read once, merged as needed."""
        return settle(ridge.moments(self.feat_df, self.spec, [*self.keys, "split"]))

    def ridge_model(self, splits: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
        """Intercept and weights on the rows of the named splits, or of all: one model, or one for
        each value of ``by``, which are keys of the series."""
        sums = self.ridge_sums
        chosen = sums.where(F.col("split").isin(*splits)) if splits else sums
        return ridge.ridge(ridge.merged(chosen, by), self.settings.ridge_alpha, by)

    def ridge_by_series(self, horizon_days: int = forecast.HORIZON) -> DataFrame:
        """Forecast with bands from a ridge model of each series' own.

        The spread is that of the model of its training rows on its test rows. A series that is too
        short to be split has a forecast without bands.
        """
        own = self.ridge_model(by=self.keys)
        state = forecast.series_state(self.daily_df, self.spec, self.keys).join(own, self.keys)
        path = forecast.recursive_forecast(
            state, forecast.own_scorer(), OWN_RIDGE, self.spec, self.keys, horizon_days, self.forecast_ddof
        )
        _, test = self.prepare_data()
        seen = test.join(self.ridge_model(["train"], self.keys), self.keys)
        value = forecast.score(forecast.own_scorer(), {n: F.col(n) for n in self.spec.names})
        predictions = seen.select(
            F.lit(OWN_RIDGE).alias("Model"), *self.keys, F.col(self.spec.target).alias("Actual"), not_negative(value).alias("Predicted")
        )
        return forecast.with_bands(path, metrics.residual_sigma(predictions, ["Model", *self.keys]), self.keys)

    def _scorer(self, name: str) -> forecast.Scorer | PipelineModel:
        if name == BASELINE:
            return forecast.baseline_scorer(self.spec)
        if name == RIDGE:
            return forecast.linear_scorer(self.ridge_model())
        return self.refit(name)

    def generate_recursive_forecast(
        self, horizon_days: int = forecast.HORIZON, model: str | None = None
    ) -> DataFrame:
        """Daily forecast with bands: by the champion, or by the model asked for."""
        name = model or self.best_model_name
        state = forecast.series_state(self.daily_df, self.spec, self.keys)
        path = forecast.recursive_forecast(
            state, self._scorer(name), name, self.spec, self.keys, horizon_days, self.forecast_ddof
        )
        return forecast.with_bands(path, self.residual_sigma(name), self.keys)

    def forecast_all_models(self, horizon_days: int = forecast.HORIZON) -> DataFrame:
        """The forecast of the baseline and of every candidate; pick one by ``Model``."""
        trees = [n for n in self.candidates if n != RIDGE]
        if trees:
            self._refits.update(models.fit(self.feat_df, trees, self.spec, self.settings, self.keys))
        names = [BASELINE, *self.candidates] if "rolling_mean_7" in self.spec.names else self.candidates
        parts = [self.generate_recursive_forecast(horizon_days, name) for name in names]
        return reduce(DataFrame.unionByName, parts)

    def feature_importance(self, model: str = BOOSTING, top: int = 12) -> DataFrame:
        return models.feature_importance(self.fitted(model)[model], self.spec, self.spark, top)

    def artifact(self) -> ForecastArtifact:
        name = self.best_model_name
        scores = [row.asDict() for row in metrics.evaluate(self.predictions).collect()]
        overall = metrics.residual_sigma(self.predictions).where(F.col("Model") == name).first()
        last = self.daily_df.agg(F.max(self.spec.date).cast("string").alias("d")).first()["d"]
        return ForecastArtifact(
            model_name=name,
            feature_names=self.spec.names,
            lags=list(self.spec.lags),
            windows=list(self.spec.windows),
            test_size=self.test_size,
            residual_sigma=overall["Sigma"],
            metrics={s.pop("Model"): s for s in scores},
            last_training_date=last,
            settings=asdict(self.settings),
            models=self.models,
            deployed=self.refit(name),
        )

    def save_artifacts(
        self, model_path: str, forecast_path: str, comparison_path: str, horizon_days: int = forecast.HORIZON
    ) -> None:
        """Write the comparison, the champion's forecast and the models."""
        files.write_table(self.train_and_evaluate(), comparison_path)
        ahead = self.generate_recursive_forecast(horizon_days)
        columns = [*self.keys, "Date", *forecast.BAND_COLUMNS]
        files.write_table(ahead.select(*columns).orderBy(*self.keys, "Date"), forecast_path)
        save_artifact(self.spark, self.artifact(), model_path)
