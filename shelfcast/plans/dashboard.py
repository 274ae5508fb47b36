"""The tables behind a sales dashboard, for one slice of the sales lines.

Historical tables follow the slice. The forecast and the recent actuals next to it cover
all data, whatever the slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import forecast as fc
from shelfcast.operators import measures, metrics, quality, series, summary
from shelfcast.operators.filters import ALL, Slice, apply_slice
from shelfcast.sources import files


class Dashboard:
    def __init__(
        self,
        lines: DataFrame,
        chosen: Slice = ALL,
        forecast: DataFrame | None = None,
        comparison: DataFrame | None = None,
    ):
        self.all_lines = lines
        self.lines = apply_slice(lines, chosen)
        self.forecast = forecast
        self.comparison = comparison

    def is_empty(self) -> bool:
        return self.lines.isEmpty()

    def options(self) -> DataFrame:
        return summary.filter_options(self.all_lines)

    def date_bounds(self) -> DataFrame:
        return quality.date_bounds(self.all_lines)

    def headline(self) -> DataFrame:
        return summary.headline(measures.order_facts(self.lines))

    def best_category(self) -> DataFrame:
        return summary.best_category(self.lines)

    def daily_trend(self) -> DataFrame:
        return series.moving_averages(series.daily_totals(self.lines)).orderBy("Date")

    def monthly_trend(self) -> DataFrame:
        return series.monthly_totals(self.lines).orderBy("Date")

    def weekdays(self) -> DataFrame:
        return summary.weekday_sales(self.lines)

    def categories(self) -> DataFrame:
        return summary.group_margin(self.lines, "Category")

    def category_tree(self) -> DataFrame:
        return summary.category_tree(summary.subcategory_summary(self.lines))

    def top_products(self, n: int = 10) -> DataFrame:
        return summary.top_products(self.lines, n=n)

    def recent_actuals(self) -> DataFrame:
        return series.recent_daily(self.all_lines).orderBy("Date")

    def forecast_view(self, horizon: int, model: str | None = None) -> DataFrame:
        ahead = self.forecast
        if model is not None and "Model" in ahead.columns:
            ahead = ahead.where(F.col("Model") == model)
        return fc.first_days(ahead, horizon).orderBy("Date")

    def forecast_kpis(self, horizon: int, model: str | None = None) -> DataFrame:
        return fc.forecast_kpis(self.forecast_view(horizon, model))

    def actual_and_forecast(self, horizon: int, model: str | None = None) -> DataFrame:
        return fc.history_plus_forecast(self.recent_actuals(), self.forecast_view(horizon, model))

    def export_forecast(self, horizon: int, path: str, model: str | None = None) -> None:
        files.write_table(self.forecast_view(horizon, model), path)

    def comparison_table(self) -> DataFrame:
        return metrics.mark_best(self.comparison).orderBy("WAPE_%", "Model")
