"""Every query by name, over the star schema in a folder of Parquet tables.

Money is summed exactly. Values that depend on the order of additions (sliding means,
deviations) are rounded here, not in the operators.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions import calendar
from shelfcast.operators import features as ft
from shelfcast.operators import forecast as fc
from shelfcast.operators import measures, metrics, models, quality, ridge, series, stats, summary
from shelfcast.operators.features import FeatureSpec
from shelfcast.operators.filters import Slice
from shelfcast.operators.quantiles import exact_quantiles
from shelfcast.plans.dashboard import Dashboard
from shelfcast.plans.trainer import ForecastTrainer
from shelfcast.session import scratch_path, settle
from shelfcast.sources import files
from shelfcast.sources.artifacts import load_artifact, save_artifact
from shelfcast.sources.star import LINE_MEASURES, SalesStar

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# The slice used by the filtered queries.
CHOSEN = Slice(
    start=dt.date(1996, 3, 1),
    end=dt.date(1998, 2, 28),
    categories=["ECONOMY", "STANDARD", "PROMO"],
    regions=["ASIA", "EUROPE"],
    segments=["BUILDING", "MACHINERY", "HOUSEHOLD"],
)

SPEC = FeatureSpec()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), places) for n in names})


def rounded_means(df: DataFrame, *names: str) -> DataFrame:
    """Means of money, rounded as decimals: a mean that ends in an exact half is one there too."""
    return df.withColumns({n: F.round(F.col(n).cast("decimal(28,10)"), 2).cast("double") for n in names})


def same_day(day):
    return day


# ---- calendar series -------------------------------------------------------------------


@query
def daily_series(spark, root):
    daily = series.daily_series(SalesStar(spark, root).order_facts())
    return daily.orderBy("Date")


@query
def daily_series_no_fill(spark, root):
    daily = series.daily_series(SalesStar(spark, root).order_facts(), fill=False)
    return daily


@query
def daily_series_by_region(spark, root):
    facts = SalesStar(spark, root).customer_facts(["Region"], same_day)
    return series.daily_series(facts, ["Region"])


@query
def daily_series_filtered(spark, root):
    daily = series.daily_series(SalesStar(spark, root).order_facts((), CHOSEN))
    return daily


@query
def weekly_series(spark, root):
    return series.weekly_series(SalesStar(spark, root).order_facts())


@query
def weekly_series_by_segment(spark, root):
    facts = SalesStar(spark, root).customer_facts(["Segment"], calendar.week_end)
    return series.weekly_series(facts, ["Segment"])


@query
def monthly_series(spark, root):
    return series.monthly_series(SalesStar(spark, root).order_facts())


@query
def monthly_series_by_category(spark, root):
    facts = SalesStar(spark, root).part_order_facts(["Category"])
    return series.monthly_series(facts, ["Category"])


def _one_product(spark: SparkSession, root: str) -> DataFrame:
    """The lines of a single product: a series with weeks and months without sales."""
    wanted = ["Order ID", "Customer ID", "Order Date", "Product ID", "Sales", "Quantity", "Profit", "Discount"]
    lines = SalesStar(spark, root).lines(wanted)
    return measures.order_facts(lines.where(F.col("Product ID") == 42))


@query
def weekly_series_one_product(spark, root):
    return series.weekly_series(_one_product(spark, root))


@query
def monthly_series_one_product(spark, root):
    return series.monthly_series(_one_product(spark, root))


@query
def monthly_sales_profit(spark, root):
    facts = SalesStar(spark, root).order_facts((), CHOSEN)
    return series.monthly_totals(facts).select("Date", "Month_Label", "Sales", "Profit")


@query
def monthly_by_year(spark, root):
    return series.by_year(series.monthly_totals(SalesStar(spark, root).order_facts())).drop("Month_Label")


@query
def monthly_of_one_year(spark, root):
    year = Slice(start=dt.date(1997, 1, 1), end=dt.date(1997, 12, 31))
    monthly = series.monthly_totals(SalesStar(spark, root).order_facts((), year), names=["Sales"])
    return series.by_year(monthly, 1997).select("Year", "Month", "Sales")


@query
def year_list(spark, root):
    return series.years(series.monthly_totals(SalesStar(spark, root).order_facts()))


@query
def season_pivot(spark, root):
    return series.season_pivot(series.monthly_totals(SalesStar(spark, root).order_facts()))


@query
def daily_sales_ma(spark, root):
    daily = series.daily_totals(SalesStar(spark, root).order_facts(), names=["Sales", "Profit"])
    return rounded_means(series.moving_averages(daily), "MA_7", "MA_30")


def _newest(spark: SparkSession, root: str, days: int) -> tuple[DataFrame, dt.date | None]:
    """Orders of the last day of sales and the ``days`` before it, and the first of these days that the
    series of all sales has."""
    star = SalesStar(spark, root)
    span = star.sale_days()
    if span is None:
        return star.order_facts().where("false"), None
    first = max(span[0], span[1] - dt.timedelta(days=days))
    return star.order_facts_of_days(first, span[1]), first


@query
def recent_actuals(spark, root):
    return series.recent_daily(_newest(spark, root, series.RECENT_DAYS)[0])


@query
def last_120_days(spark, root):
    facts, first = _newest(spark, root, 119)
    return series.last_days(series.daily_totals(facts, start=F.lit(first)), 120)


# ---- breakdowns ------------------------------------------------------------------------


@query
def category_summary(spark, root):
    facts = SalesStar(spark, root).part_order_facts(["Category"], ())
    return rounded(summary.group_summary(facts, "Category"), 6, "Sales_Share")


@query
def category_summary_null_orders(spark, root):
    """Lines whose order id is missing have their sums, but are no order."""
    wanted = ["Order ID", "Ship Mode", "Category", "Sales", "Profit", "Quantity"]
    lines = SalesStar(spark, root).lines(wanted)
    known = F.when(F.col("Ship Mode") != "1-URGENT", F.col("Order ID"))
    found = summary.group_summary(lines.withColumn("Order ID", known), "Category")
    return rounded(found, 6, "Sales_Share")


@query
def region_summary(spark, root):
    facts = SalesStar(spark, root).customer_facts(["Region"])
    return rounded(summary.group_summary(facts, "Region"), 6, "Sales_Share")


@query
def category_summary_filtered(spark, root):
    lines = SalesStar(spark, root).lines(["Order ID", "Category", *LINE_MEASURES], CHOSEN)
    return summary.group_margin(lines, "Category")


@query
def region_margin(spark, root):
    facts = SalesStar(spark, root).customer_facts(["Region"])
    return summary.group_margin(facts, "Region")


@query
def subcategory_summary(spark, root):
    return summary.subcategory_summary(SalesStar(spark, root).product_facts(["Category", "Sub-Category"]))


@query
def category_tree(spark, root):
    facts = SalesStar(spark, root).product_facts(["Category", "Sub-Category"])
    tree = summary.category_tree(summary.subcategory_summary(facts))
    return rounded(tree, 4, "Sales", "Profit_Weighted")


@query
def top_products_by_name(spark, root):
    facts = SalesStar(spark, root).product_facts(["Product Name", "Category"])
    return summary.top_products(facts)


@query
def top_products_by_id(spark, root):
    facts = SalesStar(spark, root).product_facts(["Product Name", "Category"])
    keys = ["Product ID", "Product Name", "Category"]
    return summary.top_products(facts, keys)


@query
def top_products_filtered(spark, root):
    facts = SalesStar(spark, root).product_facts(["Product Name", "Category"], CHOSEN)
    return summary.top_products(facts)


@query
def order_totals(spark, root):
    return summary.order_totals(SalesStar(spark, root).order_facts(["Segment"]))


@query
def segment_order_value(spark, root):
    orders = summary.order_totals(SalesStar(spark, root).order_facts(["Segment"]))
    return summary.segment_order_value(orders)


@query
def segment_order_box(spark, root):
    orders = summary.order_totals(SalesStar(spark, root).order_facts(["Segment"]))
    return rounded(summary.segment_order_box(orders), 6, "Q1", "Median", "Q3")


@query
def line_value_box(spark, root):
    """Quartiles of line sales by ship mode: groups larger than the sketch holds exactly."""
    lines = SalesStar(spark, root).lines(["Ship Mode", "Sales"])
    boxes = exact_quantiles(settle(lines), ["Ship Mode"], "Sales", {"Q1": 0.25, "Median": 0.5, "Q3": 0.75})
    return rounded(boxes, 6, "Q1", "Median", "Q3")


@query
def dow_sales(spark, root):
    return summary.weekday_sales(SalesStar(spark, root).order_facts())


@query
def dow_sales_one_weekend(spark, root):
    """A slice of two days: the five other weekdays stay null."""
    weekend = Slice(start=dt.date(1997, 5, 24), end=dt.date(1997, 5, 25))
    return summary.weekday_sales(SalesStar(spark, root).order_facts((), weekend))


@query
def kpi_headline(spark, root):
    return summary.headline(SalesStar(spark, root).order_facts())


@query
def kpi_headline_filtered(spark, root):
    return summary.headline(SalesStar(spark, root).order_facts((), CHOSEN))


@query
def best_category(spark, root):
    return summary.best_category(SalesStar(spark, root).product_facts(["Category"]))


@query
def filter_options(spark, root):
    star = SalesStar(spark, root)
    keys = star.line_keys()
    parts = summary.choices(star.sold_parts(["Category"], keys), ["Category"])
    people = summary.choices(star.buyers(["Region", "Segment"], keys), ["Region", "Segment"])
    return parts.unionByName(people).orderBy("Filter", "Value")


# ---- quality and cleaning --------------------------------------------------------------


@query
def quality_report(spark, root):
    report = quality.quality_report(files.derive_columns(SalesStar(spark, root).lines()))
    listed = {n: F.array_join(n, ",") for n in ("categories", "regions")}
    return report.withColumns(listed)


@query
def null_counts(spark, root):
    return quality.null_counts(SalesStar(spark, root).lines())


@query
def columns_with_nulls(spark, root):
    matrix = ft.build_features(_daily_sales(spark, root), SPEC, drop_incomplete=False)
    return quality.columns_with_nulls(matrix)


@query
def duplicate_lines(spark, root):
    return quality.duplicate_lines(SalesStar(spark, root).lines(["Order ID", "Product ID"]))


@query
def date_bounds(spark, root):
    return quality.date_bounds(SalesStar(spark, root).order_facts())


def _as_text(lines: DataFrame) -> DataFrame:
    """Sales lines as a raw file holds them, with flaws that depend on the ship mode."""
    mode = F.col("Ship Mode")
    text = {c: F.col(f"`{c}`").cast("string") for c in lines.columns}
    text["Quantity"] = (
        F.when(mode == "1-URGENT", F.concat(text["Quantity"], F.lit(".9")))
        .when(mode == "2-HIGH", F.lit("x"))
        .when(mode == "3-MEDIUM", F.lit("0"))
        .otherwise(text["Quantity"])
    )
    text["Sales"] = (
        F.when(mode == "2-HIGH", F.lit("1,200"))
        .when(mode == "5-LOW", F.concat(F.lit(" "), text["Sales"], F.lit(" ")))
        .otherwise(text["Sales"])
    )
    text["Discount"] = F.when(mode == "4-NOT SPECIFIED", F.lit("NaN")).otherwise(text["Discount"])
    text["Profit"] = F.when(mode == "5-LOW", F.lit("")).otherwise(text["Profit"])
    return lines.select(*[c.alias(n) for n, c in text.items()])


@query
def line_cleaning(spark, root):
    wanted = [
        "Order ID", "Product ID", "Order Date", "Ship Date", "Ship Mode", "Sales", "Quantity", "Discount", "Profit",
    ]
    raw = _as_text(SalesStar(spark, root).lines(wanted))
    return files.clean_sales(raw, calendar_columns=False)


@query
def line_calendar(spark, root):
    lines = SalesStar(spark, root).lines(["Order ID", "Product ID", "Order Date"])
    return lines.withColumns(calendar.line_calendar(F.col("Order Date")))


@query
def preview_lines(spark, root):
    lines = SalesStar(spark, root).lines(["Order Date", "Order ID", "Product ID", "Sales", "Quantity"])
    first = files.preview(lines, 5, ["Order Date", "Order ID", "Product ID", "Sales", "Quantity"])
    return first.withColumn("Sales", F.col("Sales").cast("double"))


@query
def table_shape(spark, root):
    star = SalesStar(spark, root)
    # Lookups keep the number of lines, and the columns are known without them.
    rows = star.lines(["Order ID"]).agg(F.count(F.lit(1)).alias("Rows"))
    return rows.select("Rows", F.lit(len(star.lines().columns)).alias("Columns"))


@query
def sales_file_summary(spark, root):
    """Write the lines as a Latin-1 text file, read that back, and summarise it."""
    path = scratch_path(spark, "sales")
    wanted = ["Order ID", "Order Date", "Ship Date", "Category", "Sales", "Quantity", "Discount", "Profit"]
    lines = SalesStar(spark, root).lines(wanted)
    text = lines.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in wanted])
    text.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    found = summary.group_margin(files.read_sales(spark, path), "Category")
    return rounded(found, 4, "Sales", "Profit", "Profit_Margin")


@query
def sales_file_quoted(spark, root):
    """A text file with line breaks inside quoted names, and two forms of dates."""
    path = scratch_path(spark, "sales")
    wanted = ["Order ID", "Order Date", "Ship Date", "Product Name", "Category", "Sales", "Quantity", "Discount", "Profit"]
    lines = SalesStar(spark, root).lines(wanted)
    text = {c: F.col(f"`{c}`").cast("string") for c in wanted}
    text["Product Name"] = F.concat(text["Product Name"], F.lit('\n"large", '), text["Category"])
    text["Order Date"] = F.when(F.col("Quantity") > 25, F.date_format("Order Date", "M/d/yyyy")).otherwise(text["Order Date"])
    text = lines.select(*[c.alias(n) for n, c in text.items()])
    text.write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    found = summary.group_margin(files.read_sales(spark, path, multi_line=True), "Category")
    return rounded(found, 4, "Sales", "Profit", "Profit_Margin")


# ---- features --------------------------------------------------------------------------


def _daily_sales(spark: SparkSession, root: str) -> DataFrame:
    return series.daily_totals(SalesStar(spark, root).order_facts())


def _matrix(spark: SparkSession, root: str, whole: bool = True) -> DataFrame:
    return ft.build_features(_daily_sales(spark, root), SPEC, drop_incomplete=whole)


def _rounded_rolling(df: DataFrame) -> DataFrame:
    """Minima and maxima are values of the series and stay as they are."""
    means = [n for n in df.columns if n.startswith("rolling_mean")]
    deviations = [n for n in df.columns if n.startswith("rolling_std")]
    return rounded(rounded_means(df, *means), 2, *deviations)


ROLLING = [n for n in SPEC.names if n.startswith("rolling_")]
LAGS = [n for n in SPEC.names if n.startswith("lag_")]
CYCLES = [n for n in SPEC.names if n.startswith(("sin_", "cos_"))]


@query
def lag_features(spark, root):
    return _matrix(spark, root, False).select("Date", "Sales", *LAGS)


@query
def rolling_features(spark, root):
    return _rounded_rolling(_matrix(spark, root, False).select("Date", *ROLLING))


@query
def cyclical_features(spark, root):
    return rounded(_matrix(spark, root, False).select("Date", *CYCLES), 9, *CYCLES)


@query
def feature_matrix(spark, root):
    matrix = _rounded_rolling(rounded(_matrix(spark, root), 4, "sales_diff_1_7"))
    return rounded(rounded(matrix, 6, "momentum_7_30"), 9, *CYCLES)


@query
def feature_matrix_by_region(spark, root):
    daily = series.daily_totals(SalesStar(spark, root).customer_facts(["Region"], same_day), ["Region"])
    matrix = ft.build_features(daily, SPEC, ["Region"])
    picked = matrix.select("Region", "Date", "Sales", "lag_7", "lag_30", "rolling_mean_7", "rolling_std_30")
    return _rounded_rolling(picked)


@query
def chrono_split(spark, root):
    return ft.chronological_split(_matrix(spark, root), 90).select("Date", "Sales", "split")


@query
def split_dates(spark, root):
    """First day, last day and size of both sides of the split."""
    parts = ft.split_parts(_matrix(spark, root), SPEC, 90)
    sides = parts.y_train.withColumn("split", F.lit("train")).unionByName(
        parts.y_test.withColumn("split", F.lit("test"))
    )
    return sides.groupBy("split").agg(
        F.min("Date").alias("First_Date"), F.max("Date").alias("Last_Date"), F.count("Sales").alias("Rows")
    )


# ---- baseline and metrics --------------------------------------------------------------


def _test_rows(spark: SparkSession, root: str) -> DataFrame:
    return ft.split_frames(_matrix(spark, root), 90)[1]


@query
def baseline_metrics(spark, root):
    return metrics.evaluate(models.baseline_predictions(_test_rows(spark, root), SPEC))


@query
def baseline_metrics_4(spark, root):
    return metrics.evaluate_basic(models.baseline_predictions(_test_rows(spark, root), SPEC))


@query
def model_metrics(spark, root):
    """Ranking and best flags over several ready-made predictions: the baseline, last week's
    day, and the monthly mean."""
    wide = _test_rows(spark, root).select("Date", "Sales", "rolling_mean_7", "lag_7", "rolling_mean_30")
    named = wide.withColumnsRenamed(
        {"Sales": "Actual", "rolling_mean_7": metrics.BASELINE, "lag_7": "Last Week", "rolling_mean_30": "30-Day MA"}
    )
    long = named.unpivot(["Date", "Actual"], [metrics.BASELINE, "Last Week", "30-Day MA"], "Model", "Predicted")
    return metrics.rank_models(metrics.mark_best(metrics.evaluate(long)))


@query
def residual_sigma(spark, root):
    predictions = models.baseline_predictions(_test_rows(spark, root), SPEC)
    return rounded(metrics.residual_sigma(predictions), 2, "Sigma")


# ---- series statistics -----------------------------------------------------------------


def _monthly_sales(spark: SparkSession, root: str) -> DataFrame:
    return series.monthly_totals(SalesStar(spark, root).order_facts(), names=["Sales"])


@query
def decomposition(spark, root):
    parts = stats.decompose(_monthly_sales(spark, root))
    return rounded(parts, 2, "Trend", "Seasonal", "Residual")


@query
def decomposition_by_region(spark, root):
    facts = SalesStar(spark, root).customer_facts(["Region"], calendar.month_start)
    parts = stats.decompose(series.monthly_totals(facts, ["Region"], ["Sales"]), ["Region"])
    return rounded(parts, 2, "Trend", "Seasonal", "Residual")


ADF_NUMBERS = ("Statistic", "P_Value", *stats.CRITICAL)


@query
def adf_test(spark, root):
    return rounded(stats.adf_test(_monthly_sales(spark, root)), 6, *ADF_NUMBERS)


@query
def adf_test_by_region(spark, root):
    facts = SalesStar(spark, root).customer_facts(["Region"], calendar.month_start)
    found = stats.adf_test(series.monthly_totals(facts, ["Region"], ["Sales"]), ["Region"])
    return rounded(found, 6, *ADF_NUMBERS)


# ---- forecasts without fitted models ---------------------------------------------------


def _baseline_forecast(
    spark: SparkSession, root: str, keys: Sequence[str] = (), horizon: int = fc.HORIZON
) -> DataFrame:
    star = SalesStar(spark, root)
    facts = star.customer_facts(keys, same_day) if keys else star.order_facts()
    daily = series.daily_totals(facts, keys)
    state = fc.series_state(daily, SPEC, keys)
    return fc.recursive_forecast(state, fc.baseline_scorer(SPEC), metrics.BASELINE, SPEC, keys, horizon)


def _baseline_bands(spark: SparkSession, root: str) -> DataFrame:
    predictions = models.baseline_predictions(_test_rows(spark, root), SPEC)
    return fc.with_bands(_baseline_forecast(spark, root), metrics.residual_sigma(predictions))


@query
def future_calendar(spark, root):
    daily = _daily_sales(spark, root)
    ahead = daily.agg(F.max("Date").alias("Last_Date")).select(
        F.explode(fc.future_days(F.col("Last_Date"), fc.HORIZON)).alias("Date")
    )
    return rounded(ahead.withColumns(calendar.calendar_features(F.col("Date"))), 9, *CYCLES)


@query
def next_day_features_by_region(spark, root):
    daily = series.daily_totals(SalesStar(spark, root).customer_facts(["Region"], same_day), ["Region"])
    seen = fc.next_day_features(fc.series_state(daily, SPEC, ["Region"]), SPEC, ["Region"])
    return _rounded_rolling(seen.select("Region", "Date", *LAGS, *ROLLING))


@query
def recursive_forecast_baseline(spark, root):
    return rounded(_baseline_forecast(spark, root), 2, "Predicted")


@query
def recursive_forecast_baseline_by_region(spark, root):
    return rounded(_baseline_forecast(spark, root, ["Region"]), 2, "Predicted")


@query
def forecast_bands(spark, root):
    return _baseline_bands(spark, root)


@query
def forecast_first_30_days(spark, root):
    return fc.first_days(_baseline_bands(spark, root), 30).select("Date", *fc.BAND_COLUMNS)


@query
def forecast_kpis(spark, root):
    kpis = fc.forecast_kpis(fc.first_days(_baseline_bands(spark, root), 60))
    return rounded(kpis, 2, *kpis.columns)


@query
def forecast_span(spark, root):
    return rounded(fc.forecast_span(_baseline_bands(spark, root)), 2, "Total_Sales")


@query
def history_plus_forecast(spark, root):
    recent = series.recent_daily(_newest(spark, root, series.RECENT_DAYS)[0])
    return fc.history_plus_forecast(recent, _baseline_bands(spark, root))


@query
def forecast_file(spark, root):
    """Write the forecast as a result file and read it back."""
    path = scratch_path(spark, "forecast")
    files.write_table(_baseline_bands(spark, root).select("Date", *fc.BAND_COLUMNS).orderBy("Date"), path)
    return files.read_forecast(spark, path)


@query
def forecast_export(spark, root):
    """The first 30 days as the dashboard exports them, read back."""
    ahead = _baseline_bands(spark, root).select("Date", *fc.BAND_COLUMNS)
    board = Dashboard(SalesStar(spark, root).lines(["Order Date"]), forecast=ahead)
    path = scratch_path(spark, "export")
    board.export_forecast(30, path)
    return files.read_forecast(spark, path)


@query
def metrics_file(spark, root):
    """Write the metrics as a result file and read them back."""
    path = scratch_path(spark, "metrics")
    files.write_table(baseline_metrics(spark, root), path)
    return files.read_metrics(spark, path)


# ---- fitted models ---------------------------------------------------------------------


def trainer(spark: SparkSession, root: str, *candidates: str) -> ForecastTrainer:
    """A trainer of the named candidates, or of all. Each query fits what it reports."""
    return ForecastTrainer(_daily_sales(spark, root), candidates=candidates or models.FITTED)


@query
def ridge_forecast(spark, root):
    """Ridge alone: fit, recursive forecast, bands."""
    alone = ForecastTrainer(_daily_sales(spark, root), candidates=[models.RIDGE])
    return alone.generate_recursive_forecast(fc.HORIZON, models.RIDGE)


@query
def ridge_forecast_by_region(spark, root):
    return _by_region(spark, root).generate_recursive_forecast(fc.HORIZON, models.RIDGE)


@query
def ridge_refit(spark, root):
    """Weights of the model of training and test rows together, from the sums of both."""
    alone = ForecastTrainer(_daily_sales(spark, root), candidates=[models.RIDGE])
    return rounded(ridge.coefficients(alone.ridge_model(), SPEC), 3, "Weight")


def _by_region(spark: SparkSession, root: str) -> ForecastTrainer:
    daily = series.daily_totals(SalesStar(spark, root).customer_facts(["Region"], same_day), ["Region"])
    return ForecastTrainer(daily, ["Region"], candidates=[models.RIDGE])


@query
def ridge_coefficients_by_region(spark, root):
    """A ridge model of each region's own, on its training rows."""
    own = _by_region(spark, root).ridge_model(["train"], ["Region"])
    return rounded(ridge.coefficients(own, SPEC, ["Region"]), 3, "Weight")


@query
def ridge_own_forecast_by_region(spark, root):
    """Each region forecast by its own model."""
    return _by_region(spark, root).ridge_by_series()


@query
def saved_model_metrics(spark, root):
    """Train ridge, save everything, load it back, and score the loaded model."""
    alone = ForecastTrainer(_daily_sales(spark, root), candidates=[models.RIDGE])
    path = scratch_path(spark, "artifact")
    save_artifact(spark, alone.artifact(), path)
    loaded = load_artifact(spark, path)
    _, test = alone.prepare_data()
    return metrics.evaluate(models.predict(loaded.models, test, SPEC))


@query
def saved_model_facts(spark, root):
    """What a saved artifact says of its model, read back."""
    path = scratch_path(spark, "artifact")
    save_artifact(spark, trainer(spark, root, models.RIDGE).artifact(), path)
    loaded = load_artifact(spark, path)
    lags, windows = (",".join(map(str, x)) for x in (loaded.lags, loaded.windows))
    row = (loaded.model_name, lags, windows, loaded.test_size, loaded.last_training_date)
    return spark.createDataFrame([row], "Model string, Lags string, Windows string, Test_Size int, Last_Date string")


def _metrics_of(name: str, spark: SparkSession, root: str) -> DataFrame:
    return metrics.evaluate(trainer(spark, root, name).predictions_of(name))


@query
def ridge_metrics(spark, root):
    return _metrics_of(models.RIDGE, spark, root)


@query
def ridge_against_baseline(spark, root):
    """The comparison table of two models."""
    return trainer(spark, root, models.RIDGE).train_and_evaluate()


@query
def champion_of_two(spark, root):
    """The baseline does not compete, so ridge wins over it whatever their errors."""
    return metrics.champion(metrics.evaluate(trainer(spark, root, models.RIDGE).predictions))


@query
def forest_metrics(spark, root):
    return _metrics_of(models.FOREST, spark, root)


@query
def boost_metrics(spark, root):
    return _metrics_of(models.BOOSTING, spark, root)


@query
def model_comparison(spark, root):
    return trainer(spark, root).train_and_evaluate()


@query
def champion(spark, root):
    return metrics.champion(metrics.evaluate(trainer(spark, root).predictions))


@query
def champion_forecast(spark, root):
    return trainer(spark, root).generate_recursive_forecast()


@query
def feature_importance(spark, root):
    return trainer(spark, root).feature_importance()


@query
def forest_range(spark, root):
    """A forest's predictions stay inside the range of what it was trained on."""
    alone = trainer(spark, root, models.FOREST)
    train, _ = alone.prepare_data()
    return models.range_check(alone.predictions_of(models.FOREST), train, SPEC.target)


@query
def boost_gain(spark, root):
    """Boosting explains some of the training days' spread."""
    alone = trainer(spark, root, models.BOOSTING)
    train, _ = alone.prepare_data()
    fitted = alone.fitted(models.BOOSTING)[models.BOOSTING]
    return rounded(models.training_gain(fitted, models.BOOSTING, train, SPEC.target), 2, "Spread")


@query
def importance_totals(spark, root):
    """The importances of all features of a forest are shares of one whole."""
    alone = trainer(spark, root, models.FOREST)
    shares = alone.feature_importance(models.FOREST, len(SPEC.names))
    return rounded(models.importance_check(shares, SPEC), 6, "Total")
