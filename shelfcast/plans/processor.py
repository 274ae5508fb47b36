"""Reports over one sales table: the entry point for users who have a sales file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from shelfcast.operators import measures, quality, series, summary
from shelfcast.sources import files


class SalesProcessor:
    """Lazy views over a sales file or over clean lines that are at hand already.

    Nothing is read before a result is asked for; then the records of a file are checked
    first. ``raw_df`` stays beside ``clean_df``.
    """

    def __init__(
        self,
        spark: SparkSession,
        filepath: str | None = None,
        lines: DataFrame | None = None,
        encoding: str = "ISO-8859-1",
        multi_line: bool = False,
    ):
        if (filepath is None) == (lines is None):
            raise ValueError("give either a file path or a table of lines")
        self.spark = spark
        self.filepath = filepath
        self.encoding = encoding
        self.multi_line = multi_line
        self.raw_df: DataFrame | None = None
        self.clean_df: DataFrame | None = lines

    def load_and_clean_data(self) -> DataFrame:
        if self.clean_df is None:
            self.raw_df = files.read_raw_sales(self.spark, self.filepath, self.encoding, self.multi_line)
            files.check_sales(self.raw_df)
            self.clean_df = files.clean_sales(self.raw_df)
        return self.clean_df

    def _facts(self, *attributes: str) -> DataFrame:
        return measures.order_facts(self.load_and_clean_data(), attributes)

    def get_data_quality_report(self) -> dict:
        return quality.quality_report(self.load_and_clean_data()).first().asDict()

    def get_daily_series(self, fill_missing_dates: bool = True, keys: Sequence[str] = ()) -> DataFrame:
        daily = series.daily_series(self._facts(*keys), keys, fill_missing_dates)
        return daily.orderBy(*keys, "Date")

    def get_weekly_series(self, keys: Sequence[str] = ()) -> DataFrame:
        return series.weekly_series(self._facts(*keys), keys).orderBy(*keys, "Date")

    def get_monthly_series(self, keys: Sequence[str] = ()) -> DataFrame:
        return series.monthly_series(self._facts(*keys), keys).orderBy(*keys, "Date")

    def get_category_summary(self) -> DataFrame:
        return summary.group_summary(self.load_and_clean_data(), "Category")

    def get_region_summary(self) -> DataFrame:
        return summary.group_summary(self.load_and_clean_data(), "Region")
