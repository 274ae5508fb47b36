"""CSV and Parquet files: the raw sales table in, result tables in and out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions import calendar, clean
from shelfcast.sources.columns import FORECAST_SCHEMA, METRICS_SCHEMA


def read_raw_sales(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1", multi_line: bool = False
) -> DataFrame:
    """The sales file with every column as text, under the names of its header.

    Files with more columns than the queries use are fine; those columns are not parsed.
    All files of a folder must have the same header. Quoted fields with line breaks need
    ``multi_line``, which reads each file in one task.
    """
    return (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def check_sales(raw: DataFrame, date_formats: Sequence[str] = clean.DATE_FORMATS) -> None:
    """Fail now if a record has more or fewer fields than the header (a quoted line break read
    without ``multi_line`` among them), or an order date is missing or no date.

    Reports read few columns and would not notice. One pass over all columns.
    """
    day = clean.parse_date(F.col("`Order Date`"), "Order Date", True, date_formats)
    every = [F.count(F.col(f"`{name}`")) for name in raw.columns]
    raw.agg(F.max(day), *every).collect()


def clean_sales(
    raw: DataFrame, date_formats: Sequence[str] = clean.DATE_FORMATS, calendar_columns: bool = True
) -> DataFrame:
    """Typed sales lines: parsed dates, coerced numbers, derived price, margin and calendar.

    Columns without a rule keep their text; missing-value tokens in them become null.
    """
    rules = {
        "Order Date": lambda c: clean.parse_date(c, "Order Date", True, date_formats),
        "Ship Date": lambda c: clean.parse_date(c, "Ship Date", False, date_formats),
        "Sales": lambda c: clean.number_or(c, 0.0),
        "Discount": lambda c: clean.number_or(c, 0.0),
        "Profit": lambda c: clean.number_or(c, 0.0),
        "Quantity": lambda c: clean.whole_number_or(c, 1),
    }
    typed = raw.select(
        *[rules.get(name, clean.text_or_null)(F.col(f"`{name}`")).alias(name) for name in raw.columns]
    )
    return derive_columns(typed, calendar_columns)


def derive_columns(typed: DataFrame, calendar_columns: bool = True) -> DataFrame:
    """Add unit price, line margin and the nine calendar columns to typed sales lines."""
    sales, quantity, profit = (F.col(c).cast("double") for c in ["Sales", "Quantity", "Profit"])
    extra = {
        "Unit_Price": clean.unit_price(sales, quantity),
        "Profit_Margin": clean.line_margin(sales, profit),
    }
    if calendar_columns:
        extra.update(calendar.line_calendar(F.col("Order Date")))
    return typed.withColumns(extra)


def read_sales(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1", multi_line: bool = False
) -> DataFrame:
    """Clean lines of a file whose records and order dates have been checked."""
    raw = read_raw_sales(spark, path, encoding, multi_line)
    check_sales(raw)
    return clean_sales(raw)


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside ``path``, then put the result in its place by renaming folders.

    A write that fails leaves what was there. A crash between the two renames leaves both the old
    folder and the new one complete beside the place, under their own names.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    staged, former = place.suffix(f".staged-{mark}"), place.suffix(f".former-{mark}")
    try:
        write(staged.toString())
    except BaseException:
        store.delete(staged, True)
        raise
    had = store.exists(place)
    if had and not store.rename(place, former):
        raise OSError(f"cannot move {place.toString()} aside")
    if not store.rename(staged, place):
        raise OSError(f"cannot move {staged.toString()} to {place.toString()}")
    if had:
        store.delete(former, True)


def write_sales_table(lines: DataFrame, path: str) -> None:
    """Keep clean lines as Parquet, one folder per year, so date filters prune folders.

    Rows are brought together by year, and a large year is split into files of even size.
    """
    rows = lines.hint("rebalance", "Year")
    replaced(lines.sparkSession, path, lambda staged: rows.write.partitionBy("Year").parquet(staged))


def read_sales_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result in place of an older one, which stays until the new one is whole."""
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    replaced(df.sparkSession, path, lambda staged: writer.format(fmt).save(staged))


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """A written forecast; an empty table of the same columns if there is none."""
    return _read_or_empty(spark, path, FORECAST_SCHEMA)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A written model comparison; an empty table of the same columns if there is none."""
    return _read_or_empty(spark, path, METRICS_SCHEMA)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def preview(df: DataFrame, rows: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """The first rows, by ``order`` where the caller needs a fixed choice."""
    return (df.orderBy(*order) if order else df).limit(rows)
