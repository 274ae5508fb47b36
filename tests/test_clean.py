import pytest
from pyspark.sql import functions as F

from shelfcast.functions import clean
from shelfcast.plans.processor import SalesProcessor
from shelfcast.sources import files

from helpers import day

HEADER = (
    "Row ID,Order ID,Order Date,Ship Date,Ship Mode,Customer ID,Customer Name,Segment,Country,City,State,"
    "Postal Code,Region,Product ID,Category,Sub-Category,Product Name,Sales,Quantity,Discount,Profit"
)


def row(i, order, date, ship, category, name, sales, quantity, discount, profit, product="P1"):
    return (
        f"{i},{order},{date},{ship},Second Class,C1,Ana,Consumer,US,Henderson,Kentucky,42420,South,"
        f"{product},{category},Chairs,{name},{sales},{quantity},{discount},{profit}"
    )


@pytest.fixture(scope="module")
def sales_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "sales.csv"
    body = [
        row(1, "O1", "11/8/2016", "11/11/2016", "Furniture", '"Café ""Grand"" Table, oak"', "261.96", "2", "0", "41.9"),
        row(2, "O1", "11/8/2016", "11/11/2016", "Furniture", "Chair", "abc", "2.9", "x", ""),
        row(3, "O2", "11/11/2016", "", "NA", "Lamp", '"1,200"', "", "0.1", "NaN"),
        row(4, "O2", "1/1/2017", "1/2/2017", "Tech", "Phone", " 1.5 ", "x", "", "0.5", product="P2"),
        row(5, "O3", "1/1/2017", "1/2/2017", "Tech", "Phone", "-5", "0", "", "2"),
    ]
    path.write_bytes("\n".join([HEADER, *body]).encode("latin-1"))
    return str(path)


def test_numbers(spark):
    cases = {
        "261.96": 261.96, "abc": 9.0, "": 9.0, "NaN": 9.0, "1,200": 9.0, " 1.5 ": 1.5, "0": 0.0,
        "-5": -5.0, "1e3": 1000.0, "1.5d": 9.0, "2f": 9.0, None: 9.0, "nan": 9.0,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    got = frame.select("t", clean.number_or(F.col("t"), 9.0).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == cases
    assert spark.sql("select 'inf' t").select(clean.number_or(F.col("t"), 0.0)).first()[0] == float("inf")


def test_quantities_are_cut(spark):
    cases = {"2": 2, "2.9": 2, "-2.9": -2, "": 1, "x": 1, "0": 0, None: 1}
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    got = frame.select("t", clean.whole_number_or(F.col("t"), 1).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == cases


def test_dates(spark):
    frame = spark.createDataFrame([("2017-12-31",), ("1/2/2018",), ("2016-02-29 10:11:12",), ("2/28/2016 9:05",), (" ",)], "t string")
    got = [r[0] for r in frame.select(clean.parse_date(F.col("t"), "Ship Date", False)).collect()]
    assert got == [day("2017-12-31"), day("2018-01-02"), day("2016-02-29"), day("2016-02-28"), None]


@pytest.mark.parametrize("text,required", [("31/31/2017", False), ("", True), (None, True)])
def test_bad_dates_fail(spark, text, required):
    frame = spark.createDataFrame([(text,)], "t string")
    with pytest.raises(Exception, match="not a date"):
        frame.select(clean.parse_date(F.col("t"), "Order Date", required)).collect()


def test_file_is_cleaned(spark, sales_file):
    rows = {r["Row ID"]: r for r in files.read_sales(spark, sales_file).collect()}
    first, second, third, fourth, fifth = (rows[str(i)] for i in range(1, 6))
    assert first["Product Name"] == 'Café "Grand" Table, oak'
    assert first["Order Date"] == day("2016-11-08") and first["Unit_Price"] == pytest.approx(130.98)
    assert (first["Month_Name"], first["Day_Name"], first["Week"], first["Day_of_Week"]) == ("Nov", "Tue", 45, 1)
    assert (second["Sales"], second["Quantity"], second["Discount"], second["Profit"]) == (0.0, 2, 0.0, 0.0)
    assert second["Profit_Margin"] == 0.0
    assert third["Ship Date"] is None and third["Category"] is None
    assert (third["Sales"], third["Quantity"], third["Profit"]) == (0.0, 1, 0.0)
    assert (fourth["Sales"], fourth["Quantity"]) == (1.5, 1)
    assert (fourth["Is_Weekend"], fourth["Week"], fourth["Quarter"]) == (1, 52, 1)
    # no quantity: the price is the sale itself; no positive sale: the margin is zero
    assert (fifth["Unit_Price"], fifth["Profit_Margin"]) == (-5.0, 0.0)


def test_only_used_columns_are_read(spark, sales_file):
    plan = files.read_sales(spark, sales_file).groupBy("Category").agg(F.sum("Sales"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Category:string,Sales:string>" in text


def test_quality_of_a_file(spark, sales_file):
    processor = SalesProcessor(spark, sales_file)
    report = processor.get_data_quality_report()
    assert report["total_rows"] == 5 and report["total_columns"] == 21 + 11
    assert (report["start_date"], report["end_date"], report["total_days_span"]) == ("2016-11-08", "2017-01-01", 55)
    assert report["missing_values"] == 2  # a ship date and a category
    assert report["duplicate_rows"] == 1
    assert (report["unique_orders"], report["unique_customers"], report["unique_products"]) == (3, 1, 2)
    assert report["categories"] == ["Furniture", "Tech"] and report["regions"] == ["South"]
    assert report["total_sales"] == pytest.approx(258.46)
    assert len(processor.raw_df.columns) == 21
    assert processor.get_category_summary().first()["Category"] == "Furniture"
    assert processor.get_daily_series().count() == 55
    assert processor.get_daily_series(fill_missing_dates=False).count() == 3
    assert processor.get_weekly_series().count() == 8
    assert [r["Sales"] for r in processor.get_monthly_series().collect()] == [pytest.approx(261.96), 0.0, -3.5]
    assert processor.get_region_summary().first()["Sales_Share"] == 100.0


def test_sales_table_is_partitioned_by_year(spark, sales_file, tmp_path):
    files.write_sales_table(files.read_sales(spark, sales_file), str(tmp_path / "t"))
    back = files.read_sales_table(spark, str(tmp_path / "t"))
    assert back.count() == 5
    plan = back.where(F.col("Year") == 2017)
    assert plan.count() == 2
    assert "PartitionFilters: [isnotnull(Year" in plan._jdf.queryExecution().executedPlan().toString()


def test_processor_needs_one_source(spark):
    with pytest.raises(ValueError):
        SalesProcessor(spark)


SHORT_HEADER = "Order ID,Order Date,Ship Date,Category,Product Name,Sales,Quantity,Discount,Profit"


def written(tmp_path, *records):
    path = tmp_path / "sales.csv"
    path.write_bytes("\n".join([SHORT_HEADER, *records]).encode("latin-1") + b"\n")
    return str(path)


def test_quoted_line_breaks(spark, tmp_path):
    path = written(tmp_path, '1,2017-01-02,2017-01-03,Tech,"a\nb",10.0,1,0,1', "2,1/5/2017,2017-01-06,Tech,c,10.0,1,0,1")
    lines = files.read_sales(spark, path, multi_line=True)
    assert lines.groupBy("Category").agg(F.sum("Sales")).collect()[0][1] == 20.0
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_sales(spark, path)


@pytest.mark.parametrize("record", ["3,2017-01-02", "3,2017-01-02,,Tech,x,1,1,0,1,more"])
def test_records_of_another_length_fail(spark, tmp_path, record):
    path = written(tmp_path, "1,2017-01-02,2017-01-03,Tech,a,10.0,1,0,1", record)
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_sales(spark, path)


def test_a_bad_date_fails_before_any_report(spark, tmp_path):
    path = written(tmp_path, "1,notadate,2017-01-03,Tech,a,10.0,1,0,1")
    with pytest.raises(Exception, match="not a date"):
        SalesProcessor(spark, path).get_category_summary()
