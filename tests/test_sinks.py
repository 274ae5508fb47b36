"""Writes that fail half way leave what was there."""

import pytest
from pyspark.sql import functions as F

from shelfcast.sources import files
from shelfcast.sources.artifacts import ForecastArtifact, load_artifact, save_artifact


def broken(frame):
    """Rows of which one cannot be computed."""
    return frame.withColumn("x", F.when(F.col("x") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("x")).cast("int"))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_a_failing_write_leaves_the_old_rows(spark, tmp_path, fmt):
    path = str(tmp_path / "table")
    rows = spark.range(5).select(F.col("id").cast("int").alias("x"))

    def read():
        return sorted(int(r["x"]) for r in spark.read.format(fmt).option("header", True).load(path).collect())

    files.write_table(rows.where("x < 2"), path, fmt)
    assert read() == [0, 1]
    with pytest.raises(Exception, match="no"):
        files.write_table(broken(rows), path, fmt)
    assert read() == [0, 1]
    files.write_table(rows, path, fmt)
    assert read() == [0, 1, 2, 3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_a_failing_write_of_sales_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "sales")
    rows = spark.range(5).select(F.col("id").cast("int").alias("x"), F.lit(2017).alias("Year"))
    files.write_sales_table(rows, path)
    with pytest.raises(Exception, match="no"):
        files.write_sales_table(broken(rows), path)
    assert files.read_sales_table(spark, path).count() == 5


class Unwritable:
    """A model whose save fails."""

    def write(self):
        return self

    def save(self, path):
        raise OSError("disk full")


def artifact(name, **more):
    return ForecastArtifact(name, ["f"], [1], [7], 90, 1.5, {name: {"MAE": 1.0}}, "2017-12-30", **more)


def test_a_failing_save_leaves_the_old_artifact(spark, tmp_path):
    path = str(tmp_path / "model")
    save_artifact(spark, artifact("first"), path)
    assert load_artifact(spark, path).model_name == "first"
    with pytest.raises(OSError):
        save_artifact(spark, artifact("second", models={"a": Unwritable()}), path)
    with pytest.raises(OSError):
        save_artifact(spark, artifact("second", deployed=Unwritable()), path)
    assert load_artifact(spark, path).model_name == "first"
    save_artifact(spark, artifact("third"), path)
    assert load_artifact(spark, path).model_name == "third"
