"""Written tables that are no longer needed."""

import os

from shelfcast.session import DELETE_SHUFFLES, discard, settle


def test_discard_deletes_settled_tables_alone(spark, tmp_path):
    gone, stays = settle(spark.range(5)), settle(spark.range(7))
    spark.range(3).write.parquet(str(tmp_path / "given"))
    given = spark.read.parquet(str(tmp_path / "given"))
    files = gone.inputFiles()
    discard(gone, given)
    assert stays.count() == 7 and given.count() == 3
    fs = spark._jvm.org.apache.hadoop.fs
    assert not any(fs.Path(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(f)) for f in files)
    discard(settle(spark.range(0)))


def test_settled_tables_leave_no_shuffle_files(spark):
    """Neither those of the write stay, nor does the setting."""
    before = spark.conf.get(DELETE_SHUFFLES)
    places = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for p in places for d, _, names in os.walk(p) for f in names if f.startswith("shuffle_")}
    known = shuffles()
    table = settle(spark.range(1000).repartition(3, "id"))
    assert not shuffles() - known
    assert table.count() == 1000
    assert spark.conf.get(DELETE_SHUFFLES) == before
