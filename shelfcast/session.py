"""Session settings and the reliable cut of a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for. All are runtime settings of Spark SQL, so a session
# handed in by someone else works too; nothing below is needed for right results.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "shelfcast",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above.

    How many shuffle partitions an input needs is for the cluster to say, in
    ``spark.sql.shuffle.partitions``; adaptive execution merges those that turn out small.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may go without that setting: it gets a folder of its own.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir()
    if named:
        return named
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        # local-cluster has executors of its own, which need not share a folder with the driver.
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfcast-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Deletes the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def deleted_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files: for tables that are written and not computed again."""
    before = spark.conf.get(DELETE_SHUFFLES, None)
    spark.conf.set(DELETE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DELETE_SHUFFLES)
        else:
            spark.conf.set(DELETE_SHUFFLES, before)


def settle(df: DataFrame) -> DataFrame:
    """Write the result of a plan to the shared folder once and read it from there on.

    Used where a small result of a long plan (a daily series) is read many times, as
    model fitting does. The table outlives any executor, and readers still prune columns
    and push filters. What the plan shuffled is deleted with the write.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    with deleted_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` or a write to ``scratch_path`` made, once nothing will read them again.

    Only folders right inside the shared folder are deleted; frames that read anything else are passed over.
    """
    for table in tables:
        spark = table.sparkSession
        shared = re.sub("^file:/*", "/", shared_folder(spark))
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if re.sub("^file:/*", "/", folder).rsplit("/", 1)[0] == shared:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
