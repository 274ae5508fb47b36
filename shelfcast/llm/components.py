"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import discard, settle

# Rows for each partition of a round, which hold two numbers each.
PART_ROWS = 1 << 18


def _gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as so many rows fill: small rounds are not dealt to many tasks."""
    parts = max(1, math.ceil(rows / PART_ROWS))
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _extent(links: DataFrame, rows: int) -> tuple[int, int]:
    """How many links there are, and how many of their nodes keep them from being stars: those
    linked to two smaller nodes, or to a smaller and a larger one."""
    up, down = F.lit(1).alias("up"), F.lit(0).alias("down")
    ends = links.select(F.col("u").alias("node"), up, down).union(links.select("v", down, up))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return _gathered(nodes, 2 * rows).agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 0 and up + down > 1"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node that has a link; a component is named by its smallest node.

    ``links`` has two long columns, ``a`` and ``b``. Alternates two steps until the links are stars:
    every node's larger neighbours are linked to its smallest neighbour, then every node and its
    smaller neighbours are. Both keep the components and flatten them to stars in a few rounds. A
    hub is only ever reduced by a partial minimum and a join that can be split.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows, loose = _extent(edges, edges.count())
    while loose:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _gathered(both.groupBy("u").agg(F.min("v").alias("m")), 2 * rows).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(_gathered(large, rows))
        least = _gathered(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        joined = large.join(least, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        small = settle(_gathered(small, 2 * rows))
        discard(large, edges)
        edges = small
        rows, loose = _extent(edges, 2 * rows)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.union(edges.select(F.col("u").alias("node"), F.col("v").alias("component")))
