"""Adding up tables of counts of a fixed size over all tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SALTS = 256
SCHEMA = "part int, salt int, counts binary"


def parts(table: np.ndarray, size: int) -> pa.RecordBatch:
    """A task's table of whole numbers, cut into parts of ``size``; parts of zeros are left out."""
    rows = table.astype(np.int64).reshape(-1, size)
    filled = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(filled, pa.int32()),
            "salt": pa.array([TaskContext.get().partitionId() % SALTS] * len(filled), pa.int32()),
            "counts": pa.array([rows[p].tobytes() for p in filled], pa.binary()),
        }
    )


def _add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in rows.column("counts").to_pylist())
    return pa.table({"part": rows.column("part")[:1], "salt": rows.column("salt")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def add_up(rows: DataFrame, shape: tuple[int, ...], size: int) -> np.ndarray:
    """The sum of all tasks' tables.

    First by salts, so that a group holds its share of the tasks only. The result has the
    fixed size of one table, whatever the input.
    """
    sums = rows.groupBy("part", "salt").applyInArrow(_add, SCHEMA).groupBy("part").applyInArrow(_add, SCHEMA)
    table = np.zeros(int(np.prod(shape)), np.int64).reshape(-1, size)
    for row in sums.collect():
        table[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return table.reshape(shape)
