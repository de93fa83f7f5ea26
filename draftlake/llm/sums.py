"""Arrays of fixed size, added up over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SUM_ROWS = 512  # rows of the array that travel together
SUM_SCHEMA = "part int, data binary"


def sum_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's array, cut in parts; parts of zeros are left out."""
    for k in range(0, len(total), SUM_ROWS):
        if total[k : k + SUM_ROWS].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // SUM_ROWS], pa.int32()), pa.array([total[k : k + SUM_ROWS].tobytes()], pa.binary())], names=["part", "data"])


def summed(sums: DataFrame, shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """The sum of the tasks' arrays; each part is added up by itself, and the parts are joined here."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype) for batch in table.to_batches() for x in batch.column("data").to_pylist())
        return pa.table({"part": pa.array(table.column("part").to_pylist()[:1], pa.int32()), "data": pa.array([np.asarray(total, dtype).tobytes()], pa.binary())})

    out = np.zeros(shape, dtype)
    for r in sums.groupBy("part").applyInArrow(add, SUM_SCHEMA).collect():
        out[r["part"] * SUM_ROWS : (r["part"] + 1) * SUM_ROWS] = np.frombuffer(r["data"], dtype).reshape(-1, *shape[1:])
    return out
