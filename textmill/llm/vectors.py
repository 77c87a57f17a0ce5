"""What the operators on dense vectors share: which rows count, and their numbers as arrays inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def usual_length(rows: DataFrame, vector: str) -> int:
    """The commonest number of entries (of equally common ones the larger), 0 for an empty table: one row comes to the driver."""
    sizes = rows.select(F.size(F.col(vector)).alias("d")).where("d > 0").groupBy("d").count()
    found = sizes.agg(F.max(F.struct("count", "d")).alias("most")).first().most
    return found.d if found else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column, all of ``dims`` entries, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
