"""What the operators over vectors of whole numbers share: the numbers themselves, and sums of what tasks have summed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components are held to this size, up to which a double names each whole number.
LARGEST = 1 << 53
#: Sums are kept in two halves of so many bits, each of which fits a long for 2**36 rows.
HALF = 26
#: Rows that the driver gets of a sum over all tasks.
SUM_TASKS = 16
LONG_MAX = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, scale: int, *columns: str) -> DataFrame:
    """vec_id, these columns, and x: floor(scale * component) as longs. Rows go whose vector is null or holds null or non-finite components."""
    good = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *columns, F.col("embedding").cast("array<double>").alias("embedding"))
    held = lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * scale)))
    return rows.where(F.col("embedding").isNotNull() & good).select("vec_id", *columns, F.transform("embedding", held).alias("x"))


def spread(rows: DataFrame) -> tuple[int, int, int]:
    """Number of vectors, their greatest length, and the largest absolute component."""
    n, dim, low, high = rows.agg(F.count("x"), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    return n, dim or 0, max(-(low or 0), high or 0, 0)


def matrix(column: pa.Array, dim: int, fill: int = 0) -> np.ndarray:
    """A list column as int64 rows of `dim`, shorter ones filled up."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.full((len(sizes), dim), fill, dtype=np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _added(batches):
    total = None
    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.column(0)[i].values.to_numpy(zero_copy_only=False)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["sums"])


def task_sums(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], kind: str) -> np.ndarray | None:
    """Sum over all rows of what `of` makes of a batch, a flat array of longs or doubles: by tasks, then by a few, then here."""

    def summed(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                total = of(batch) if total is None else total + of(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["sums"])

    schema = f"sums array<{kind}>"
    parts = rows.mapInArrow(summed, schema).repartition(SUM_TASKS).mapInArrow(_added, schema).collect()
    return np.sum([np.array(p.sums, dtype=np.int64 if kind == "long" else np.float64) for p in parts], axis=0) if parts else None


def halves(x: np.ndarray) -> np.ndarray:
    """Low and high half of each number, along a new first axis."""
    return np.stack([x & ((1 << HALF) - 1), x >> HALF])


def joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Exact sums, as Python's integers."""
    return low.astype(object) + high.astype(object) * (1 << HALF)


def held_long(x: np.ndarray) -> np.ndarray:
    """As longs; what a long cannot hold becomes its nearest end."""
    return x if x.dtype != object else np.array([min(max(int(v), -LONG_MAX - 1), LONG_MAX) for v in x], dtype=np.int64)
