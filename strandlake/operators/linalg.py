"""Matrices in coordinate form (row, col, x): products, shapes and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "x")


def multiply(a: DataFrame, b: DataFrame, transpose_a: bool = False, transpose_b: bool = False) -> DataFrame:
    """a b: an equi-join on the inner index and a combined sum; zeros are left out of all three."""
    left = (transposed(a) if transpose_a else a).select("row", F.col("col").alias("_k"), F.col("x").alias("_a"))
    right = (transposed(b) if transpose_b else b).select(F.col("row").alias("_k"), "col", F.col("x").alias("_b"))
    return left.join(right, "_k").groupBy("row", "col").agg(F.sum(F.col("_a") * F.col("_b")).alias("x"))


def sparse(a: DataFrame) -> DataFrame:
    return a.filter("x <> 0")


def dense(a: DataFrame, columns: list) -> DataFrame:
    """One row per row, one column per listed column index, zeros filled in."""
    return a.groupBy("row").pivot("col", columns).agg(F.sum("x")).na.fill(0.0)


def mse(a: DataFrame, b: DataFrame, rows: int, cols: int) -> DataFrame:
    """One row: the mean squared difference of two matrices of a shape."""
    both = a.withColumnRenamed("x", "_a").join(b.withColumnRenamed("x", "_b"), ["row", "col"], "full")
    d = F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return both.agg((F.coalesce(F.sum(d * d), F.lit(0.0)) / (rows * cols)).alias("mse"))


def find(a: DataFrame, least: float) -> DataFrame:
    """(row, col) of the cells at or above ``least``; absent cells are zeros, so it has to be positive."""
    if least <= 0:
        raise ValueError("zeros aren't held")
    return a.filter(F.col("x") >= least).select("row", "col")


def select_columns(a: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns listed in (col, new), renumbered."""
    return a.join(columns, "col").select("row", F.col("new").alias("col"), "x")


def sample_columns(a: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` columns chosen by a seeded hash, the same on every run."""
    chosen = a.select("col").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("col").cast("string"))), "col").limit(n)
    return a.join(chosen, "col", "left_semi")


def summed(rows: DataFrame, shape: tuple[int, int], add):
    """The array of ``shape`` to which ``add(out, batch)`` has added every Arrow batch of ``rows``.

    A task adds its batches to one array and sends the rows of it that aren't
    zero; those of one number meet in one task, so the driver gets one each.
    """
    import numpy as np
    import pyarrow as pa

    def sent(i, sums):
        for k in range(0, len(i), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(i[k : k + 1024], pa.int64()), pa.array([x.tobytes() for x in sums[k : k + 1024]], pa.binary())], names=["i", "x"])

    def part(batches):
        out = np.zeros(shape)
        for batch in batches:
            add(out, batch)
        hit = np.flatnonzero(out.any(axis=1))
        yield from sent(hit, out[hit])

    def meet(batches):
        at: dict = {}
        for batch in batches:
            for i, x in zip(batch.column("i").to_pylist(), batch.column("x").to_pylist()):
                x = np.frombuffer(x)
                at[i] = at[i] + x if i in at else x
        yield from sent(list(at), list(at.values()))

    # Every task sends up to a whole array, so there are only as many as run at once.
    parts = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(part, "i long, x binary")
    sums, out = parts.repartition("i").mapInArrow(meet, "i long, x binary").toArrow(), np.zeros(shape)
    for i, x in zip(sums["i"].to_pylist(), sums["x"].to_pylist()):
        out[i] = np.frombuffer(x)
    return out
