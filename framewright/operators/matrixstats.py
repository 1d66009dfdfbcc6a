"""Statistics of maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_entries(maps: DataFrame, keys: Sequence[str] = ("source", "target"), matrix: str = "w") -> DataFrame:
    """(keys, i, j, w) of matrices of rows."""
    rows = maps.select(*keys, F.posexplode(matrix).alias("i", "row"))
    return rows.select(*keys, "i", F.posexplode("row").alias("j", "w"))


def row_norms(entries: DataFrame, keys: Sequence[str] = ("source", "target")) -> DataFrame:
    """(keys, i, norm) of every row."""
    return entries.groupBy(*keys, "i").agg(F.sqrt(F.sum(F.col("w").cast("double") * F.col("w").cast("double"))).alias("norm"))


def mean_row_norms(entries: DataFrame, keys: Sequence[str] = ("source", "target"), least: float | None = None) -> DataFrame:
    """Mean over maps of each row's norm (A15); ``least`` keeps dimensions above it."""
    out = row_norms(entries, keys).groupBy("i").agg(F.avg("norm").alias("mean_norm"))
    return out if least is None else out.filter(F.col("mean_norm") > least)


def mean_absolute(long_bias: DataFrame, pos: str = "pos", value: str = "bias") -> DataFrame:
    """Mean absolute offset of each dimension over maps."""
    return long_bias.groupBy(pos).agg(F.avg(F.abs(value)).alias("mean_abs"))


def sparsity(entries: DataFrame, tolerance: float = 1e-4, keys: Sequence[str] = ("source", "target")) -> DataFrame:
    """Shares and counts of small, large and zero entries of each map.

    An entry at the tolerance is neither small nor large; the share is over the squared width.
    Row and column counts are of the matrix as stored (rows are inputs).
    """
    size = F.abs("w")
    cells = entries.withColumns({"small": (size < tolerance).cast("long"), "large": (size > tolerance).cast("long"), "zero": (F.col("w") == 0).cast("long"), "diagonal": ((F.col("i") == F.col("j")) & (F.col("w") == 0)).cast("long")})
    total = cells.groupBy(*keys).agg(
        F.sum("small").alias("n_small"), F.sum("large").alias("n_large"), F.sum("zero").alias("n_zero"), F.sum("diagonal").alias("n_zero_diagonal"), (F.max("j") + 1).alias("dim")
    )
    total = total.withColumn("small_share", F.col("n_small") / (F.col("dim") * F.col("dim")).cast("double"))
    empty = lambda axis, name: cells.groupBy(*keys, axis).agg(F.sum("large").alias("n")).groupBy(*keys).agg(F.sum((F.col("n") == 0).cast("long")).alias(name))
    return total.join(empty("i", "empty_rows"), list(keys)).join(empty("j", "empty_columns"), list(keys))


def rank_and_determinant(maps: DataFrame, tolerance: float = 1e-4, keys: Sequence[str] = ("source", "target")) -> DataFrame:
    """(keys, rank, low_rank_parameters, determinant) of every matrix."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            found = [np.vstack(w) for w in batch["w"]]
            out["rank"] = [int(np.linalg.matrix_rank(w, tol=tolerance)) for w in found]
            out["low_rank_parameters"] = [int(r) * len(w) * 2 for r, w in zip(out["rank"], found, strict=True)]
            out["determinant"] = [float(np.linalg.det(w)) for w in found]
            yield out

    ddl = ", ".join(f"`{k}` {maps.schema[k].dataType.simpleString()}" for k in keys)
    return maps.select(*keys, "w").filter("w is not null").mapInPandas(run, f"{ddl}, rank long, low_rank_parameters long, determinant double")
