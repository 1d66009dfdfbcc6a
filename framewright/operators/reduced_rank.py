"""Reduced-rank ridge maps of every rank from one decomposition a pair (M8)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import FIELDS, MAP, Moments

SPECTRUM = "alpha double, beta array<array<double>>, v array<array<double>>, squares array<double>, mean_x array<double>, mean_y array<double>"
ESTIMATE = "rank int, vr array<array<double>>, vrt_times_beta array<array<double>>, rank_ int, " + MAP


def decomposed(m: Moments, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge map, right singular vectors (columns, largest value first) of its fit of the augmented rows, and squares of the values."""
    heavier = m.g + alpha * np.eye(len(m.g))
    beta = np.linalg.solve(heavier, m.c)
    squares, v = np.linalg.eigh(beta.T @ heavier @ beta)
    v = v[:, ::-1]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return beta, v * np.where(sign == 0, 1, sign), np.maximum(squares[::-1], 0)


def reduced_rank_ridge(m: Moments, alpha: float = 1e4, rank: int = 1) -> tuple[np.ndarray, None]:
    """The map of one rank."""
    beta, v, _ = decomposed(m, alpha)
    return beta @ v[:, :rank] @ v[:, :rank].T, None


def ridge_spectra(moments: DataFrame, alphas: Sequence[float], bias: bool = True, keys: Sequence[str] = ("source", "target")) -> DataFrame:
    """(keys, alpha, beta, v, squares, means): what maps of all ranks are read from, a row a pair and alpha."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                m = Moments.of(row)
                means = [(m.sx / m.n).tolist()], [(m.sy / m.n).tolist()]
                for alpha in alphas:
                    beta, v, squares = decomposed(m.centred() if bias else m, alpha)
                    yield pd.DataFrame({**{k: [row[k]] for k in keys}, "alpha": float(alpha), "beta": [beta.tolist()], "v": [v.tolist()], "squares": [squares.tolist()], "mean_x": means[0] if bias else None, "mean_y": means[1] if bias else None})

    ddl = ", ".join(f"`{k}` {moments.schema[k].dataType.simpleString()}" for k in keys)
    return moments.select(*keys, *FIELDS).mapInPandas(run, f"{ddl}, {SPECTRUM}")


def at_ranks(spectra: DataFrame, ranks: Sequence[int], keys: Sequence[str] = ("source", "target")) -> DataFrame:
    """(keys, alpha, rank, vr, vrt_times_beta, rank_, w, bias) for each rank, without fitting anew.

    ``vr`` holds the leading right singular vectors in columns, ``vrt_times_beta`` = vr' beta' has
    a row for each of them, ``rank_`` is the numerical rank of w, and bias is zero where the fit has none.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                beta, v = np.vstack(row["beta"]), np.vstack(row["v"])
                top = v[:, : row["rank"]]
                w = beta @ top @ top.T
                bias = np.zeros(w.shape[1]) if row["mean_x"] is None else np.asarray(row["mean_y"]) - np.asarray(row["mean_x"]) @ w
                yield pd.DataFrame({**{k: [row[k]] for k in keys}, "alpha": row["alpha"], "rank": row["rank"], "vr": [top.tolist()], "vrt_times_beta": [(beta @ top).T.tolist()], "rank_": int(np.linalg.matrix_rank(w)), "w": [w.tolist()], "bias": [bias.tolist()]})

    wanted = spectra.withColumn("rank", F.explode(F.array(*[F.lit(int(k)) for k in ranks])))
    ddl = ", ".join(f"`{k}` {spectra.schema[k].dataType.simpleString()}" for k in keys)
    return wanted.select(*keys, "alpha", "beta", "v", "mean_x", "mean_y", "rank").mapInPandas(run, f"{ddl}, alpha double, {ESTIMATE}")
