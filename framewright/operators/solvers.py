"""Estimators of linear maps from moments (M1-M10). Row convention: y = x W + b."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lasso import lasso
from .moments import FIELDS, MAP, Fit, Moments, with_bias
from .reduced_rank import reduced_rank_ridge


def least_squares(m: Moments, rcond: float = 1e-10) -> Fit:
    """M1: minimum-norm solution; eigenvalues of G under ``rcond`` of the largest count as zero.

    Those are singular values of X under 1e-5 of the largest; ``fit_factors`` keeps all down to
    the rounding of the rows themselves.
    """
    return np.linalg.pinv(m.g, rcond=rcond, hermitian=True) @ m.c, None


def orthogonal(m: Moments) -> Fit:
    """M3: the orthogonal matrix nearest in the sense of Procrustes."""
    u, _, vt = np.linalg.svd(m.c)
    return u @ vt, None


def ridge(m: Moments, alpha: float = 1e4) -> Fit:
    """M7: ||Y - XW||^2 + alpha ||W||^2."""
    return np.linalg.solve(m.g + alpha * np.eye(len(m.g)), m.c), None


def additive(m: Moments) -> Fit:
    """M9: the difference of the matched means."""
    return None, (m.sy - m.sx) / m.n


METHODS: dict[str, Callable[..., Fit]] = {
    "least_squares": least_squares,
    "least_squares_bias": with_bias(least_squares),
    "orthogonal": orthogonal,
    "orthogonal_bias": with_bias(orthogonal),
    "lasso": lasso,
    "lasso_bias": with_bias(lasso),
    "ridge": ridge,
    "reduced_rank_ridge": reduced_rank_ridge,
    "reduced_rank_ridge_bias": with_bias(reduced_rank_ridge),
    "additive": additive,
}


def fit_maps(moments: DataFrame, method: str, keys: Sequence[str] = ("source", "target"), **options) -> DataFrame:
    """(keys, w, bias) of every pair; either may be null. One small solve a row."""
    keys, fit = list(keys), METHODS[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [fit(Moments.of(row), **options) for row in batch.to_dict("records")]
            out = batch[keys].copy()
            out["w"] = [None if w is None else w.tolist() for w, _ in found]
            out["bias"] = [None if b is None else b.tolist() for _, b in found]
            yield out

    ddl = ", ".join(f"`{k}` {moments.schema[k].dataType.simpleString()}" for k in keys)
    return moments.select(*keys, *FIELDS).mapInPandas(run, f"{ddl}, {MAP}")


def fit_factors(factors: DataFrame, bias: bool = False, keys: Sequence[str] = ("source", "target")) -> DataFrame:
    """(keys, w, bias): M1, or M2 with ``bias``, from ``moments.pair_factors``: least squares on the factor's rows.

    Singular values count down to machine precision times the larger side of the rows, as if they were solved directly.
    """
    keys = list(keys)

    def solve(row: dict) -> Fit:
        d, r = int(row["width"]), np.asarray(row["r"], float).reshape(-1, int(row["columns"]))
        x, one, y = r[:, :d], r[:, d], r[:, d + 1 :]
        n = one @ one
        middle = one / np.sqrt(n)  # the factor's image of the unit vector of ones
        if bias:
            sx, sy = one @ x / n, one @ y / n
            x, y = x - np.outer(middle, middle @ x), y - np.outer(middle, middle @ y)
        w = np.linalg.lstsq(x, y, rcond=np.finfo(float).eps * max(row["n"], d))[0]
        return w, sy - sx @ w if bias else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [solve(row) for row in batch.to_dict("records")]
            out = batch[keys].copy()
            out["w"] = [w.tolist() for w, _ in found]
            out["bias"] = [None if b is None else b.tolist() for _, b in found]
            yield out

    ddl = ", ".join(f"`{k}` {factors.schema[k].dataType.simpleString()}" for k in keys)
    return factors.select(*keys, "columns", "n", "width", "r").mapInPandas(run, f"{ddl}, {MAP}")


def bias_only(frames: DataFrame, pairs: DataFrame, feat: str = "feat") -> DataFrame:
    """M10 in long form (source, target, pos, bias): difference of the speakers' means, unmatched and uncapped."""
    from .frames import mean_by_position

    means = mean_by_position(frames, ["speaker"], feat)
    source = means.select(F.col("speaker").alias("source"), "pos", F.col("mean").alias("s"))
    target = means.select(F.col("speaker").alias("target"), "pos", F.col("mean").alias("t"))
    return pairs.join(source, "source").join(target, ["target", "pos"]).select("source", "target", "pos", (F.col("t") - F.col("s")).alias("bias"))
