"""Lasso maps from moments (M5, M6): ||Y - XW||^2 / 2n + alpha |W|, to a given duality gap.

Alternating directions, all outputs at once on one eigen-decomposition of X'X, bring most outputs
to the gap and the others near their supports, however nearly dependent the columns are. What is
left is solved output by output on a working set: its stationary point under the present signs, up
to the best change of sign on the way, until no coefficient outside wants to enter. Both start
from the solution before on a list of alphas.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .moments import FIELDS, MAP, Fit, Moments

#: Gap, as a share of an output's mean square, at which it counts as solved.
TOLERANCE = 1e-8


def gaps(g: np.ndarray, c: np.ndarray, h: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """Duality gap of each output: the objective less what the residual, scaled to be feasible, proves it to be at least."""
    gw = g @ w
    most = np.abs(c - gw).max(axis=0, initial=0)
    s = np.minimum(1, alpha / np.maximum(most, 1e-300))
    cw = (c * w).sum(axis=0)
    left = h - 2 * cw + (w * gw).sum(axis=0)
    primal = left / 2 + alpha * np.abs(w).sum(axis=0)
    return primal - h / 2 + (h - 2 * s * (h - cw) + s * s * left) / 2


@dataclass
class Spectrum:
    """Eigen-decomposition of G, worked out once for all alphas."""

    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, g: np.ndarray) -> Spectrum:
        values, vectors = np.linalg.eigh(g)
        return cls(np.maximum(values, 0), vectors)


def alternate(spectrum: Spectrum, g: np.ndarray, c: np.ndarray, h: np.ndarray, w: np.ndarray, alpha: float, enough: np.ndarray, steps: int = 400, every: int = 20) -> np.ndarray:
    """Alternating directions between the smooth part and the penalty; an output within its gap drops out.

    The weight of each output's split follows its two residuals.
    """
    values, vectors = spectrum.values, spectrum.vectors
    w = w.copy()
    if not len(g) or values[-1] <= 0:
        return w
    open_ = np.flatnonzero(gaps(g, c, h, w, alpha) > enough)
    z = w[:, open_]
    dual = np.clip(c[:, open_] - g @ z, -alpha, alpha)
    weight = np.full(len(open_), np.sqrt(values[-1] * values.mean()))
    turned = vectors.T @ c
    size = lambda x: np.maximum(np.linalg.norm(x, axis=0), 1e-300)
    for step in range(1, steps + 1):
        if not len(open_):
            break
        x = vectors @ ((turned[:, open_] + vectors.T @ (weight * z - dual)) / (values[:, None] + weight))
        over = 1.6 * x - 0.6 * z
        moved = over + dual / weight
        new = np.sign(moved) * np.maximum(np.abs(moved) - alpha / weight, 0)
        dual = dual + weight * (over - new)
        if step % every == 0 or step == steps:
            ratio = np.sqrt(size(x - new) / size(new) * size(dual) / size(weight * (new - z)))
            factor = np.clip(ratio, 0.2, 5)
            weight = weight * np.where((factor > 1.5) | (factor < 0.67), factor, 1)
            w[:, open_] = new
            keep = gaps(g, c[:, open_], h[open_], new, alpha) > enough[open_]
            open_, new, dual, weight = open_[keep], new[:, keep], dual[:, keep], weight[keep]
        z = new
    return w


def working_set(g: np.ndarray, c: np.ndarray, w: np.ndarray, alpha: float, steps: int) -> np.ndarray:
    """One output's solution: exact on its signs, with the objective falling at every step."""
    w, sign = w.copy(), np.sign(w)
    little = 1e-13 * max(float(np.trace(g)) / max(len(g), 1), 1e-300)

    def cost(x: np.ndarray, on: np.ndarray) -> float:
        return float(x @ (g[np.ix_(on, on)] @ x) / 2 - c[on] @ x + alpha * np.abs(x).sum())

    settled = False
    for _ in range(steps):
        slope = c - g @ w
        if settled or not sign.any():
            free = np.where(sign == 0, np.abs(slope), 0)
            i = int(free.argmax())
            if free[i] <= alpha * (1 + 1e-9):
                break
            sign[i] = np.sign(slope[i])
        on = np.flatnonzero(sign)
        old = w[on]
        new = np.linalg.solve(g[np.ix_(on, on)] + little * np.eye(len(on)), c[on] - alpha * sign[on] + little * old)
        # the best of the end and of the points where a coefficient passes zero
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = np.where(old * new < 0, old / (old - new), np.inf)
        where = np.append(np.unique(cross[np.isfinite(cross)]), 1.0)
        points = [old + s * (new - old) for s in where]
        for s, x in zip(where, points, strict=True):
            x[np.abs(cross - s) <= 1e-15] = 0
        best = min(points, key=lambda x: cost(x, on))
        settled = best is points[-1] and bool((np.sign(best) == sign[on]).all())
        if cost(best, on) >= cost(old, on) and not settled:
            settled = True
            best = old
        w[on], sign[on] = best, np.sign(best)
    return w


def solve(g: np.ndarray, c: np.ndarray, h: np.ndarray, alpha: float, start: np.ndarray | None = None, tolerance: float = TOLERANCE, spectrum: Spectrum | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(W, gap of each output as a share of its ``h``) for G = X'X / n, C = X'Y / n and h = diag(Y'Y) / n."""
    w = np.zeros_like(c) if start is None else start
    scale = np.maximum(h, 1e-300)
    w = alternate(spectrum or Spectrum.of(g), g, c, h, w, alpha, tolerance * scale)
    open_ = gaps(g, c, h, w, alpha) > tolerance * scale
    for j in range(w.shape[1]):
        if not open_[j]:
            w[:, j] = finished(g, c[:, j], w[:, j], alpha)
            open_[j] = strays(g, c[:, j], w[:, j], alpha)
        if open_[j]:
            w[:, j] = better(g, c, h, w, j, working_set(g, c[:, j], w[:, j], alpha, 20 * len(g) + 20), alpha)
    return w, gaps(g, c, h, w, alpha) / scale


def finished(g: np.ndarray, c: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """One output's stationary point on the signs it has, if it keeps them; a gap that is met says little of the last digits."""
    on = np.flatnonzero(w)
    if not len(on):
        return w
    try:
        new = np.linalg.solve(g[np.ix_(on, on)], c[on] - alpha * np.sign(w[on]))
    except np.linalg.LinAlgError:
        return w
    if not np.isfinite(new).all() or (np.sign(new) != np.sign(w[on])).any():
        return w
    out = np.zeros_like(w)
    out[on] = new
    return out


def strays(g: np.ndarray, c: np.ndarray, w: np.ndarray, alpha: float) -> bool:
    """Whether an output breaks its conditions by more than the rounding of ``working_set``: a coefficient at zero wants to enter, or one that is not lies off."""
    slope = c - g @ w
    off = np.where(w == 0, np.abs(slope) - alpha, np.abs(slope - alpha * np.sign(w)))
    return bool(off.max(initial=0) > alpha * 1e-9 + 1e-12 * np.abs(c).max(initial=0))


def better(g: np.ndarray, c: np.ndarray, h: np.ndarray, w: np.ndarray, j: int, new: np.ndarray, alpha: float) -> np.ndarray:
    """The new solution of output ``j``, or the old one if its gap is less."""
    both = np.stack([w[:, j], new], axis=1)
    old_gap, new_gap = gaps(g, c[:, [j, j]], h[[j, j]], both, alpha)
    return new if new_gap <= old_gap + 1e-15 * h[j] else w[:, j]


def path(m: Moments, alphas: Sequence[float], tolerance: float = TOLERANCE) -> Iterator[tuple[float, np.ndarray, float]]:
    """(alpha, W, largest gap), from the largest alpha down, each from the solution before."""
    g, c, h = m.g / m.n, m.c / m.n, np.diag(m.h) / m.n
    w, spectrum = None, Spectrum.of(g)
    for alpha in sorted(set(alphas), reverse=True):
        w, gap = solve(g, c, h, alpha, w, tolerance, spectrum)
        yield alpha, w, float(gap.max(initial=0))
        w = w.copy()


def lasso(m: Moments, alpha: float = 0.3, tolerance: float = TOLERANCE) -> Fit:
    """M5. ArithmeticError if an output doesn't come within ``tolerance`` of its optimum."""
    ((_, w, gap),) = path(m, [alpha], tolerance)
    if gap > tolerance:
        raise ArithmeticError(f"lasso: gap {gap} at alpha {alpha}; {tolerance} was asked for")
    return w, None


def lasso_path(moments: DataFrame, alphas: Sequence[float], bias: bool = False, keys: Sequence[str] = ("source", "target"), tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, alpha, gap, settled, w, bias) of every pair and alpha: one fit a pair, from the largest alpha down.

    ``settled`` says whether the gap, as a share of an output's mean square (M6: of its variance), is within ``tolerance``.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                m = Moments.of(row)
                for alpha, w, gap in path(m.centred() if bias else m, alphas, tolerance):
                    yield pd.DataFrame({**{k: [row[k]] for k in keys}, "alpha": alpha, "gap": gap, "settled": gap <= tolerance, "w": [w.tolist()], "bias": [m.offset(w).tolist() if bias else None]})

    ddl = ", ".join(f"`{k}` {moments.schema[k].dataType.simpleString()}" for k in keys)
    return moments.select(*keys, *FIELDS).mapInPandas(run, f"{ddl}, alpha double, gap double, settled boolean, {MAP}")
