"""Second moments of aligned vectors: one mergeable aggregate that all estimators start from."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import matrix

FIELDS = ("n", "sx", "sy", "sxx", "sxy", "syy")
DDL = "n double, sx array<double>, sy array<double>, sxx array<double>, sxy array<double>, syy array<double>"


def _ddl(frame: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys) + ", " + DDL


def pair_moments(pairs: DataFrame, keys: Sequence[str] = ("source", "target"), x: str = "x", y: str = "y", salts: int = 16) -> DataFrame:
    """(keys, n, sums and flattened products) over rows (keys, x, y).

    A key's rows are dealt to ``salts`` groups, each reduced by one matrix product, so a hot pair
    is shared by tasks and only ``salts`` small states a pair meet in the end.
    """
    keys = list(keys)
    ddl = _ddl(pairs, keys)

    def part(table: pa.Table) -> pa.Table:
        a, b = matrix(table.column("x")), matrix(table.column("y"))
        values = [float(len(a)), a.sum(0), b.sum(0), (a.T @ a).ravel(), (a.T @ b).ravel(), (b.T @ b).ravel()]
        return pa.table({k: table.column(k)[:1] for k in keys} | {f: [v] for f, v in zip(FIELDS, values, strict=True)})

    rows = pairs.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(salts)))
    return merge_moments(salted.groupBy(*keys, "_salt").applyInArrow(part, ddl), keys)


def merge_moments(states: DataFrame, keys: Sequence[str] = ("source", "target")) -> DataFrame:
    """Sum of the states of a key; states from other runs or streams merge alike."""
    keys = list(keys)

    def merge(table: pa.Table) -> pa.Table:
        out = {k: table.column(k)[:1] for k in keys}
        for f in FIELDS:
            states = table.column(f)
            out[f] = [states.to_numpy().sum()] if f == "n" else [matrix(states).sum(axis=0)]
        return pa.table(out)

    return states.groupBy(*keys).applyInArrow(merge, _ddl(states, keys))


#: Keys whose sums a task holds at once.
HELD_KEYS = 4096


def diagonal_moments(pairs: DataFrame, keys: Sequence[str] = ("source", "target"), x: str = "x", y: str = "y") -> DataFrame:
    """(keys, pos, n, sums and products): moments of each dimension by itself, in one-wide states.

    Sums are made where the rows lie, a vector of them a key: neither rows nor their dimensions are shuffled.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        kinds: list[pa.DataType] = []

        def told() -> pa.RecordBatch:
            columns = [pa.array(v, t) for v, t in zip(zip(*held), kinds)]
            columns += [pa.array([s[0] for s in held.values()], pa.float64())]
            columns += [pa.array([s[i] for s in held.values()], pa.list_(pa.float64())) for i in range(1, 6)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*keys, *FIELDS])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            numbers: dict[tuple, int] = {}
            at = np.array([numbers.setdefault(key, len(numbers)) for key in zip(*(batch.column(k).to_pylist() for k in keys), strict=True)])
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(len(numbers)))
            a, b = matrix(batch.column("x"))[order], matrix(batch.column("y"))[order]
            sums = [np.bincount(at).astype(float)] + [np.add.reduceat(v, starts, axis=0) for v in (a, b, a * a, a * b, b * b)]
            for key, i in numbers.items():
                own = [s[i] for s in sums]
                held[key] = [v + w for v, w in zip(held[key], own, strict=True)] if key in held else own
            if len(held) > HELD_KEYS:
                yield told()
        if held:
            yield told()

    rows = pairs.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")
    whole = merge_moments(rows.mapInArrow(run, _ddl(pairs, keys)), keys)
    cells = whole.select(*keys, "n", F.posexplode(F.arrays_zip(*FIELDS[1:])).alias("pos", "cell"))
    return cells.select(*keys, "pos", "n", *[F.array(F.col(f"cell.{f}")).alias(f) for f in FIELDS[1:]])


def entries(moments: DataFrame, field: str, keys: Sequence[str] = ("source", "target")) -> DataFrame:
    """(keys, i, j, value) of sxx, sxy or syy."""
    width = F.size("sy") if field in ("sxy", "syy") else F.size("sx")
    flat = moments.select(*keys, width.alias("width"), F.posexplode(field).alias("at", "value"))
    return flat.select(*keys, F.floor(F.col("at") / F.col("width")).cast("int").alias("i"), (F.col("at") % F.col("width")).cast("int").alias("j"), "value")


FACTORS = "n double, width int, r array<double>"


def triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor R of rows, with R'R = rows'rows; at most as many rows as columns."""
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def pair_factors(pairs: DataFrame, keys: Sequence[str] = ("source", "target"), x: str = "x", y: str = "y", salts: int = 16) -> DataFrame:
    """(keys, n, width of x, flattened r): the triangular factor of the rows [x, 1, y] of each key.

    Factors merge like moments, by stacking, but keep the rows' condition instead of its square:
    for least squares on few or nearly dependent frames.
    """
    keys = list(keys)
    ddl = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", columns int, " + FACTORS

    def part(table: pa.Table) -> pa.Table:
        a, b = matrix(table.column("x")), matrix(table.column("y"))
        r = triangle(np.hstack([a, np.ones((len(a), 1)), b]))
        return pa.table({k: table.column(k)[:1] for k in keys} | {"columns": pa.array([r.shape[1]], pa.int32()), "n": [float(len(a))], "width": pa.array([a.shape[1]], pa.int32()), "r": [r.ravel()]})

    def merge(table: pa.Table) -> pa.Table:
        columns = table.column("columns")[0].as_py()
        r = triangle(np.vstack([np.asarray(x, float).reshape(-1, columns) for x in table.column("r").to_pylist()]))
        return pa.table({k: table.column(k)[:1] for k in keys} | {"columns": table.column("columns")[:1], "n": [table.column("n").to_numpy().sum()], "width": table.column("width")[:1], "r": [r.ravel()]})

    rows = pairs.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(salts)))
    return salted.groupBy(*keys, "_salt").applyInArrow(part, ddl).groupBy(*keys).applyInArrow(merge, ddl)


# ---------------------------------------------------------------- what estimators take and give

MAP = "w array<array<double>>, bias array<double>"


@dataclass
class Moments:
    """G = X'X, C = X'Y, H = Y'Y, the sums and the count."""

    n: float
    sx: np.ndarray
    sy: np.ndarray
    g: np.ndarray
    c: np.ndarray
    h: np.ndarray

    @classmethod
    def of(cls, row) -> Moments:
        sx, sy = np.asarray(row["sx"], float), np.asarray(row["sy"], float)
        d, e = len(sx), len(sy)
        return cls(float(row["n"]), sx, sy, np.asarray(row["sxx"], float).reshape(d, d), np.asarray(row["sxy"], float).reshape(d, e), np.asarray(row["syy"], float).reshape(e, e))

    def centred(self) -> Moments:
        n = self.n
        return Moments(n, np.zeros_like(self.sx), np.zeros_like(self.sy), self.g - np.outer(self.sx, self.sx) / n, self.c - np.outer(self.sx, self.sy) / n, self.h - np.outer(self.sy, self.sy) / n)

    def offset(self, w: np.ndarray) -> np.ndarray:
        return self.sy / self.n - self.sx / self.n @ w


Fit = tuple[np.ndarray | None, np.ndarray | None]


def with_bias(fit: Callable[..., Fit]) -> Callable[..., Fit]:
    """The same estimator on centred moments, with the offset of the means."""

    def run(m: Moments, **options) -> Fit:
        w, _ = fit(m.centred(), **options)
        return w, m.offset(w)

    return run
