"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column | str) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda n, v: n + v.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda n, v: n + v.cast("double") * v.cast("double")))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; null if either vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))


def scale(a: Column | str, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(_c(a), lambda x: x.cast("double") * by)


def mean_of(vectors: Column | str) -> Column:
    """Mean of an array of vectors."""
    v = _c(vectors)
    start = F.transform(F.get(v, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(v, start, lambda s, x: add(s, x), lambda s: F.transform(s, lambda x: x / F.size(v)))


def vector_matrix(x: Column | str, matrix: Column | str) -> Column:
    """x @ W for a matrix of rows; for small widths, beyond which project() multiplies in blocks."""
    w = _c(matrix)
    width = F.size(F.get(w, F.lit(0)))
    columns = F.sequence(F.lit(0), width - 1)
    return F.transform(columns, lambda j: total(F.zip_with(_c(x), w, lambda a, row: a.cast("double") * F.get(row, j).cast("double"))))


def binarise(a: Column | str, tolerance: float) -> Column:
    """Entries below the tolerance become 0, above it 1; an entry equal to it stays."""
    return F.transform(_c(a), lambda x: F.when(x < tolerance, F.lit(0.0)).when(x > tolerance, F.lit(1.0)).otherwise(x.cast("double")))


def ablate(a: Column | str, dims: Sequence[int]) -> Column:
    """The given dimensions, from 0, set to 0."""
    gone = F.array(*[F.lit(int(d)) for d in dims])
    return F.transform(_c(a), lambda x, i: F.when(F.array_contains(gone, i), F.lit(0.0)).otherwise(x.cast("double")))
