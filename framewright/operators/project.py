"""Applying maps to frames (M14), and PCA."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import matrix, vectors
from ..stored import stored
from .frames import wide
from .moments import pair_moments

#: Bytes of maps that are broadcast; larger sets meet their frames by shuffle.
BROADCAST_BYTES = 64 << 20

Map = tuple[np.ndarray | None, np.ndarray | None]


def applied(x: np.ndarray, found: Map) -> np.ndarray:
    """x W + b, either part left out if it is None."""
    w, b = found
    y = x if w is None else x @ w
    return y if b is None else y + b


def read_maps(table: pa.Table, on: Sequence[str]) -> dict[tuple, Map]:
    out = {}
    for row in range(table.num_rows):
        w, b = table.column("w")[row], table.column("bias")[row]
        out[tuple(table.column(k)[row].as_py() for k in on)] = (matrix(w.values) if w.is_valid else None, np.array(b.as_py()) if b.is_valid else None)
    return out


def project(frames: DataFrame, maps: DataFrame, on: Sequence[str], feat: str = "feat", name: str = "projected", salts: int = 16) -> DataFrame:
    """Frames with x W + b of their map; a null part is left out, a frame without map goes.

    Maps are worked out once and kept for the size check and their use. Maps of up to
    BROADCAST_BYTES in all are broadcast once and frames stay where they are.
    Beyond that frames and maps are dealt by (key, salt): a map is sent to its ``salts`` groups, a
    frame once, and no matrix is ever copied next to every frame.
    """
    on = list(on)
    maps = maps.select(*on, "w", "bias").persist()
    size = maps.select(F.sum(F.coalesce(F.size("w") * F.size(F.get("w", F.lit(0))), F.lit(0)) * 8 + F.coalesce(F.size("bias"), F.lit(0)) * 8)).first()[0] or 0
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + f", `{name}` array<double>"

    if size <= BROADCAST_BYTES:
        sent = frames.sparkSession.sparkContext.broadcast(read_maps(maps.toArrow(), on))
        maps.unpersist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in on), strict=True)):
                    groups.setdefault(key, []).append(i)
                for key, rows in groups.items():
                    if key in sent.value:
                        own = batch.take(pa.array(rows))
                        table = pa.Table.from_batches([own]).append_column(name, vectors(applied(matrix(own.column(feat)), sent.value[key])))
                        yield from table.to_batches()

        return frames.mapInArrow(run, ddl)

    def group(own: pa.Table, found: pa.Table) -> pa.Table:
        own = own.drop_columns(["_salt"])
        if not own.num_rows or not found.num_rows:
            return own.slice(0, 0).append_column(name, pa.array([], pa.list_(pa.float64())))
        (only,) = read_maps(found, on).values()
        return own.append_column(name, vectors(applied(matrix(own.column(feat)), only)))

    kept = stored(maps)
    maps.unpersist()
    maps = kept
    dealt = frames.withColumn("_salt", F.pmod(F.xxhash64(feat), F.lit(salts)))
    spread = maps.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.groupBy(*on, "_salt").cogroup(spread.groupBy(*on, "_salt")).applyInArrow(group, ddl)


def shift(frames: DataFrame, bias: DataFrame, on: Sequence[str], feat: str = "feat") -> DataFrame:
    """A map that is only an offset, in long form: (frames' columns, pos, value).

    Offsets meet the frames as one vector a key; vectors become rows only in the result.
    """
    rest = [c for c in frames.columns if c != feat]
    keys = [c for c in bias.columns if c not in ("pos", "bias")]
    moved = F.zip_with(feat, "_bias", lambda x, b: x.cast("double") + b)
    met = frames.join(wide(bias, keys, value="bias", name="_bias"), list(on))
    return met.select(*rest, *[c for c in keys if c not in on], F.posexplode(moved).alias("pos", "value"))


def pca(frames: DataFrame, k: int, feat: str = "feat") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (k rows) and explained variance of all frames, from one moments aggregate.

    A component's largest entry is positive, so that reruns agree.
    """
    row = pair_moments(frames.select(F.lit(0).alias("all"), F.col(feat).alias("x"), F.array(F.lit(0.0)).alias("y")), ["all"], salts=64).first()
    n, mean = row["n"], np.array(row["sx"]) / row["n"]
    cov = (np.array(row["sxx"]).reshape(len(mean), -1) - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :k].T
    sign = np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])
    return mean, top * sign[:, None], np.maximum(values[::-1][:k], 0)


def pca_whiten(frames: DataFrame, mean, components, variance, feat: str = "feat", name: str = "whitened") -> DataFrame:
    """(x - mean) C' / sqrt(variance)."""
    w = (np.asarray(components) / np.sqrt(np.asarray(variance))[:, None]).T
    return _affine(frames, w, -np.asarray(mean) @ w, feat, name)


def pca_restore(frames: DataFrame, mean, components, variance, feat: str = "whitened", name: str = "restored") -> DataFrame:
    """z (sqrt(variance) C) + mean."""
    return _affine(frames, np.sqrt(np.asarray(variance))[:, None] * np.asarray(components), np.asarray(mean), feat, name)


def _affine(frames: DataFrame, w: np.ndarray, b: np.ndarray, feat: str, name: str) -> DataFrame:
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + f", {name} array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]).append_column(name, vectors(matrix(batch.column(feat)) @ w + b))
                yield from table.to_batches()

    return frames.mapInArrow(run, ddl)
