"""Joint factorisation of aligned speakers into shared content and per-speaker bases.

The wide matrix A (reference frames x speakers times width) is never formed. It lies in blocks of
reference frames and speakers; products A Z and A'Q are equi joins of blocks with the blocks of a
narrow matrix, and what the driver sees are triangles as wide as those narrow matrices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import matrix, vectors
from ..stored import dropped, stored

BASIS = "speaker string, basis array<array<double>>"
BLOCKS = "block int, speaker string, refs binary, x binary"
ROWS = "block int, refs binary, x binary"
PARTS = "speaker string, x binary"

#: Reference frames of a block.
BLOCK = 1024


def blocks_of(aligned: DataFrame) -> DataFrame:
    """(block, speaker, refs, x): frames of (ref_idx, speaker, feat) in matrices whose rows are in order of ref_idx."""
    n = aligned.agg(F.approx_count_distinct("ref_idx")).first()[0]
    block = F.pmod(F.xxhash64(F.col("ref_idx").cast("long")), F.lit(max(1, -(-n // BLOCK)))).cast("int")

    def pack(table: pa.Table) -> pa.Table:
        refs, order = np.unique(table.column("ref_idx").to_numpy(), return_index=True)
        return pa.table({"block": table.column("block")[:1], "speaker": table.column("speaker")[:1], "refs": pa.array([refs.tobytes()], pa.binary()), "x": pa.array([matrix(table.column("feat"))[order].tobytes()], pa.binary())})

    rows = aligned.select(block.alias("block"), "speaker", F.col("ref_idx").cast("long").alias("ref_idx"), "feat")
    return stored(rows.groupBy("block", "speaker").applyInArrow(pack, BLOCKS))


def dense(x: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(x).reshape(rows, -1)


def references(refs: bytes) -> np.ndarray:
    return np.frombuffer(refs, np.int64)


def cells(batch: pa.RecordBatch | pa.Table, *columns: str) -> Iterator[tuple[pa.Buffer, ...]]:
    """Binary columns row by row, without copies."""
    return zip(*((v.as_buffer() for v in batch.column(c)) for c in columns), strict=True)


def gram_blocks(aligned: DataFrame, salts: int = 16) -> DataFrame:
    """(a, b, width, gram): A_a' A_b for all speakers, from (ref_idx, speaker, feat).

    Blocks of speakers a <= b meet by their reference frames and are reduced by matrix products;
    the other half is the transpose.
    """
    blocks = blocks_of(aligned)
    left = blocks.select("block", F.col("speaker").alias("a"), "refs", "x")
    right = blocks.select("block", F.col("speaker").alias("b"), F.col("refs").alias("others"), F.col("x").alias("y"))
    met = left.join(right, "block").filter("a <= b").withColumn("salt", F.pmod("block", F.lit(salts)))

    def multiply(table: pa.Table) -> pa.Table:
        total, width = 0.0, 1
        for refs, x, others, y in cells(table, "refs", "x", "others", "y"):
            r, q = references(refs), references(others)
            _, i, j = np.intersect1d(r, q, assume_unique=True, return_indices=True)
            b = dense(y, len(q))
            total, width = total + dense(x, len(r))[i].T @ b[j], b.shape[1]
        return pa.table({"a": table.column("a")[:1], "b": table.column("b")[:1], "width": pa.array([width], pa.int32()), "gram": [total.ravel()]})

    def merge(table: pa.Table) -> pa.Table:
        a, b, width = (table.column(c)[0].as_py() for c in ("a", "b", "width"))
        total = matrix(table.column("gram")).sum(axis=0).reshape(-1, width)
        both = [(a, b, width, total)] + [(b, a, len(total), total.T)] * (a != b)
        a, b, width, gram = zip(*both, strict=True)
        return pa.table({"a": a, "b": b, "width": pa.array(width, pa.int32()), "gram": [g.ravel() for g in gram]})

    ddl = "a string, b string, width int, gram array<double>"
    return met.groupBy("a", "b", "salt").applyInArrow(multiply, ddl).groupBy("a", "b").applyInArrow(merge, ddl)


def gram_entries(aligned: DataFrame) -> DataFrame:
    """(a, b, i, j, value): entries of every block A_a' A_b of the Gramian over reference frames."""
    flat = gram_blocks(aligned).select("a", "b", "width", F.posexplode("gram").alias("at", "value"))
    return flat.select("a", "b", F.floor(F.col("at") / F.col("width")).cast("int").alias("i"), (F.col("at") % F.col("width")).cast("int").alias("j"), "value")


# ---------------------------------------------------------------- narrow matrices


def times(blocks: DataFrame, z: DataFrame) -> DataFrame:
    """A Z in rows (block, refs, x), from Z in parts (speaker, x) of width rows each."""
    met = blocks.join(z.select("speaker", F.col("x").alias("z")), "speaker").select("block", "refs", "x", "z")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, (refs, x, z) in zip(batch.column("block").to_pylist(), cells(batch, "refs", "x", "z"), strict=True):
                x = dense(x, len(references(refs)))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "refs": pa.array([refs.to_pybytes()], pa.binary()), "x": [(x @ dense(z, x.shape[1])).tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        parts = [(references(r), x) for r, x in cells(table, "refs", "x")]
        refs = np.unique(np.concatenate([r for r, _ in parts]))
        total = np.zeros((len(refs), len(np.frombuffer(parts[0][1])) // len(parts[0][0])))
        for r, x in parts:
            total[np.searchsorted(refs, r)] += dense(x, len(r))
        return pa.table({"block": table.column("block")[:1], "refs": pa.array([refs.tobytes()], pa.binary()), "x": pa.array([total.tobytes()], pa.binary())})

    return met.mapInArrow(multiply, ROWS).groupBy("block").applyInArrow(add, ROWS)


#: Speakers whose sums a task holds at once.
HELD_SPEAKERS = 64


def adjoint(blocks: DataFrame, q: DataFrame) -> DataFrame:
    """A'Q in parts (speaker, x), from Q in rows (block, refs, x): summed where the blocks meet, so that no block is shuffled or held again."""
    met = blocks.join(q.select("block", F.col("refs").alias("others"), F.col("x").alias("q")), "block").select("speaker", "refs", "x", "others", "q")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"speaker": pa.array(list(held), pa.string()), "x": pa.array([np.ascontiguousarray(v).tobytes() for v in held.values()], pa.binary())})
            held.clear()
            return out

        for batch in batches:
            for speaker, (refs, x, others, q) in zip(batch.column("speaker").to_pylist(), cells(batch, "refs", "x", "others", "q"), strict=True):
                r, o = references(refs), references(others)
                made = dense(x, len(r)).T @ dense(q, len(o))[np.searchsorted(o, r)]
                held[speaker] = held[speaker] + made if speaker in held else made
                if len(held) > HELD_SPEAKERS:
                    yield told()
        if held:
            yield told()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for (x,) in cells(table, "x"))
        return pa.table({"speaker": table.column("speaker")[:1], "x": pa.array([total.tobytes()], pa.binary())})

    return met.mapInArrow(multiply, PARTS).groupBy("speaker").applyInArrow(add, PARTS)


def triangle(rows: DataFrame, width: int, salts: int = 16) -> np.ndarray:
    """R with R'R = M'M of a narrow matrix M: triangles of its pieces, of ``salts`` groups of them, and of those."""

    def small(x: np.ndarray) -> bytes:
        return np.ascontiguousarray(np.linalg.qr(x, mode="r")).tobytes()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (x,) in cells(batch, "x"):
                yield pa.RecordBatch.from_pydict({"x": pa.array([small(np.frombuffer(x).reshape(-1, width))], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"x": pa.array([small(np.vstack([np.frombuffer(x).reshape(-1, width) for (x,) in cells(table, "x")]))], pa.binary())})

    parts = rows.select("x").mapInArrow(part, "x binary").groupBy(F.pmod(F.xxhash64("x"), F.lit(salts))).applyInArrow(merge, "x binary")
    found = [np.frombuffer(r["x"]).reshape(-1, width) for r in parts.collect()]
    return np.linalg.qr(np.vstack(found), mode="r") if found else np.zeros((0, width))


def turned(rows: DataFrame, by: np.ndarray) -> DataFrame:
    """A narrow matrix times a small one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [(np.frombuffer(x).reshape(-1, len(by)) @ by).tobytes() for (x,) in cells(batch, "x")]
            yield batch.set_column(batch.schema.get_field_index("x"), "x", pa.array(x, pa.binary()))

    return rows.mapInArrow(run, rows.schema)


#: Singular values under this share of the largest count as zero: vectors are only known to rounding over it.
LEAST = 1e-9


def orthonormal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(M's singular values, right vectors W, and W / values) of a matrix with triangle ``r``; M (W / values) has orthonormal columns, to rounding over the least value's share."""
    _, values, wt = np.linalg.svd(r)
    keep = values > (values[0] if len(values) else 0) * LEAST
    w = wt[: len(values)][keep].T
    return values[keep], w, w / values[keep]


def beside(parts: list[DataFrame], widths: list[int]) -> DataFrame:
    """Matrices in rows of the same blocks, side by side."""
    named = [p.select("block", *(["refs"] if i == 0 else []), F.col("x").alias(f"x{i}")) for i, p in enumerate(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, (refs, *parts) in zip(batch.column("block").to_pylist(), cells(batch, "refs", *(f"x{i}" for i in range(len(widths)))), strict=True):
                x = np.hstack([np.frombuffer(v).reshape(-1, w) for v, w in zip(parts, widths, strict=True)])
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "refs": pa.array([refs.to_pybytes()], pa.binary()), "x": [x.tobytes()]})

    return reduce(lambda a, b: a.join(b, "block"), named).mapInArrow(run, ROWS)


def random_parts(blocks: DataFrame, columns: int, seed: str) -> DataFrame:
    """Gaussian columns, those of a speaker drawn from the seed and its name wherever they are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, width in zip(batch.column("speaker").to_pylist(), batch.column("width").to_pylist(), strict=True):
                rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big"))
                yield pa.RecordBatch.from_pydict({"speaker": [name], "x": pa.array([rng.standard_normal((width, columns)).tobytes()], pa.binary())})

    width = F.max(F.octet_length("x") / F.octet_length("refs")).cast("int")
    return blocks.groupBy("speaker").agg(width.alias("width")).mapInArrow(run, PARTS)


# ---------------------------------------------------------------- the decomposition


@dataclass
class Factorisation:
    """A ~ U S V': the aligned frames (XS), U a row a reference frame, S, and V' as each speaker's columns."""

    aligned: DataFrame
    left: DataFrame
    singular: np.ndarray
    bases: DataFrame

    def write(self, folder: str) -> None:
        """Parquet tables XS (ref_idx, speaker, feat), U (ref_idx, u), S (place, value) and VT (speaker, basis) (K3)."""
        values = self.aligned.sparkSession.createDataFrame(list(enumerate(map(float, self.singular))), "place int, value double")
        for name, table in (("XS", self.aligned), ("U", self.left), ("S", values), ("VT", self.bases)):
            table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def factorise(aligned: DataFrame, rank: int, extra: int = 10, steps: int = 8, tolerance: float = 1e-7, rounds: int = 30, seed: str = "13") -> Factorisation:
    """The ``rank`` leading singular triples of the aligned frames (ref_idx, speaker, feat).

    Block Krylov method: ``steps`` products with A A' of rank + ``extra`` columns span a space in
    which the triples are exact to rounding once A v = s u holds within ``tolerance`` of the
    largest value; until then the space is built anew from the triples found. Raises
    ArithmeticError if ``rounds`` spaces don't suffice. Fewer triples come back where A has fewer
    singular values over LEAST of the largest. A column's sign is that of the sum of U's column, so that reruns agree.
    """
    xs = stored(aligned.select("ref_idx", "speaker", F.col("feat").cast("array<double>").alias("feat")))
    blocks = blocks_of(xs)
    if blocks.isEmpty():
        spark = aligned.sparkSession
        return Factorisation(xs, spark.createDataFrame([], "ref_idx long, u array<double>"), np.zeros(0), spark.createDataFrame([], BASIS))
    start, columns = random_parts(blocks, rank + extra, seed), rank + extra
    for _ in range(rounds):
        stack, widths, used = [], [], []
        for step in range(steps):
            z = start if step == 0 else adjoint(blocks, stack[-1])
            y = stored(times(blocks, z))
            used.append(y)
            _, _, by = orthonormal(triangle(y, columns if step == 0 else widths[-1]))
            if not by.shape[1]:
                break
            stack.append(turned(y, by))
            widths.append(by.shape[1])
            if step == 0:
                rows_in_all = y.agg(F.sum(F.octet_length("refs") / 8)).first()[0]
            if sum(widths) >= rows_in_all:  # nothing is left to span
                break
        if not stack:
            empty = aligned.sparkSession.createDataFrame([], BASIS)
            return Factorisation(xs, aligned.sparkSession.createDataFrame([], "ref_idx long, u array<double>"), np.zeros(0), empty)
        space = stored(beside(stack, widths))
        _, _, by = orthonormal(triangle(space, sum(widths)))
        rough = stored(turned(space, by))
        _, _, by = orthonormal(triangle(rough, by.shape[1]))
        q = stored(turned(rough, by))
        z = stored(adjoint(blocks, q))
        values, w, by = orthonormal(triangle(z, by.shape[1]))
        values, w, by = values[: rank + extra], w[:, : rank + extra], by[:, : rank + extra]
        top = min(rank, len(values))
        left, right = turned(q, w[:, :top]), turned(z, by[:, :top])
        off = triangle(beside([times(blocks, right), left], [top, top]).transform(lambda d: turned(d, np.vstack([np.eye(top), -np.diag(values[:top])]))), top)
        if not len(values) or np.sqrt(np.square(off).sum(axis=0).max()) <= tolerance * values[0]:
            break
        start, columns = stored(turned(z, by)), by.shape[1]
        for table in (*used, space, rough, q, z):
            dropped(table)
    else:
        raise ArithmeticError(f"the singular triples have not settled within {tolerance} after {rounds} rounds")
    sign = np.array([1.0 if v >= 0 else -1.0 for v in column_sums(left, top)])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for refs, x in cells(batch, "refs", "x"):
                refs = references(refs)
                yield pa.RecordBatch.from_pydict({"ref_idx": refs, "u": vectors(dense(x, len(refs)) * sign)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"speaker": [row["speaker"]], "basis": pa.array([(np.frombuffer(row["x"]).reshape(-1, top) * sign).T.tolist()], pa.list_(pa.list_(pa.float64())))})

    found = Factorisation(xs, stored(left.mapInArrow(frames, "ref_idx long, u array<double>")), values[:top], stored(right.mapInArrow(rows, BASIS)))
    for table in (*used, space, rough, q, z, blocks):
        dropped(table)
    return found


def column_sums(rows: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for (x,) in cells(batch, "x"):
                total += np.frombuffer(x).reshape(-1, width).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(width), pa.int32()), "value": pa.array(total)})

    out = np.zeros(width)
    for r in rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def maps_from_bases(bases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, w, bias): W = pinv(V_source) V_target for every pair."""
    left = bases.select(F.col("speaker").alias("source"), F.col("basis").alias("s"))
    right = bases.select(F.col("speaker").alias("target"), F.col("basis").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = [(np.linalg.pinv(np.vstack(s)) @ np.vstack(t)).tolist() for s, t in zip(batch["s"], batch["t"], strict=True)]
            yield pd.DataFrame({"source": batch["source"], "target": batch["target"], "w": w, "bias": None})

    return pairs.join(left, "source").join(right, "target").select("source", "target", "s", "t").mapInPandas(run, "source string, target string, w array<array<double>>, bias array<double>")


def content_maps(bases: DataFrame) -> DataFrame:
    """(speaker, w, bias): W = pinv(V), which project() turns frames into content codes with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"speaker": batch["speaker"], "w": [np.linalg.pinv(np.vstack(b)).tolist() for b in batch["basis"]], "bias": None})

    return bases.mapInPandas(run, "speaker string, w array<array<double>>, bias array<double>")
