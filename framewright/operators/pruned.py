"""Exact top-k cosine joins that skip what bounds rule out.

On the unit sphere a cosine distance d is a chord of length sqrt(2 d), so the triangle inequality
holds between chords. The frames of a speaker are gathered in *balls*: those nearest to one of a
few drawn pivots, cut into parts of bounded size, with the centre and the radius of each. Two balls whose
centres lie g apart have all their chords between g - r - r' and g + r + r'.

Balls lie in *pages* of some thousand frames, each a ball itself, and pages are what is joined:

1. For each page of a source, the targets' pages that surely hold k frames, nearest first, are
   its *seeds*; a page that starts beyond where they end can't matter and goes at once.
2. Products with the seeds give each frame k candidates and so the distance that others must beat.
3. Of the other pages those that start nearer than the farthest such distance of the source page meet it.
4. Within two pages the same is done with their balls, as the distances to beat fall.

What pivots are drawn and how full balls are changes the cost, never the result. Frames spread
evenly in many dimensions have wide balls, and then all pairs meet as in ``matching``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import matrix
from ..arrow import vectors as arrow_vectors
from ..stored import stored
from .matching import DIGITS, OPEN_BYTES, SALTS, Nearest, best_k, dealt_to, directed, numbers, packed, unit

#: Added to limits: more than the rounding of a distance.
SLACK = 1e-9
#: A cluster's number comes before a part's in the number of a ball.
_PARTS = 1 << 32

_PIECE = pa.schema([("speaker", pa.string()), ("cluster", pa.int64()), ("piece", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary())])
_BALL = pa.schema([("speaker", pa.string()), ("ball", pa.int64()), ("n", pa.int64()), ("radius", pa.float64()), ("centre", pa.list_(pa.float64())), ("ids", pa.binary()), ("matrix", pa.binary())])
_BOUND = pa.schema([("source", pa.string()), ("target", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
_PAGE = pa.schema([*_BALL, ("sizes", pa.list_(pa.int64())), ("radii", pa.list_(pa.float64())), ("centres", pa.binary())])
#: Frames of a page.
PAGE = 4096


def chords(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between all rows of two matrices."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def balls(frames: DataFrame, block: int = 256, pivots: int = 256, id_col: str = "frame_id", feat: str = "feat") -> DataFrame:
    """(speaker, ball, n, radius, centre, ids, matrix): all frames that have a direction, in balls of about ``block``.

    About ``pivots`` frames of a speaker are drawn by a hash of the id, fewer of one with few
    frames. A cluster of more than ``block`` frames becomes several balls, dealt by a hash, so a hot
    speaker or a direction that a third of all frames share is many balls.
    """
    counted = frames.groupBy("speaker").agg(F.count(F.lit(1)).alias("n_frames"))
    share = F.least(F.lit(float(pivots)), F.ceil(F.col("n_frames") / F.lit(block))) / F.col("n_frames")
    place = F.pmod(F.xxhash64(F.lit("pivot"), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = frames.join(counted, "speaker").filter(place < share).groupBy("speaker").agg(F.collect_list(F.col(feat).cast("array<double>")).alias("pivots"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                rows = np.frombuffer(row["matrix"]).reshape(len(ids), -1)
                some = directed(rows)
                ids, rows = ids[some], rows[some]
                near = np.array(row["pivots"] or np.empty((0, rows.shape[1])), np.float64)
                near = near[directed(near)]
                at = np.argmax(unit(rows) @ unit(near).T, axis=1) if len(near) else np.zeros(len(ids), np.int64)
                for c in np.unique(at).tolist():
                    own = at == c
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row["speaker"], c, row["block"], int(own.sum()), ids[own].tobytes(), rows[own].tobytes()), _PIECE.types, strict=True)], schema=_PIECE)

    pieces = stored(packed(frames, 4 * block, id_col, feat).join(drawn, "speaker", "left").mapInArrow(assign, "speaker string, cluster long, piece int, n long, ids binary, matrix binary"))
    parts = pieces.groupBy("speaker", "cluster").agg(F.ceil(F.sum("n") / F.lit(block)).alias("parts"))
    dealt = pieces.join(parts, ["speaker", "cluster"]).select("speaker", (F.col("cluster") * _PARTS + F.pmod(F.xxhash64("piece"), F.col("parts"))).alias("ball"), "ids", "matrix")

    def gather(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        rows = np.frombuffer(b"".join(table.column("matrix").to_pylist())).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        direction = unit(rows)
        centre = direction.mean(0)
        radius = float(np.linalg.norm(direction - centre, axis=1).max())
        return pa.table([table.column("speaker")[:1], table.column("ball")[:1], [len(ids)], [radius], arrow_vectors(centre[None]), [ids.tobytes()], [rows.tobytes()]], schema=_BALL)

    return stored(dealt.groupBy("speaker", "ball").applyInArrow(gather, "speaker string, ball long, n long, radius double, centre array<double>, ids binary, matrix binary"))


def bounded_pairs(held: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(source, target, a, b, n, low, high, near, seed) of every pair of balls; ``near``: it can hold one of the k nearest."""
    shape = held.select("speaker", "ball", F.concat("centre", F.array("radius", F.col("n").cast("double"))).alias("shape"))
    many = packed(shape, 256, "ball", "shape")
    left = many.select(F.col("speaker").alias("source"), F.col("ids").alias("s_ids"), F.col("matrix").alias("s_matrix"))
    right = many.select(F.col("speaker").alias("target"), F.col("ids").alias("t_ids"), F.col("matrix").alias("t_matrix"))
    met = pairs.select("source", "target").distinct().join(left, "source").join(right, "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = np.frombuffer(row["s_ids"], np.int64), np.frombuffer(row["t_ids"], np.int64)
                x, y = np.frombuffer(row["s_matrix"]).reshape(len(a), -1), np.frombuffer(row["t_matrix"]).reshape(len(b), -1)
                gap, width = chords(x[:, :-2], y[:, :-2]), x[:, -2:-1] + y[:, -2:-1].T
                low, high = np.maximum(gap - width, 0) ** 2 / 2, np.minimum(gap + width, 2) ** 2 / 2
                each = (np.repeat(a, len(b)), np.tile(b, len(a)), np.tile(y[:, -1].astype(np.int64), len(a)), low.ravel(), high.ravel())
                yield pa.RecordBatch.from_arrays([pa.array([row["source"]] * low.size, pa.string()), pa.array([row["target"]] * low.size, pa.string()), *map(pa.array, each)], schema=_BOUND)

    bounds = met.mapInArrow(run, "source string, target string, a long, b long, n long, low double, high double")
    own = Window.partitionBy("source", "target", "a")
    so_far = F.sum("n").over(own.orderBy("high", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reach = F.min(F.when(F.col("so_far") >= k, F.col("high"))).over(own)
    marked = bounds.withColumn("so_far", so_far).withColumn("reach", reach)
    near = F.col("reach").isNull() | (F.col("low") <= F.col("reach") + F.lit(SLACK))
    return marked.select("source", "target", "a", "b", "n", "low", "high", near.alias("near"), (F.col("so_far") - F.col("n") < k).alias("seed"))


def pages(held: DataFrame, page: int = PAGE) -> DataFrame:
    """Balls of a speaker gathered in pages of about ``page`` frames, each a ball itself that keeps its balls' sizes, radii and centres."""
    place = F.sum("n").over(Window.partitionBy("speaker").orderBy("ball").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    at = held.select("speaker", "ball", "n").withColumn("page", F.floor(place / F.lit(page))).drop("n")

    def gather(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        rows = np.frombuffer(b"".join(table.column("matrix").to_pylist())).reshape(len(ids), -1)
        direction = unit(rows)
        centre = direction.mean(0)
        radius = float(np.linalg.norm(direction - centre, axis=1).max())
        return pa.table([table.column("speaker")[:1], table.column("page")[:1], [len(ids)], [radius], arrow_vectors(centre[None]), [ids.tobytes()], [rows.tobytes()], [table.column("n").to_numpy()], [table.column("radius").to_numpy()], [matrix(table.column("centre")).tobytes()]], schema=_PAGE)

    ddl = "speaker string, ball long, n long, radius double, centre array<double>, ids binary, matrix binary, sizes array<long>, radii array<double>, centres binary"
    return stored(held.join(at, ["speaker", "ball"]).groupBy("speaker", "page").applyInArrow(gather, ddl))


def wanted_pages(chosen: DataFrame, *more: Column) -> DataFrame:
    return chosen.groupBy("source", "target", "a").agg(F.collect_list("b").alias("bs"), *more)


def products(wanted: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(source, target, a, s_id, t_id, distance): each frame's best k of the pages in ``wanted`` (source, target, a, bs) that a task meets.

    A column ``limits`` of (s_id, limit) leaves out what is farther than a frame's limit. Pages meet
    by target and salt; within two pages, balls whose bounds rule them out are not multiplied.
    """
    parts = ["ids", "matrix", "sizes", "radii", "centres"]
    left = held.select(F.col("speaker").alias("source"), F.col("ball").alias("a"), *[F.col(c).alias(f"s_{c}") for c in parts])
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    right = held.select(F.col("speaker").alias("target"), every, F.col("ball").alias("b"), *[F.col(c).alias(f"t_{c}") for c in parts])
    dealt = wanted.join(left, ["source", "a"]).withColumn("salt", F.pmod("a", F.lit(SALTS)).cast("int"))
    met = dealt_to(dealt, "target", "salt").join(dealt_to(right, "target", "salt"), ["target", "salt"]).filter(F.array_contains("bs", F.col("b"))).drop("bs", "salt", "b")

    def bounds(batch: pa.RecordBatch, row: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a page's balls end, their radii and centres."""
        sizes, radii = (batch.column(f"{side}_{c}")[row].values.to_numpy() for c in ("sizes", "radii"))
        return np.append(0, np.cumsum(sizes)), radii, numbers(batch, f"{side}_centres", row).reshape(len(sizes), -1)

    def meet(near: Nearest, batch: pa.RecordBatch, row: int) -> None:
        (s_ends, s_radii, s_centres), (t_ends, t_radii, t_centres) = bounds(batch, row, "s"), bounds(batch, row, "t")
        ids = numbers(batch, "t_ids", row, np.int64)
        rows = unit(numbers(batch, "t_matrix", row).reshape(len(ids), -1))
        single = rows.astype(np.float32)
        gap, width = chords(s_centres, t_centres), s_radii[:, None] + t_radii[None]
        low, high, sizes = np.maximum(gap - width, 0) ** 2 / 2, np.minimum(gap + width, 2) ** 2 / 2, np.diff(t_ends)
        for i, (start, stop) in enumerate(zip(s_ends[:-1].tolist(), s_ends[1:].tolist())):
            order = np.argsort(high[i], kind="stable")
            first = np.zeros(len(order), bool)
            first[order[np.cumsum(sizes[order]) - sizes[order] < near.k]] = True
            for only in (first, ~first):
                on = only & (low[i] <= near.farthest(start, stop).max() + SLACK)
                if on.all():
                    near.meet(ids, rows, single, start, stop)
                elif on.any():
                    frames = np.repeat(on, sizes)
                    near.meet(ids[frames], rows[frames], single[frames], start, stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Nearest] = {}

        def told(key: tuple) -> pa.RecordBatch:
            columns = held.pop(key).columns()
            each = [pa.array([v] * len(columns[0]), t) for v, t in zip(key, (pa.string(), pa.string(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays([*each, *map(pa.array, columns)], names=["source", "target", "a", "s_id", "t_id", "distance"])

        for batch in batches:
            for row in range(batch.num_rows):
                key = tuple(batch.column(c)[row].as_py() for c in ("source", "target", "a"))
                if key not in held:
                    while held and sum(x.nbytes for x in held.values()) > OPEN_BYTES:
                        yield told(next(iter(held)))
                    ids = numbers(batch, "s_ids", row, np.int64)
                    held[key] = Nearest(ids, numbers(batch, "s_matrix", row).reshape(len(ids), -1), k)
                    if "limits" in batch.schema.names:
                        limits = batch.column("limits")[row].values
                        order = np.argsort(ids)
                        at = order[np.searchsorted(ids[order], limits.field("s_id").to_numpy())]
                        held[key].limit[at] = limits.field("limit").to_numpy() + SLACK
                meet(held[key], batch, row)
        for key in list(held):
            yield told(key)

    return met.mapInArrow(run, "source string, target string, a long, s_id long, t_id long, distance double")


def topk_pruned(frames: DataFrame, pairs: DataFrame, k: int, block: int = 256, pivots: int = 256, id_col: str = "frame_id", feat: str = "feat") -> DataFrame:
    """(source, target, s_id, t_id, distance, rank) for the frames of every (source, target): what ``matching.topk_blocks`` finds.

    Balls of ``block`` frames lie in pages, and pairs of pages are rows, not pairs of balls: how
    small balls are does not change how many rows meet. Frames without a direction (zero or not
    finite) match nothing; the least t_id wins a tie of ``DIGITS`` digits; a target of fewer than k
    frames gives all it has; no frames or no pairs give no rows.
    """
    held = pages(balls(frames, block, pivots, id_col, feat))
    chosen = stored(bounded_pairs(held, pairs, k).filter("near or seed").select("source", "target", "a", "b", "low", "seed"))
    first = stored(products(wanted_pages(chosen.filter("seed")), held, k))
    best = best_k(first, k)
    limit = F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf")))
    limits = best.groupBy("source", "target", "a", "s_id").agg(limit.alias("limit")).groupBy("source", "target", "a").agg(F.max("limit").alias("farthest"), F.collect_list(F.struct("s_id", "limit")).alias("limits"))
    limits = stored(limits)
    rest = chosen.filter("not seed").join(limits.drop("limits"), ["source", "target", "a"]).filter(F.col("low") <= F.col("farthest") + F.lit(SLACK))
    second = products(wanted_pages(rest).join(limits.drop("farthest"), ["source", "target", "a"]), held, k)
    return best_k(first.unionByName(second).drop("a"), k)
