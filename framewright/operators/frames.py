"""Frames: one row (speaker, utt, frame_idx, feat) per feature vector."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import stored

ORDER = ("utt", "frame_idx")


def exclude(frames: DataFrame, listed: DataFrame, on: str = "utt") -> DataFrame:
    """Rows whose key is not listed."""
    return frames.join(listed.select(on).distinct(), on, "left_anti")


def keep(frames: DataFrame, listed: DataFrame, on: str = "speaker") -> DataFrame:
    """Rows whose key is listed."""
    return frames.join(listed.select(on).distinct(), on, "left_semi")


def ranked(frames: DataFrame, by: Sequence[str] = ("speaker",), order: Sequence[str] = ORDER, name: str = "spk_frame_idx") -> DataFrame:
    """Place of each frame in its speaker's stack, from 0."""
    return frames.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def cap(frames: DataFrame, n: int | None, by: Sequence[str] = ("speaker",), order: Sequence[str] = ORDER) -> DataFrame:
    """The first ``n`` frames of each speaker's stack (P8), without ranking frames.

    ``order`` is (utterance, frame). Frames are counted by utterance first, which reads no vectors;
    running sums over a speaker's utterances find those that lie within the cap and the one that
    crosses it. Only the frames of the latter are ranked, and all others are dropped by a semi join
    before anything moves.
    """
    if n is None:
        return frames
    utt, frame = order
    sizes = frames.groupBy(*by, utt).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy(utt).rowsBetween(Window.unboundedPreceding, -1)
    kept = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0).cast("long"))).filter(F.col("_before") < n)
    same = reduce(and_, [F.col(f"f.{k}").eqNullSafe(F.col(f"k.{k}")) for k in [*by, utt]])
    whole, crossed = kept.filter(F.col("_before") + F.col("_n") <= n), kept.filter(F.col("_before") + F.col("_n") > n)
    inside = frames.alias("f").join(whole.alias("k"), same, "left_semi")
    place = F.row_number().over(Window.partitionBy(*by, utt).orderBy(frame))
    columns = [F.col(f"f.`{c}`") for c in frames.columns]
    edge = frames.alias("f").join(crossed.alias("k"), same).select(*columns, "_before").withColumn("_place", place)
    return inside.unionByName(edge.filter(F.col("_before") + F.col("_place") <= n).drop("_before", "_place"))


def stacked(frames: DataFrame, by: Sequence[str] = ("speaker",), order: Sequence[str] = ORDER, feat: str = "feat") -> DataFrame:
    """One ordered matrix per key (A1), for consumers that need one; group sizes must be capped."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(feat).alias("feat"))))
    return frames.groupBy(*by).agg(F.transform(rows, lambda r: r["feat"]).alias("matrix"))


def mean_by_position(frames: DataFrame, by: Sequence[str], feat: str = "feat", name: str = "mean") -> DataFrame:
    """Mean of each dimension, in long form (A3): partial sums by (key, pos) before the shuffle."""
    return frames.select(*by, F.posexplode(feat).alias("pos", "value")).groupBy(*by, "pos").agg(F.avg(F.col("value").cast("double")).alias(name))


def standardised(frames: DataFrame, by: Sequence[str], feat: str = "feat") -> DataFrame:
    """Each dimension less its mean, over its population deviation; constant ones only centred.

    Sums are made by (key, pos) before the shuffle; what meets the frames is one row of statistics a
    key, and vectors become one row a dimension only in the result.
    """
    value = F.col("value").cast("double")
    sums = frames.select(*by, F.posexplode(feat).alias("pos", "value")).groupBy(*by, "pos").agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
    scale = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    stats = wide(sums, by, value=F.struct("mu", scale.alias("sd")), name="_stats")
    scaled = F.zip_with(feat, "_stats", lambda x, s: F.struct(x.alias("value"), ((x.cast("double") - s["mu"]) / s["sd"]).alias("scaled")))
    rest = [c for c in frames.columns if c != feat]
    return frames.join(stats, list(by)).select(*rest, F.posexplode(scaled).alias("pos", "_cell")).select(*rest, "pos", "_cell.value", "_cell.scaled")


def frame_count(frames: DataFrame, by: Sequence[str], hop_seconds: float = 0.02) -> DataFrame:
    """Mean number of frames a key and its duration."""
    counts = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.avg("n").alias("mean_frames"), (F.avg("n") * hop_seconds).alias("mean_seconds"))


def wide(long: DataFrame, by: Sequence[str], pos: str = "pos", value: Column | str = "value", name: str = "feat") -> DataFrame:
    """Vectors again from (key, pos, value)."""
    value = F.col(value) if isinstance(value, str) else value
    rows = F.sort_array(F.collect_list(F.struct(F.col(pos), value.alias("value"))))
    return long.groupBy(*by).agg(F.transform(rows, lambda r: r["value"]).alias(name))


def numbered(rows: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Rows with their place from 0 in a total order (T1), without one task that sorts all.

    Rows are sorted by range and stored; a row's place is that in its partition plus the sizes of
    the partitions before, of which there are as many numbers as partitions. Ties must not be.
    The sort works every column out, so number keys and join what is costly.
    """
    inner = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_inner": inner})
    placed, offsets, total = stored(placed), {}, 0
    for part, n in sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect()):
        offsets[part], total = total, total + n
    table = rows.sparkSession.createDataFrame(list(offsets.items()), "_part int, _offset long")
    return placed.join(F.broadcast(table), "_part").withColumn(name, F.col("_inner") + F.col("_offset")).drop("_part", "_inner", "_offset")
