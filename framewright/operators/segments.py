"""Frames and labelled segments (J9), groups (A4-A6) and stratified samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import shuffled

#: Fixed value: samples a frame, 20 ms at 16 kHz.
FRAME_SAMPLES = 320


def frame_of(sample: Column, frame_samples: int = FRAME_SAMPLES) -> Column:
    """Frame that a sample offset of 0 or more lies in."""
    return F.floor(sample / F.lit(frame_samples)).cast("long")


def bounded(segments: DataFrame, drop: Sequence[str] = ("h#",), last_only: bool = False, phone: str = "phone") -> DataFrame:
    """Segments with start_frame and end_frame, without silence and empty ones.

    ``last_only`` keeps each (phone, speaker)'s last segment by (utt, start).
    """
    out = segments.filter(~F.col(phone).isin(*drop)) if drop else segments
    out = out.withColumns({"start_frame": frame_of(F.col("start_sample")), "end_frame": frame_of(F.col("end_sample"))}).filter("start_frame < end_frame")
    if last_only:
        order = Window.partitionBy(phone, "speaker").orderBy(F.desc("utt"), F.desc("start_sample"))
        out = out.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return out


def label_frames(frames: DataFrame, segments: DataFrame, on: Sequence[str] = ("speaker", "utt"), frame: str = "frame_idx") -> DataFrame:
    """Frames with the columns of the segments that hold them: start_frame <= frame < end_frame.

    A segment becomes one row a frame, so the range join is an equi join on (keys, frame) which
    no long utterance can skew.
    """
    rows = segments.withColumn(frame, F.explode(F.sequence("start_frame", F.col("end_frame") - 1)))
    return frames.join(rows, [*on, frame])


def smallest_group(grouped: DataFrame, by: Sequence[str], most: int = 100) -> DataFrame:
    """One row: sample_size, the least group size or ``most``."""
    return grouped.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.min("n"), F.lit(most).cast("long")).alias("sample_size"))


def stratified(rows: DataFrame, by: Sequence[str], n: int, seed: str, key: str) -> DataFrame:
    """``n`` rows of every group without replacement, in a seeded random order that any engine repeats."""
    order = Window.partitionBy(*by).orderBy(shuffled(seed, F.col(key)), key)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def first_groups(rows: DataFrame, group: str, order: str, n: int = 10) -> DataFrame:
    """Rows of the ``n`` groups that come first by their least ``order``."""
    first = rows.groupBy(group).agg(F.min(order).alias("_first")).orderBy("_first", group).limit(n)
    return rows.join(F.broadcast(first.select(group)), group, "left_semi")
