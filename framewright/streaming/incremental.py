"""New utterances as a stream: moments are merged batch by batch, known maps are applied on the fly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.moments import merge_moments, pair_moments
from ..operators.project import project


def stream_moments(pairs: DataFrame, state_path: str, checkpoint: str, keys: Sequence[str] = ("source", "target"), available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch's moments below ``state_path``, one folder a batch.

    A folder is overwritten if its batch is retried, so every row counts once; read_moments()
    merges them.
    """

    def write(batch: DataFrame, number: int) -> None:
        pair_moments(batch, keys).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    writer = pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_moments(spark: SparkSession, state_path: str, keys: Sequence[str] = ("source", "target")) -> DataFrame:
    """Moments of all batches so far."""
    return merge_moments(spark.read.parquet(state_path).drop("batch"), keys)


def stream_projection(frames: DataFrame, maps: DataFrame, on: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Apply fixed maps to a stream of frames; a batch's folder is overwritten if the batch is retried."""

    def write(batch: DataFrame, number: int) -> None:
        project(batch, maps, on).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
