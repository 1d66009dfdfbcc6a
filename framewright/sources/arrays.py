"""Vector tables and array files (S9, S10; K1-K5, K7, K8)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .files import write_files

FRAMES = "speaker string, utt string, frame_idx long, feat array<float>"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames written by write_frames; speakers are partitions, so a speaker's scan reads only its files."""
    return spark.read.parquet(path)


def write_frames(frames: DataFrame, path: str, mode: str = "speakers") -> None:
    """Frames by speaker, or by speaker and utterance (K1, K2)."""
    keys = {"speakers": ["speaker"], "utterances": ["speaker", "utt"]}[mode]
    frames.repartition(*keys).sortWithinPartitions(*keys, "utt" if mode == "speakers" else "frame_idx", "frame_idx").write.partitionBy(*keys).parquet(path)


def half_rounded(frames: DataFrame, feat: str = "feat") -> DataFrame:
    """Vectors rounded to half precision, as archives of speakers hold them."""
    half = F.pandas_udf(lambda s: s.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32)), "array<float>")
    return frames.withColumn(feat, half(F.col(feat)))


def import_npy(spark: SparkSession, root: str) -> DataFrame:
    """Frames of ``<speaker>/<utt>.npy`` or ``<speaker>.npy`` matrices; pickled content is refused.

    A file is decoded where it is read and comes out row by row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root)
    rows = files.select(paths.parent_name(F.col("path")).alias("speaker"), paths.stem(F.col("path")).alias("utt"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                matrix = np.atleast_2d(np.load(io.BytesIO(r.content), allow_pickle=False)).astype(np.float32)
                for i in range(0, len(matrix), 4096):
                    part = matrix[i : i + 4096]
                    yield pd.DataFrame({"speaker": r.speaker, "utt": r.utt, "frame_idx": np.arange(i, i + len(part)), "feat": list(part)})

    return rows.mapInPandas(run, FRAMES)


def import_npz(spark: SparkSession, root: str) -> DataFrame:
    """(path, key, shape, values) of every array of ``.npz`` archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                with zipfile.ZipFile(io.BytesIO(r.content)) as archive:
                    for entry in archive.namelist():
                        value = np.load(io.BytesIO(archive.read(entry)), allow_pickle=False).astype(np.float64)
                        yield pd.DataFrame({"path": [r.path], "key": [entry.removesuffix(".npy")], "shape": [list(value.shape)], "values": [value.ravel()]})

    return files.select("path", "content").mapInPandas(run, "path string, key string, shape array<long>, values array<double>")


def write_table(table: DataFrame, path: str, *keys: str) -> None:
    """Maps, bases, content codes or phone groups (K3-K5, K7, K8), by key if one is given."""
    (table.write.partitionBy(*keys) if keys else table.write).parquet(path)


def write_evaluation(pairs: DataFrame, path: str) -> None:
    """Evaluation pairs as CSV with a header."""
    pairs.write.csv(path, header=True)


def as_npy(value: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, value, allow_pickle=False)
    return out.getvalue()


def export_npy(frames: DataFrame, write: Callable[[str, bytes], None], mode: str = "speakers", half: bool = False, feat: str = "feat") -> None:
    """Matrices ``<speaker>.npy``, or ``<speaker>/<utt>.npy`` (K1, K2), in the order of utterance and frame.

    An executor holds one file's matrix at a time; ``half`` stores half precision.
    """
    keys = {"speakers": ["speaker"], "utterances": ["speaker", "utt"]}[mode]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["utt", "frame_idx"])
        matrix = np.stack([np.asarray(x, np.float16 if half else np.float32) for x in rows["feat"]])
        return pd.DataFrame({"path": ["/".join(key) + ".npy"], "content": [as_npy(matrix)]})

    picked = frames.select("speaker", "utt", "frame_idx", F.col(feat).alias("feat"))
    write_files(picked.groupBy(*keys).applyInPandas(run, "path string, content binary"), write)


def export_npz(maps: DataFrame, path: str, part: str = "w", keys: tuple[str, ...] = ("source", "target")) -> int:
    """One compressed archive on the driver's file system of a column of all maps, by ``source-target`` (K6); how many.

    Maps come to the driver one partition at a time and go straight into the archive. Null parts are left out.
    """
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for r in maps.filter(F.col(part).isNotNull()).select(*keys, part).orderBy(*keys).toLocalIterator():
            archive.writestr("-".join(r[k] for k in keys) + ".npy", as_npy(np.array(r[part], np.float32)))
            n += 1
    return n
