"""Data sources that read array and audio files in ranges, and sinks that commit.

Readers plan from file sizes alone: a large file is many tasks, each of which reads the header and
its own range. Sinks write into a hidden folder beside the target; the files appear when all
tasks have ended, and a failed job leaves nothing behind. A task that runs again writes the same
bytes to the same place. Reading goes through any file system that Arrow knows; sinks need a
folder that all executors mount, as ranges of one file are written by many of them.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..arrow import matrix, vectors
from ..operators.frames import numbered
from ..operators.signal import CHUNKS

FRAMES = "speaker string, utt string, frame_idx long, feat array<float>"
BATCH_BYTES = 4 << 20


@dataclass
class Range(InputPartition):
    """Part ``part`` of ``parts`` of a file."""

    path: str
    part: int
    parts: int


def listed(root: str, suffix: str, part_bytes: int) -> list[Range]:
    """Ranges of all files below ``root`` with the suffix, in order."""
    if "://" not in root and not root.startswith("file:"):
        root = os.path.abspath(root)
    system, base = pafs.FileSystem.from_uri(root)
    info = system.get_file_info(base)
    found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(base, recursive=True))
    files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix) and not any(p.startswith((".", "_")) for p in f.path[len(base) :].split("/")[:-1]))
    return [Range(path, k, n) for path, size in files for n in [max(1, -(-size // part_bytes))] for k in range(n)]


def opened(root: str, path: str) -> pa.NativeFile:
    if "://" not in root and not root.startswith("file:"):
        root = os.path.abspath(root)
    return pafs.FileSystem.from_uri(root)[0].open_input_file(path)


def names(path: str) -> tuple[str, str]:
    """Speaker and utterance: the folder that a file is in, and its name without the last suffix."""
    folder, _, name = path.rpartition("/")
    return folder.rpartition("/")[2], name.rpartition(".")[0]


# ---------------------------------------------------------------- arrays


def npy_header(file: pa.NativeFile) -> tuple[int, np.dtype, tuple[int, ...]]:
    """Offset of the data, type and shape of a ``.npy`` file; objects (pickles) and column order are refused."""
    version = np.lib.format.read_magic(file)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"version {version} of the array format")
    shape, columns, dtype = read(file)
    if dtype.hasobject:
        raise ValueError("an array of objects would have to be unpickled")
    if columns and len(shape) > 1:
        raise ValueError("an array in column order has no ranges of rows")
    return file.tell(), dtype, shape


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.part_bytes = options["path"], int(options.get("partBytes", 64 << 20))

    def partitions(self) -> list[Range]:
        return listed(self.root, ".npy", self.part_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        speaker, utt = names(partition.path)
        with opened(self.root, partition.path) as file:
            offset, dtype, shape = npy_header(file)
            rows, width = (shape[0], int(np.prod(shape[1:]))) if len(shape) > 1 else (1, int(np.prod(shape)))
            first, last = (rows * k // partition.parts for k in (partition.part, partition.part + 1))
            step = max(1, BATCH_BYTES // max(1, width * 4))
            for i in range(first, last, step):
                n = min(step, last - i)
                file.seek(offset + i * width * dtype.itemsize)
                x = np.frombuffer(file.read(n * width * dtype.itemsize), dtype).reshape(n, width)
                feat = vectors(x.astype(np.float64)).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([speaker] * n), pa.array([utt] * n), pa.array(np.arange(i, i + n)), feat], names=["speaker", "utt", "frame_idx", "feat"])


@dataclass
class Done(WriterCommitMessage):
    rows: int


class Folder:
    """A hidden folder beside the files that a job writes, which become visible together."""

    def __init__(self, root: str, job: str) -> None:
        self.root = Path(root.removeprefix("file://").removeprefix("file:"))
        self.hidden = self.root / f"_writing-{job}"
        self.hidden.mkdir(parents=True)

    def place(self, path: str) -> Path:
        target = Path(os.path.normpath(path))
        if target.is_absolute() or ".." in target.parts or not target.name:
            raise ValueError(f"{path} is no path below {self.root}")
        for folder in [*target.parents][-2::-1]:  # not the hidden folder itself: a task that outlives its job must fail
            with contextlib.suppress(FileExistsError):
                (self.hidden / folder).mkdir()
        return self.hidden / target

    def publish(self) -> None:
        files = [p for p in self.hidden.rglob("*") if p.is_file()]

        def move(p: Path) -> None:
            target = self.root / p.relative_to(self.hidden)
            target.parent.mkdir(parents=True, exist_ok=True)
            os.replace(p, target)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, files))
        self.discard()

    def discard(self) -> None:
        """Out of reach of tasks that still run first, then away."""
        gone = self.hidden.with_name(f"{self.hidden.name}-gone")
        with contextlib.suppress(FileNotFoundError):
            self.hidden.rename(gone)
            shutil.rmtree(gone)


class NpyWriter(DataSourceArrowWriter):
    """Rows (path, row, rows, feat): row ``row`` of the ``rows`` of a file's matrix."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.dtype = Folder(options["path"], uuid.uuid4().hex), np.dtype(options.get("dtype", "float32"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        done, path, handle, offset = 0, None, None, 0
        try:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                files, place, totals = table.column("path").to_pylist(), table.column("row").to_numpy(), table.column("rows").to_pylist()
                x = matrix(table.column("feat")).astype(self.dtype)
                bounds = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1] or place[i] != place[i - 1] + 1), len(files)] if files else [0]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    if files[a] != path:
                        if handle is not None:
                            os.close(handle)
                        path, head = files[a], npy_head(self.dtype, (totals[a], x.shape[1]))
                        handle, offset = os.open(self.folder.place(path), os.O_CREAT | os.O_WRONLY, 0o644), len(head)
                        os.pwrite(handle, head, 0)
                    pwrite_all(handle, x[a:b].tobytes(), offset + int(place[a]) * x.shape[1] * self.dtype.itemsize)
                done += len(files)
        finally:
            if handle is not None:
                os.close(handle)
        return Done(done)

    def commit(self, messages: list[Done | None]) -> None:
        self.folder.publish()

    def abort(self, messages: list[Done | None]) -> None:
        self.folder.discard()


def npy_head(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    out = pa.BufferOutputStream()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})
    return out.getvalue().to_pybytes()


def pwrite_all(handle: int, data: bytes, offset: int) -> None:
    view = memoryview(data)
    while view:
        n = os.pwrite(handle, view, offset)
        view, offset = view[n:], offset + n


class NpySource(DataSource):
    """Format ``npy``: frames of ``<speaker>/<utt>.npy`` matrices in ranges of rows, and the sink of ``save_npy``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


def load_npy(spark: SparkSession, root: str, part_bytes: int = 64 << 20) -> DataFrame:
    """Frames (speaker, utt, frame_idx, feat) of all ``.npy`` files below ``root``, a file of any size in tasks of ``part_bytes``."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("partBytes", part_bytes).load(root)


def save_npy(frames: DataFrame, root: str, mode: str = "speakers", half: bool = False, feat: str = "feat") -> None:
    """Matrices ``<speaker>.npy`` or ``<speaker>/<utt>.npy`` in the order of utterance and frame, each written in ranges by many tasks (K1, K2)."""
    keys = {"speakers": ["speaker"], "utterances": ["speaker", "utt"]}[mode]
    frames.sparkSession.dataSource.register(NpySource)
    placed = numbered(frames.select("speaker", "utt", "frame_idx", F.col(feat).alias("feat")), "speaker", "utt", "frame_idx", name="at")
    starts = placed.groupBy(*keys).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    rows = placed.join(starts, keys).select(F.concat(F.concat_ws("/", *keys), F.lit(".npy")).alias("path"), (F.col("at") - F.col("first")).alias("row"), "rows", F.col("feat").cast("array<double>").alias("feat"))
    rows.sortWithinPartitions("path", "row").write.format("npy").option("dtype", "float16" if half else "float32").mode("append").save(root)


# ---------------------------------------------------------------- whole files


class FileWriter(DataSourceArrowWriter):
    """Rows (path, content): a file each."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options["path"], uuid.uuid4().hex)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        done = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = self.folder.place(path)
                part = target.with_name(f"{target.name}.{uuid.uuid4().hex}")
                part.write_bytes(content)
                os.replace(part, target)
                done += 1
        return Done(done)

    def commit(self, messages: list[Done | None]) -> None:
        self.folder.publish()

    def abort(self, messages: list[Done | None]) -> None:
        self.folder.discard()


class FileSink(DataSource):
    """Format ``file_rows``: writes rows (path, content) as files below its path."""

    @classmethod
    def name(cls) -> str:
        return "file_rows"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def save_files(files: DataFrame, root: str) -> None:
    """Files of rows (path, content) below ``root``: all of them, or none if the job fails (K9 with ``audio.encoded``)."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("path", "content").write.format("file_rows").mode("append").save(root)


# ---------------------------------------------------------------- audio


def wav_header(file: pa.NativeFile, path: str) -> tuple[int, int, int, int, int]:
    """(offset of the samples, samples, channels, bytes a sample, rate) of a PCM WAV file."""
    riff = file.read(12)
    if riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
        raise ValueError(f"{path} is no WAV file")
    form = None
    while len(head := file.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            body = file.read(size + size % 2)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE:  # the extended form names its kind in its last field
                kind = struct.unpack("<H", body[24:26])[0]
            if kind != 1 or bits not in (8, 16, 24, 32):
                raise ValueError(f"{path}: only PCM of 8 to 32 bits is read in ranges")
            form = channels, bits // 8, rate
        elif name == b"data":
            if form is None:
                break
            channels, width, rate = form
            return file.tell(), min(size, file.size() - file.tell()) // (channels * width), channels, width, rate
        else:
            file.seek(file.tell() + size + size % 2)
    raise ValueError(f"{path} has no samples")


def pcm(raw: bytes, channels: int, width: int) -> np.ndarray:
    """Samples in -1 to 1, channels averaged."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / (1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1)


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.size, self.overlap = int(options.get("chunkSamples", 1 << 20)), int(options.get("overlap", 4096))
        self.part_bytes = int(options.get("partBytes", 64 << 20))

    def partitions(self) -> list[Range]:
        return listed(self.root, ".wav", self.part_bytes)

    def read(self, partition: Range) -> Iterator[tuple]:
        speaker, utt = names(partition.path)
        with opened(self.root, partition.path) as file:
            offset, total, channels, width, rate = wav_header(file, partition.path)
            chunks = -(-total // self.size)
            for chunk in range(chunks * partition.part // partition.parts, chunks * (partition.part + 1) // partition.parts):
                start, end = chunk * self.size, min((chunk + 1) * self.size, total)
                begin, stop = max(0, start - self.overlap), min(total, end + self.overlap)
                file.seek(offset + begin * channels * width)
                x = pcm(file.read((stop - begin) * channels * width), channels, width)
                yield speaker, utt, partition.path, rate, total, chunk, start, start - begin, end - start, x.tolist()


class WavSource(DataSource):
    """Format ``wav_chunks``: PCM WAV files in overlapping chunks."""

    @classmethod
    def name(cls) -> str:
        return "wav_chunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def load_chunks(spark: SparkSession, root: str, chunk_samples: int = 1 << 20, overlap: int = 4096, part_bytes: int = 64 << 20) -> DataFrame:
    """Chunks of all ``.wav`` files below ``root``, as ``signal.resampled_chunks`` takes them; a recording of hours is many tasks."""
    spark.dataSource.register(WavSource)
    reader = spark.read.format("wav_chunks").option("chunkSamples", chunk_samples).option("overlap", overlap).option("partBytes", part_bytes)
    return reader.load(root)
