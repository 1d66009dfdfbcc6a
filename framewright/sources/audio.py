"""Audio scan and sink (S11, K9). PCM WAV and FLAC are decoded here; other formats by an injected decoder."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .files import write_files
from .flac import decode_flac

Decoder = Callable[[bytes], tuple[np.ndarray, int]]
AUDIO = "speaker string, utt string, path string, sr int, samples array<float>"


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1 to 1 and the rate; channels are averaged."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / (1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def decoded(data: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of WAV or FLAC bytes, whichever they are."""
    return decode_flac(data) if data[:4] == b"fLaC" else decode_wav(data)


def read_audio(spark: SparkSession, root: str, suffix: str = ".wav", decoder: Decoder = decoded) -> DataFrame:
    """(speaker, utt, path, sr, samples) of all files below ``root`` with the suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    rows = files.select(paths.parent_name(F.col("path")).alias("speaker"), paths.stem(F.col("path")).alias("utt"), "path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                samples, rate = decoder(r.content)
                yield pd.DataFrame({"speaker": [r.speaker], "utt": [r.utt], "path": [r.path], "sr": [rate], "samples": [samples]})

    return rows.mapInPandas(run, AUDIO)


def encoded(audio: DataFrame) -> DataFrame:
    """(path, content): WAV bytes of each row's samples, for a sink that writes files (K9)."""
    encode = F.pandas_udf(lambda s, r: pd.Series([encode_wav(np.asarray(x, np.float32), int(n)) for x, n in zip(s, r, strict=True)]), "binary")
    return audio.select("path", encode("samples", "sr").alias("content"))


def write_audio(audio: DataFrame, write: Callable[[str, bytes], None]) -> None:
    """Hand each file's path and WAV bytes to ``write`` on the executors (``files.to_folder`` for a mounted folder)."""
    write_files(encoded(audio), write)
