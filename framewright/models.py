"""Injected models (S12, M21-M23): what the plans ask of them, and deterministic stand-ins for tests.

A plan takes a factory and calls it once in each Python worker, so a model is loaded where it
runs and never pickled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Featurizer(Protocol):
    def __call__(self, samples: np.ndarray, rate: int) -> np.ndarray:
        """(frames, width) features of one utterance."""


class Vocoder(Protocol):
    def __call__(self, feats: np.ndarray) -> np.ndarray:
        """Samples of (frames, width) features."""


class Recogniser(Protocol):
    def __call__(self, samples: np.ndarray, rate: int) -> str:
        """Transcript of one utterance."""


class Embedder(Protocol):
    def __call__(self, samples: np.ndarray, rate: int) -> np.ndarray:
        """Speaker vector of one utterance."""


class PlaneFitter(Protocol):
    def fit_transform(self, vectors: np.ndarray) -> np.ndarray:
        """(points, 2) coordinates of (points, width) vectors."""


@functools.cache
def _loaded(factory: Callable):
    return factory()


def featurize(audio: DataFrame, factory: Callable[[], Featurizer]) -> DataFrame:
    """(speaker, utt, frame_idx, feat) of (speaker, utt, sr, samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(factory)
        for batch in batches:
            for r in batch.itertuples():
                feats = np.asarray(model(np.asarray(r.samples, np.float32), int(r.sr)), np.float32)
                if len(feats):
                    yield pd.DataFrame({"speaker": r.speaker, "utt": r.utt, "frame_idx": np.arange(len(feats)), "feat": list(feats)})

    return audio.mapInPandas(run, "speaker string, utt string, frame_idx long, feat array<float>")


def vocode(frames: DataFrame, factory: Callable[[], Vocoder], feat: str = "feat", rate: int = 16_000) -> DataFrame:
    """(speaker, utt, sr, samples) of frames; an utterance is the unit, as its order matters."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx")
        samples = _loaded(factory)(np.vstack(rows["feat"].to_list()))
        return pd.DataFrame({"speaker": [key[0]], "utt": [key[1]], "sr": [rate], "samples": [np.asarray(samples, np.float32)]})

    picked = frames.select("speaker", "utt", "frame_idx", frames[feat].alias("feat"))
    return picked.groupBy("speaker", "utt").applyInPandas(run, "speaker string, utt string, sr int, samples array<float>")


def recognise(audio: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """(speaker, utt, hypothesis) of audio."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(factory)
        for batch in batches:
            said = [model(np.asarray(s, np.float32), int(r)) for s, r in zip(batch["samples"], batch["sr"], strict=True)]
            yield pd.DataFrame({"speaker": batch["speaker"], "utt": batch["utt"], "hypothesis": said})

    return audio.mapInPandas(run, "speaker string, utt string, hypothesis string")


def embed(audio: DataFrame, factory: Callable[[], Embedder]) -> DataFrame:
    """(speaker, utt, embedding) of audio."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(factory)
        for batch in batches:
            found = [np.asarray(model(np.asarray(s, np.float32), int(r)), np.float32) for s, r in zip(batch["samples"], batch["sr"], strict=True)]
            yield pd.DataFrame({"speaker": batch["speaker"], "utt": batch["utt"], "embedding": found})

    return audio.mapInPandas(run, "speaker string, utt string, embedding array<float>")


def parameter_count(model) -> int:
    """Trainable parameters of a model with ``parameters()``."""
    return sum(int(np.prod(p.shape)) for p in model.parameters() if getattr(p, "requires_grad", True))


def plane(vectors: DataFrame, factory: Callable[[], PlaneFitter], bound: int = 20_000, key: str = "frame_id", feat: str = "feat") -> DataFrame:
    """(key, x, y): coordinates in the plane of at most ``bound`` vectors, the first by a hash of their key.

    Such methods place all points together, so they run on the driver, on a sample made for a plot.
    """
    rows = vectors.orderBy(F.xxhash64(key), key).limit(bound).select(key, feat).collect()
    if not rows:
        return vectors.sparkSession.createDataFrame([], f"{key} {vectors.schema[key].dataType.simpleString()}, x double, y double")
    found = np.asarray(factory().fit_transform(np.array([r[feat] for r in rows], np.float64)), float)
    return vectors.sparkSession.createDataFrame([(r[key], float(a), float(b)) for r, (a, b) in zip(rows, found, strict=True)], f"{key} {vectors.schema[key].dataType.simpleString()}, x double, y double")


class PlanePca:
    """Stand-in: the two leading principal coordinates."""

    def fit_transform(self, vectors: np.ndarray) -> np.ndarray:
        centred = vectors - vectors.mean(axis=0)
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        axes = np.vstack([axes, np.zeros((2, vectors.shape[1]))])[:2]
        return centred @ axes.T


class LengthRecogniser:
    """Stand-in: says how long an utterance is."""

    def __call__(self, samples: np.ndarray, rate: int) -> str:
        return f"{len(samples)} at {rate}"


class BandEmbedder:
    """Stand-in: mean log band energies."""

    def __call__(self, samples: np.ndarray, rate: int) -> np.ndarray:
        feats = BandFeaturizer()(samples, rate)
        return feats.mean(axis=0) if len(feats) else np.zeros(8)


class BandFeaturizer:
    """Stand-in: log band energies of 20 ms windows."""

    def __init__(self, width: int = 8) -> None:
        self.width = width

    def __call__(self, samples: np.ndarray, rate: int) -> np.ndarray:
        size = rate // 50
        n = len(samples) // size
        power = np.abs(np.fft.rfft(np.asarray(samples[: n * size]).reshape(n, size), axis=1)) ** 2
        return np.log1p(np.stack([b.sum(axis=1) for b in np.array_split(power, self.width, axis=1)], axis=1)) if n else np.zeros((0, self.width))


class ToneVocoder:
    """Stand-in: 320 samples a frame, as loud as its mean feature."""

    def __call__(self, feats: np.ndarray) -> np.ndarray:
        return (np.tanh(feats.mean(axis=1))[:, None] * np.sin(np.arange(320) / 5)).ravel()
