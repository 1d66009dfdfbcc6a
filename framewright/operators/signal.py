"""Signal operators: resampling, leading silence, hours, spectrogram data."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Zero crossings of the resampling filter on each side.
ZEROS = 16


@dataclass(frozen=True)
class Bank:
    """A windowed sinc for every phase that a rational change of rate has, so that any stretch of the output can be made by itself."""

    rate: int
    new_rate: int
    zeros: int = ZEROS

    def __post_init__(self) -> None:
        common = math.gcd(self.rate, self.new_rate)
        up, down = self.new_rate // common, self.rate // common
        cut = min(1.0, up / down)
        half = math.ceil(self.zeros / cut)
        d = np.arange(up)[:, None] / up - np.arange(-half, half + 1)
        taps = cut * np.sinc(cut * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / (half + 1), -1, 1)))
        for name, value in (("up", up), ("down", down), ("half", half), ("taps", taps)):
            object.__setattr__(self, name, value)

    def length(self, n: int) -> int:
        """Output samples of ``n`` input samples; also the first output at or after input sample ``n``."""
        return -(-n * self.up // self.down)

    def span(self, x: np.ndarray, at: int, first: int, last: int) -> np.ndarray:
        """Outputs ``first`` to ``last`` (exclusive) from samples ``x`` that begin at input sample ``at``; what lies outside counts as zero."""
        out = np.empty(max(0, last - first), np.float64)
        padded = np.pad(np.asarray(x, np.float64), self.half + 1)
        for i in range(0, len(out), 1 << 14):
            n = np.arange(first + i, min(first + i + (1 << 14), last), dtype=np.int64)
            near, phase = n * self.down // self.up, n * self.down % self.up
            rows = near[:, None] - at + self.half + 1 + np.arange(-self.half, self.half + 1)
            out[i : i + len(n)] = (padded[np.clip(rows, 0, len(padded) - 1)] * self.taps[phase]).sum(axis=1)
        return out.astype(np.float32)


def resample(x: np.ndarray, rate: int, new_rate: int, zeros: int = ZEROS) -> np.ndarray:
    """Band-limited resampling by a windowed sinc."""
    if rate == new_rate or not len(x):
        return np.asarray(x, np.float32)
    bank = Bank(rate, new_rate, zeros)
    return bank.span(x, 0, 0, bank.length(len(x)))


def energy_trim(x: np.ndarray, rate: int, level: float = 1e-3, window: float = 0.02) -> np.ndarray:
    """Samples from the first window on whose energy reaches the level; none if there is no such window."""
    size = max(1, int(rate * window))
    loud = np.flatnonzero([np.sqrt(np.mean(np.square(x[i : i + size], dtype=np.float64))) >= level for i in range(0, len(x), size)])
    return x[loud[0] * size :] if len(loud) else x[:0]


@dataclass(frozen=True)
class Voice:
    """Where speech begins, by how far bands of a signal rise above their noise floors.

    Every ``hop`` seconds the power of each band is smoothed over ``smooth`` seconds. Its floor is
    the mean over the first ``boot`` seconds, then follows upwards within ``rise`` seconds and
    downwards within ``fall``. The measure of a hop is the mean excess in dB of the quarter of the
    bands that stand out most, and its own mean over ``trigger`` seconds sets off at ``level``. From there the start is searched back by at
    most ``search`` seconds, over gaps of up to ``gap`` seconds in which the measure is under half the
    level, and lies ``pre`` seconds earlier. A signal that never sets off has no speech.
    """

    hop: float = 0.01
    bands: int = 8
    low: float = 50.0
    high: float = 6000.0
    smooth: float = 0.05
    boot: float = 0.1
    rise: float = 2.0
    fall: float = 0.05
    trigger: float = 0.1
    level: float = 7.0
    search: float = 1.0
    gap: float = 0.25
    pre: float = 0.0
    quiet: float = 1e-10

    def size(self, rate: int) -> int:
        return max(1, round(self.hop * rate))

    def powers(self, x: np.ndarray, rate: int) -> np.ndarray:
        """(hops, bands) of whole hops of ``x``; with one band the mean square, else sums of a Hann window's spectrum between logarithmic bounds."""
        size = self.size(rate)
        rows = np.asarray(x[: len(x) // size * size], np.float64).reshape(-1, size)
        if self.bands == 1:
            return np.square(rows).mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(rows * np.hanning(size + 1)[:-1], axis=1)) ** 2 / size**2
        high = min(self.high, rate / 2)
        bounds = np.geomspace(min(self.low, high / 2), high, self.bands + 1) * size / rate
        starts = np.minimum(np.maximum(np.round(bounds[:-1]).astype(int), np.arange(1, self.bands + 1)), power.shape[1] - 1)
        return np.stack([power[:, a : max(a + 1, b)].sum(axis=1) for a, b in zip(starts, np.append(starts[1:], power.shape[1]), strict=True)], axis=1)

    def start(self, powers: np.ndarray) -> int | None:
        """The hop that speech begins in, or None. Reading stops where the trigger sets off."""
        keep = lambda seconds: math.exp(-self.hop / seconds) if seconds > 0 else 0.0
        smooth, rise, fall, slow = map(keep, (self.smooth, self.rise, self.fall, self.trigger))
        boot, level, measures = max(1, round(self.boot / self.hop)), 0.0, []
        power = floor = None
        most = -(-self.bands // 4)
        for i, now in enumerate(powers):
            now = now + self.quiet
            power = now if power is None else smooth * power + (1 - smooth) * now
            if i < boot:
                floor = now if floor is None else floor + (now - floor) / (i + 1)
            else:
                share = np.where(power > floor, rise, fall)
                floor = share * floor + (1 - share) * power
            above = np.sort(np.maximum(10 * np.log10(power / floor), 0))
            measures.append(float(above[-most:].mean()))
            level = slow * level + (1 - slow) * measures[-1]
            if level >= self.level:
                return self.searched(measures)
        return None

    def searched(self, measures: list[float]) -> int:
        """From the last hop back to the start of its stretch."""
        start, quiet = len(measures) - 1, 0
        for i in range(len(measures) - 1, max(-1, len(measures) - 1 - round(self.search / self.hop)), -1):
            if measures[i] >= self.level / 2:
                start, quiet = i, 0
            else:
                quiet += 1
                if quiet > round(self.gap / self.hop):
                    break
        return max(0, start - round(self.pre / self.hop))

    def __call__(self, x: np.ndarray, rate: int) -> np.ndarray:
        """The samples from where speech begins; none if it never does."""
        first = self.start(self.powers(x, rate))
        return x[:0] if first is None else x[first * self.size(rate) :]


voice_trim = Voice()


def prepared(audio: DataFrame, sample_rate: int = 16_000, trim: Callable[[np.ndarray, int], np.ndarray] | None = voice_trim) -> DataFrame:
    """Audio at one rate, each file from its own, with leading silence cut by an injectable detector."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in audio.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = [resample(np.asarray(s, np.float32), int(r), sample_rate) for s, r in zip(batch["samples"], batch["sr"], strict=True)]
            yield batch.assign(samples=[trim(x, sample_rate) if trim else x for x in new], sr=sample_rate)

    return audio.mapInPandas(run, ddl)


#: Long recordings: a row a chunk. ``samples`` begin ``lead`` before ``start``, own ``own`` from there on, and end with what the next chunk begins with.
CHUNKS = "speaker string, utt string, path string, sr int, total long, chunk long, start long, lead int, own int, samples array<float>"
PREPARED = "speaker string, utt string, path string, sr int, total long, chunk long, start long, samples array<float>, first_hop long, powers array<array<double>>"


def resampled_chunks(chunks: DataFrame, sample_rate: int = 16_000, voice: Voice = voice_trim) -> DataFrame:
    """(speaker, utt, path, sr, total, chunk, start, samples, first_hop, powers): each chunk's stretch of the whole recording at the new rate, and the powers of the hops that begin in it.

    A chunk needs nothing but its own row: its overlaps must hold the filter and one hop, else ValueError.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                bank, x, begin = Bank(int(r.sr), sample_rate), np.asarray(r.samples, np.float32), r.start - r.lead
                size, total = voice.size(sample_rate), Bank(int(r.sr), sample_rate).length(r.total)
                first, last = bank.length(r.start), bank.length(r.start + r.own)
                hops = range(-(-first // size), -(-last // size))
                end = max(last, min(total, hops[-1] * size + size)) if hops else last
                if (begin > 0 and r.lead < bank.half + 2) or (begin + len(x) < r.total and begin + len(x) < end * bank.down // bank.up + bank.half + 2):
                    raise ValueError(f"{r.path}: overlaps of {r.lead} samples are too short for {r.sr} to {sample_rate}")
                y = bank.span(x, begin, first, end)
                whole = y[hops[0] * size - first :] if hops else y[:0]
                powers = voice.powers(whole, sample_rate)
                yield pd.DataFrame({"speaker": [r.speaker], "utt": [r.utt], "path": [r.path], "sr": [sample_rate], "total": [total], "chunk": [r.chunk], "start": [first], "samples": [y[: last - first]], "first_hop": [hops[0] if hops else 0], "powers": [powers.tolist()]})

    return chunks.mapInPandas(run, PREPARED)


def trimmed_chunks(prepared: DataFrame, voice: Voice = voice_trim, keys: Sequence[str] = ("speaker", "utt", "path")) -> DataFrame:
    """(keys, sr, total, chunk, start, samples) from where speech begins; ``start`` and ``total`` count from there, and a recording without speech goes.

    Only the powers, a few numbers a hop, meet in one task for each recording; samples stay where they are.
    """
    keys = list(keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        parts = [np.asarray([list(p) for p in x], float).reshape(-1, voice.bands) for x in rows["powers"]]
        first = voice.start(np.concatenate(parts))
        return rows[keys].iloc[:1].assign(begin=[None if first is None else first * voice.size(int(rows["sr"].iloc[0]))])

    ddl = ", ".join(f"`{k}` {prepared.schema[k].dataType.simpleString()}" for k in keys)
    begins = prepared.select(*keys, "sr", "chunk", "powers").groupBy(*keys).applyInPandas(run, f"{ddl}, begin long").filter("begin is not null")
    own = prepared.join(begins, keys).filter(F.col("start") + F.size("samples") > F.col("begin"))
    cut = F.greatest(F.col("begin") - F.col("start"), F.lit(0).cast("long")).cast("int")
    kept = F.slice("samples", cut + 1, F.size("samples"))
    return own.select(*keys, "sr", (F.col("total") - F.col("begin")).alias("total"), "chunk", (F.col("start") + cut - F.col("begin")).alias("start"), kept.alias("samples"))


def joined_chunks(chunks: DataFrame, keys: Sequence[str] = ("speaker", "utt", "path")) -> DataFrame:
    """(keys, sr, samples) of whole recordings, for those that fit into one row."""
    rows = F.sort_array(F.collect_list(F.struct("start", "samples")))
    return chunks.groupBy(*keys, "sr").agg(F.flatten(F.transform(rows, lambda r: r["samples"])).alias("samples"))


def not_empty(audio: DataFrame) -> DataFrame:
    """Rows with samples left (P7); hours() takes the rows before this."""
    return audio.filter(F.size("samples") > 0)


def hours(audio: DataFrame, samples: str = "samples", rate: str = "sr") -> DataFrame:
    """Total duration in hours."""
    return audio.agg((F.sum(F.size(samples) / F.col(rate)) / 3600).alias("hours"))


def spectrogram(audio: DataFrame, n_fft: int = 256, overlap: int = 128) -> DataFrame:
    """(speaker, utt, window, seconds, power_db) of Hann windows: 10 log10 of power density, frequencies ascending."""
    ddl = "speaker string, utt string, window long, seconds double, power_db array<double>"
    taper = np.hanning(n_fft)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.asarray(r.samples, np.float64)
                starts = np.arange(0, max(0, len(x) - n_fft + 1), n_fft - overlap)
                if not len(starts):
                    continue
                power = np.abs(np.fft.rfft(x[starts[:, None] + np.arange(n_fft)] * taper, axis=1)) ** 2 / (r.sr * np.square(taper).sum())
                power[:, 1:-1] *= 2
                yield pd.DataFrame({"speaker": r.speaker, "utt": r.utt, "window": np.arange(len(starts)), "seconds": (starts + n_fft / 2) / r.sr, "power_db": list(10 * np.log10(np.maximum(power, 1e-300)))})

    return audio.mapInPandas(run, ddl)
