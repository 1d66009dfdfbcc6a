"""Repeated byte strings, by a distributed difference-cover suffix method.

A suffix is *sampled* if its place in its document, modulo V, lies in a perfect difference set:
for any two places some shift below V brings both onto sampled ones. Sampled suffixes are ranked
by triples, recursively: the name of 3**(k+1) bytes is the name of the triple of its three
3**k-byte names. A name is a 64-bit hash instead of a global rank: only equality of prefixes is
asked for, and hash names agree on all executors without a sort per level. Names of sampled
suffixes meet in buckets, are sorted, and adjacent equal prefixes show which suffixes have a
partner. The remaining suffixes within the shift of such a one are merged in: their ``length``-byte
prefixes, named by two overlapping top-level names, are sorted in buckets in their turn and
adjacent ones compared. With V = 133 and top names of 243 bytes every repeat of 400 bytes holds
a sampled repeat, so nothing is lost. The only error is by chance: two different windows have one
name with probability 2**-80 divided by the number of buckets, or about 2**-64 if one of the two
top-level names covers all the bytes in which they differ.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_SYMBOL, cover, mix, runs
from .names import Home, Repeats, rounds

#: Order of the plane that the difference set comes from; V = Q*Q + Q + 1.
Q = 11
V = Q * Q + Q + 1
LEVELS = 5
TOP = 3**LEVELS

DDL = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>, n_partners long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_partners", pa.int64())])


@functools.cache
def difference_set(q: int = Q) -> tuple[int, ...]:
    """Perfect difference set modulo q*q+q+1 for a prime q.

    The powers of a generator of GF(q**3) that lie on a plane through the origin, by exponent.
    """
    v = q * q + q + 1

    def times_x(a: tuple[int, int, int], c: tuple[int, int, int]) -> tuple[int, int, int]:
        return (-a[2] * c[0] % q, (a[0] - a[2] * c[1]) % q, (a[1] - a[2] * c[2]) % q)

    for code in range(q**3):
        c = (code % q, code // q % q, code // q // q)
        a, found = (1, 0, 0), []
        for i in range(v):
            if a[2] == 0:
                found.append(i)
            a = times_x(a, c)
        if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
            return tuple(found)
    raise ValueError(f"{q} is not prime")


_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def top_names(data: np.ndarray) -> np.ndarray:
    """Names of the TOP bytes at each place, by LEVELS rounds of triples; fewer places than bytes."""
    h = BYTE_SYMBOL[data]
    step = 1
    for _ in range(LEVELS):
        n = len(h) - 2 * step
        if n <= 0:
            return np.empty(0, np.uint64)
        out = h[:n] * _K[0]
        more = h[step : step + n] * _K[1]
        out += more
        np.multiply(h[2 * step :], _K[2], out=more)
        out += more
        np.right_shift(out, np.uint64(29), out=more)
        out ^= more
        h, step = out, step * 3
    return h


class ByteRepeats(Repeats):
    schema, silence_copies = SCHEMA, True

    def __init__(self, length: int) -> None:
        if length < TOP + V - 1:
            raise ValueError(f"length must be at least {TOP + V - 1}")
        self.length = self.least_size = length

    def sampled(self, bounds: np.ndarray, offset: np.ndarray | None = None) -> np.ndarray:
        """Places of the sampled suffixes with TOP bytes, of the documents that can hold a window."""
        inside = np.array(difference_set(), np.int64)
        out = []
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if end - start >= self.length:
                periods = (end - start) // V + 1
                at = (np.arange(periods)[:, None] * V + inside).ravel() + start
                out.append(at[at <= end - TOP])
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def seeds(self, home: Home) -> np.ndarray:
        out = []
        for _, _, data, bounds in home.chunks():
            at = self.sampled(bounds)
            if len(at):
                out.append(top_names(data)[at])
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def starts(self, home: Home) -> int:
        return sum(map(len, home.texts))

    def marked(self, home: Home, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, flagged, used = [np.zeros(0, bool)], [np.zeros(0, np.int64)], 0
        for _, _, data, bounds in home.chunks():
            at = self.sampled(bounds)
            at, used = at[flags[used : used + len(at)]], used + len(at)
            doc = np.searchsorted(bounds, at, "right") - 1
            low, high = np.maximum(at - (V - 1), bounds[doc]), np.minimum(at, bounds[doc + 1] - self.length) + 1
            some = low < high
            out.append(cover(len(data), low[some], high[some]))
            flagged.append(np.bincount(doc, minlength=len(bounds) - 1))
        return np.concatenate(out), np.concatenate(flagged)

    def names(self, home: Home, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = int(np.count_nonzero(mask))
        one, two = np.empty(n, np.uint64), np.empty(n, np.uint64)
        used, done = 0, 0
        for _, _, data, _ in home.chunks():
            at = np.flatnonzero(mask[used : used + len(data)])
            used += len(data)
            if len(at):
                top = top_names(data)
                a, b = top[at], top[at + (self.length - TOP)]
                one[done : done + len(at)] = mix(a + mix(b + _K[1]))
                two[done : done + len(at)] = mix(b + mix(a + _K[2]))
                done += len(at)
        return one, two

    def finish(self, home: Home, mask: np.ndarray, flagged: np.ndarray) -> pa.Table:
        sizes, kept, spans, used = [], [], [], 0
        for text in home.texts:
            own = mask[used : used + len(text)]
            used += len(text)
            sizes.append(len(text))
            if not own.any():
                kept.append(text)
                spans.append([])
                continue
            at = np.flatnonzero(own)
            gone = cover(len(text), at, np.minimum(at + self.length, len(text)))
            low, high = runs(gone)
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            spans.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        return pa.table([home.ids, sizes, kept, spans, flagged.astype(np.int64)], schema=SCHEMA)


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    One row per input row: doc_id, n_bytes, kept (the remaining bytes joined; they need not be
    whole characters), spans of removed bytes, n_partners (sampled places of a text of ``length``
    bytes or more whose next TOP bytes also start at another sampled place: a sign of repeats that
    may be shorter than ``length``, and decides nothing). Overlapping repeats count, matches stay within
    documents and are judged on the input. A null text is empty; texts shorter than ``length``
    and empty tables come back unchanged; a repeated row is another place and so removes both;
    rows with a null id are kept with a null id; other columns are not read. ``length`` is 375
    at least.
    """
    return rounds(docs, id_col, text_col, ByteRepeats(length), DDL)
