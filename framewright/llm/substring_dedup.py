"""Repeated word windows, by recompression.

Words get 64-bit names. A round first names maximal runs of a symbol, then pairs of neighbours
whose left is of the left half and whose right is of the right half of the alphabet (a bit of
the symbol's name decides, afresh each round). Names are hashes, so all executors give the same
run or pair the same name and no round needs a shuffle. Inside equal substrings the symbols are
the same except near the ends, and the code tracks exactly which: each symbol carries its
*context*, the range of words that fixes it and its borders. A window's key is its first symbol
of the highest round whose context lies in the window, named with that context's words: equal
windows have equal keys at the same place, and neighbouring windows share one occurrence, so few
names travel. Keys that occur elsewhere reveal candidate repeats; these windows' own names
verify them. Two different windows have one name by chance only: with probability 2**-80 divided
by the number of buckets, or 2**-64 where two of their words have the same 64-bit name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chain, cover, mix, runs, split_words, word_names
from .names import Home, Repeats, rounds

DDL = "doc_id long, n_words long, kept string, spans array<struct<start:long,end:long>>"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def neighbours(low: np.ndarray, high: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context start of the symbol to the left and context end of the one to the right.

    Past a document's border they lie one word outside it, so no window holds them.
    """
    left, right = bounds[doc] - 1, bounds[doc + 1] + 1
    same = np.flatnonzero(doc[1:] == doc[:-1])
    left[same + 1] = low[same]
    right[same] = high[same + 1]
    return left, right


def compress_runs(symbol, low, high, doc, bounds):
    """Name maximal runs; any symbol's border depends on both neighbours."""
    new = np.ones(len(symbol), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(symbol)))
    last = first + count - 1
    named = np.where(count > 1, mix(symbol[first] + count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), symbol[first])
    left, right = neighbours(low, high, doc, bounds)
    return named, left[first], right[last], doc[first]


def compress_pairs(symbol, low, high, doc, bounds, turn):
    """Name pairs of a left and a right symbol; a lone one's border depends on the side it could pair with."""
    right_half = (mix(symbol + np.uint64((turn + 1) * 0x9FB21C651E98DF25 % (1 << 64))) & np.uint64(1)).astype(bool)
    joins = np.zeros(len(symbol), bool)
    joins[:-1] = ~right_half[:-1] & right_half[1:] & (doc[1:] == doc[:-1])
    second = np.zeros(len(symbol), bool)
    second[1:] = joins[:-1]
    left, right = neighbours(low, high, doc, bounds)
    out_low, out_high = np.where(right_half, left, low), np.where(right_half, high, right)
    at = np.flatnonzero(joins)
    out_low[at], out_high[at] = low[at], high[at + 1]
    named = symbol.copy()
    named[at] = mix(symbol[at] * np.uint64(0x9E3779B97F4A7C15) + (symbol[at + 1] ^ np.uint64(0x5851F42D4C957F2D)))
    keep = ~second
    return named[keep], out_low[keep], out_high[keep], doc[keep]


#: Words that are parsed at a time.
PART = 1 << 16


class WordRepeats(Repeats):
    schema, ranked = SCHEMA, True

    def __init__(self, width: int, turns: int) -> None:
        self.width, self.turns = width, turns

    def parsed(self, home: Home) -> tuple[np.ndarray, np.ndarray]:
        """Names and documents of the home's words."""
        if not hasattr(home, "parsed"):
            words, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for i, _, data, bounds in home.chunks():
                starts, ends, doc = split_words(data, bounds)
                words.append(word_names(data, starts, ends))
                docs.append(doc + i)
            home.parsed = np.concatenate(words), np.concatenate(docs)
        return home.parsed

    def window_starts(self, doc: np.ndarray) -> np.ndarray:
        at = np.arange(max(0, len(doc) - self.width + 1))
        return at[doc[at] == doc[at + self.width - 1]]

    def keys(self, home: Home) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The key occurrences' names, and for each window its start and its key's number."""
        if hasattr(home, "keys"):
            return home.keys
        word, doc = self.parsed(home)
        bounds = np.searchsorted(doc, np.arange(len(home.texts) + 1))
        names, starts, numbers, used = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        first = 0
        while first < len(home.texts):  # windows lie in documents, so a few documents at a time
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PART, "right")) - 1)
            low, high = bounds[first], bounds[last]
            found, at, number = self.part_keys(word[low:high], doc[low:high] - first, bounds[first : last + 1] - low)
            names.append(found)
            starts.append(at + low)
            numbers.append(number + used)
            used += len(found)
            first = last
        home.keys = np.concatenate(names), np.concatenate(starts), np.concatenate(numbers)
        return home.keys

    def part_keys(self, word: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for some documents' words, numbered from 0."""
        open_at = self.window_starts(doc)
        place = np.arange(len(word))
        state = word, place, place + 1, doc
        levels = [state]
        for turn in range(self.turns):
            state = compress_runs(*state, bounds)
            levels.append(state)
            state = compress_pairs(*state, bounds, turn)
            levels.append(state)
        names, starts, numbers, used = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for _, low, high, _ in reversed(levels):
            if not len(low):
                continue
            at = np.minimum(np.searchsorted(low, open_at), len(low) - 1)
            good = (low[at] >= open_at) & (high[at] <= open_at + self.width)
            chosen, number = np.unique(at[good], return_inverse=True)
            names.append(chain(word, low[chosen], high[chosen], 0))
            starts.append(open_at[good])
            numbers.append(number + used)
            used += len(chosen)
            open_at = open_at[~good]
        return np.concatenate(names), np.concatenate(starts), np.concatenate(numbers)

    def seeds(self, home: Home) -> np.ndarray:
        return self.keys(home)[0]

    def marked(self, home: Home, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, starts, numbers = self.keys(home)
        mask = np.zeros(self.starts(home), bool)
        mask[starts[flags[numbers]]] = True
        return mask, np.zeros(len(home.texts), np.int64)

    def starts(self, home: Home) -> int:
        return len(self.parsed(home)[0])

    def names(self, home: Home, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, word = np.flatnonzero(mask), self.parsed(home)[0]
        return chain(word, at, at + self.width, 1), chain(word, at, at + self.width, 2)

    def ranks(self, home: Home, mask: np.ndarray) -> np.ndarray:
        return home.rank[self.parsed(home)[1][mask]]

    def finish(self, home: Home, mask: np.ndarray, flagged: np.ndarray) -> pa.Table:
        at = np.flatnonzero(mask)
        gone = cover(len(mask), at, at + self.width)
        sizes, kept, spans, used = [], [], [], 0
        counts = np.bincount(self.parsed(home)[1], minlength=len(home.texts)).tolist()
        for text, count in zip(home.texts, counts, strict=True):
            own = gone[used : used + count]
            used += count
            found = text.translate(_ONE_SPACE).split(b" ") if count else []
            found = [w for w in found if w]
            if own.any():
                low, high = runs(own)
                spans.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                found = [w for w, g in zip(found, own.tolist(), strict=True) if not g]
            else:
                spans.append([])
            sizes.append(count)
            kept.append(b" ".join(found).decode())
        return pa.table([home.ids, sizes, kept, spans], schema=SCHEMA)


#: The six separators as one, for bytes.translate.
_ONE_SPACE = bytes(0x20 if c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D) else c for c in range(256))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, turns: int = 3) -> DataFrame:
    """Remove every word covered by a ``width``-word window that also starts in a document of smaller id.

    One row per input row: doc_id, n_words, kept (the remaining words joined by one space), spans
    of removed words. Windows are judged on the input. Null and blank texts have no words; texts
    shorter than a window and empty tables come back unchanged; rows that repeat an id are equal
    in rank and remove nothing from each other; a null id ranks after all others; other columns
    are not read. ``turns`` (rounds of runs and pairs) changes the cost, never the result.
    """
    return rounds(docs, id_col, text_col, WordRepeats(width, turns), DDL)
