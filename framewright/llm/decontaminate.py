"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are the items' n-grams. One that at most ``RARE`` items share pairs a text with them where
it occurs. How rare a seed is depends on the items alone, so other copies in the corpus change
nothing. Commoner seeds are not left out, as an edited copy may have kept no other: they pair a
text with an item if the words that the two have in common, each as often as both have it, could
score enough. That bound is exact, and it is worked out once a text and item, not once an
occurrence. Around the seeds of a pair lie its passages, in windows that hold any alignment; one
whose bounds allow it is aligned with the item word by word (local alignment, linear gaps). The
score, relative to a perfect copy, also finds edited and paraphrased copies. A copy without ``n``
words of the item in a row has no seed and is not found; an item of fewer than ``n`` words is one
seed, all its words in a row, and any copy of it scores 1.

Items are the query set: they are collected and sent to the executors in blocks of a fixed size in
bytes, one pass over the documents a block, so nothing that is broadcast grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, split_words, word_names

CHUNK = 1 << 19
#: Bytes of the items of a block (some 25,000 of a hundred words); with names and seeds it is some four times as much to broadcast.
BLOCK_BYTES = 16 << 20
#: Alignment: what a word in common, a changed word, and a word left out or put in are worth.
MATCH, MISMATCH, GAP_COST = 2, -1, 1

#: Items that a rare seed is of at most.
RARE = 8
#: Rows that are made at a time of pairs, of their words and of their seeds.
PAIR_ROWS = 1 << 19

#: Words of passages whose bounds are computed at a time, and passages that wait for alignment.
CELLS, WAITING = 1 << 18, 2048

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 0x20

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def fold(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts, ends and documents of the words of joined texts: letters and digits in lower case."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    data = _FOLD[np.frombuffer(b"".join(texts), np.uint8)]
    starts, ends, doc = split_words(data, bounds)
    return word_names(data, starts, ends), starts - bounds[doc], ends - bounds[doc], doc


def ngrams(names: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the n-grams within documents and the words that they start at; other n, other names."""
    at = np.arange(max(0, len(names) - n + 1))
    at = at[doc[at] == doc[at + n - 1]]
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out += names[at + k] * _K[k]
        out ^= out >> np.uint64(29)
    return out, at


@dataclass
class Lookup:
    """Places of wanted names in a sorted array, by way of a small table of low bits."""

    wanted: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in names, places in wanted) of the names that are wanted."""
        at = np.flatnonzero(self.maybe[(names & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.wanted) or not len(at):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.wanted, names[at]), len(self.wanted) - 1)
        same = self.wanted[found] == names[at]
        return at[same], found[same]


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row's item in its passage, and the passage word after its end.

    Rows are padded: items with 1, passages with 0, which equal no name and each other never.
    """
    n, width = passages.shape
    ramp = (GAP_COST * np.arange(width + 1)).astype(np.int32)
    row, new = np.zeros((n, width + 1), np.int32), np.empty((n, width + 1), np.int32)
    best, end, rows = np.zeros(n, np.int32), np.zeros(n, np.int64), np.arange(n)
    for word in items.T:
        gain = (passages == word[:, None]).astype(np.int32)
        gain *= MATCH - MISMATCH
        gain += MISMATCH
        new[:, 0] = 0
        np.add(row[:, :-1], gain, out=new[:, 1:])
        row -= GAP_COST
        np.maximum(new, row, out=new)
        np.maximum(new, 0, out=new)
        new += ramp
        np.maximum.accumulate(new, axis=1, out=new)
        new -= ramp
        row, new = new, row
        at = row.argmax(axis=1)
        value = row[rows, at]
        up = value > best
        best[up], end[up] = value[up], at[up]
    return best, end


def padded(parts: Sequence[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts))), fill, np.uint64)
    for row, part in zip(out, parts, strict=True):
        row[: len(part)] = part
    return out


@dataclass
class Items:
    """A block of benchmark items with their seeds."""

    ids: list[int | None]
    words: list[np.ndarray]
    #: Names of the items' n-grams, or of all words of a shorter item, and the items that they are of.
    seeds: np.ndarray
    seed_item: np.ndarray
    n: int
    least_score: float

    def matches(self, texts: Sequence[bytes]) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, start byte, end byte) of the best alignment of each pair that scores enough."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        waiting: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            for t, *rest in self.passages(texts[i:j]):
                waiting.append((i + t, *rest))
                if len(waiting) >= WAITING:
                    self.settle(waiting, best)
                    waiting = []
            i = j
        self.settle(waiting, best)
        yield from ((t, k, *found) for (t, k), found in sorted(best.items()))

    def prepare(self) -> None:
        """Lookup tables, made where they are first needed."""
        self.wanted, first, of = np.unique(self.seeds, return_index=True, return_inverse=True)
        self.first = np.append(first, len(self.seeds))
        self.length = np.array([len(w) for w in self.words])
        self.widths = np.unique(np.minimum(self.length, self.n)).tolist()
        self.lookup = Lookup(self.wanted)
        order = np.argsort(self.seed_item, kind="stable")
        self.item_seeds, self.item_first = of[order], np.searchsorted(self.seed_item[order], np.arange(len(self.words) + 1))
        bags = [np.unique(w, return_counts=True) for w in self.words]
        self.bag_words, self.bag_counts = (np.concatenate(x) for x in zip(*bags, strict=True))
        self.bag_first = np.cumsum([0, *(len(w) for w, _ in bags)])
        self.salt = mix(np.arange(1, len(self.words) + 1, dtype=np.uint64))
        keys = self.bag_words + np.repeat(self.salt, np.diff(self.bag_first))
        order = np.argsort(keys, kind="stable")
        self.members, self.member_counts = Lookup(keys[order]), self.bag_counts[order]

    def passages(self, texts: Sequence[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, names, starts, ends) of the passages around seeds that can score enough; seeds near each other share one."""
        names, starts, ends, doc = fold(texts)
        if not hasattr(self, "lookup"):
            self.prepare()
        hits = [(at[hit], seed) for grams, at in (ngrams(names, doc, width) for width in self.widths) for hit, seed in [self.lookup(grams)]]
        hit, seed = (np.concatenate(x) for x in zip(*hits, strict=True))
        if not len(hit):
            return
        # hits in order of text and seed
        key = doc[hit] * len(self.wanted) + seed
        order = np.argsort(key, kind="stable")
        key, hit = key[order], hit[order]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        pairs = self.pairs(np.unique(key), names, doc, len(texts))
        for some in slices(self.item_first[pairs % len(self.words) + 1] - self.item_first[pairs % len(self.words)]):
            text, item, place = self.places(pairs[some], key, hit)
            length = self.length[item]
            new = np.ones(len(place), bool)
            new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (place[1:] - place[:-1] > length[1:])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1
            text, item, length = text[first], item[first], length[first]
            reach = length + length // 2 + self.n
            begin = np.maximum(place[first] - reach, bounds[text])
            stop = np.minimum(place[last] + reach, bounds[text + 1])
            # an alignment that scores enough spans at most three times its item: long passages come in windows of twice that
            count = np.maximum(1, -(-(stop - begin) // (3 * length)) - 1)
            row = np.repeat(np.arange(len(count)), count)
            begin = begin[row] + 3 * length[row] * runs_of(count)
            stop = np.minimum(stop[row], begin + 6 * length[row])
            text, item, length = text[row], item[row], length[row]
            enough = self.least_score * MATCH * length
            for rows in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(np.cumsum(stop - begin) // CELLS)) + 1):
                good = rows[self.bound(names, item[rows], begin[rows], stop[rows]) >= enough[rows]]
                for t, k, b, e in zip(text[good].tolist(), item[good].tolist(), begin[good].tolist(), stop[good].tolist(), strict=True):
                    yield t, k, names[b:e].copy(), starts[b:e].copy(), ends[b:e].copy()

    def pairs(self, met: np.ndarray, names: np.ndarray, doc: np.ndarray, n_texts: int) -> np.ndarray:
        """Pairs (text times the number of items plus item) that share a seed, from the different (text, seed); those of common seeds only if their common words can score enough."""
        text, seed = met // len(self.wanted), met % len(self.wanted)
        count = self.first[seed + 1] - self.first[seed]
        rare, out = count <= RARE, []
        salt = mix(np.arange(1, n_texts + 1, dtype=np.uint64))
        bag, bag_count = np.unique(names + salt[doc], return_counts=True)
        for group in (np.flatnonzero(rare), np.flatnonzero(~rare)):
            for some in slices(count[group]):
                rows = group[some]
                item = self.seed_item[np.repeat(self.first[seed[rows]], count[rows]) + runs_of(count[rows])]
                found = np.unique(np.repeat(text[rows], count[rows]) * len(self.words) + item)
                out.append(found if rare[rows[0]] else found[self.shared(found, salt, bag, bag_count)])
        return np.unique(np.concatenate(out))

    def shared(self, pairs: np.ndarray, salt: np.ndarray, bag: np.ndarray, bag_count: np.ndarray) -> np.ndarray:
        """Whether each pair's common words, as often as both have them, could score enough."""
        good = np.zeros(len(pairs), bool)
        text, item = pairs // len(self.words), pairs % len(self.words)
        size = self.bag_first[item + 1] - self.bag_first[item]
        for some in slices(size):
            at = np.repeat(self.bag_first[item[some]], size[some]) + runs_of(size[some])
            key = self.bag_words[at] + np.repeat(salt[text[some]], size[some])
            place = np.minimum(np.searchsorted(bag, key), len(bag) - 1)
            both = np.where(bag[place] == key, np.minimum(bag_count[place], self.bag_counts[at]), 0)
            good[some] = np.add.reduceat(both, np.cumsum(size[some]) - size[some]) >= self.least_score * self.length[item[some]]
        return good

    def places(self, pairs: np.ndarray, key: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place) of the seeds of some pairs, in order of item, text and place."""
        text, item = pairs // len(self.words), pairs % len(self.words)
        size = self.item_first[item + 1] - self.item_first[item]
        row = np.repeat(np.arange(len(pairs)), size)
        wanted = text[row] * len(self.wanted) + self.item_seeds[np.repeat(self.item_first[item], size) + runs_of(size)]
        low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
        row, place = np.repeat(row, high - low), hit[np.repeat(low, high - low) + runs_of(high - low)]
        order = np.lexsort((place, text[row], item[row]))
        return text[row][order], item[row][order], place[order]

    def bound(self, names: np.ndarray, item: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """What the alignment of each item with its passage names[begin:stop] scores at most.

        A passage word in an alignment is worth a match, or, if the item lacks it, a changed word
        or one put in; the best stretch of the passage by these values scores no less. Nor do the
        matches outnumber the words in common, each counted as often as both have it.
        """
        size = stop - begin
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        place = np.repeat(begin - first, size) + np.arange(len(row))
        gain = np.full(len(row), max(MISMATCH, -GAP_COST), np.int64)
        at, member = self.members(names[place] + self.salt[item][row])
        gain[at] = MATCH
        both, times = np.unique(row[at] * len(self.member_counts) + member, return_counts=True)
        common = np.bincount(both // len(self.member_counts), np.minimum(times, self.member_counts[both % len(self.member_counts)]), len(size))
        total = np.cumsum(gain)
        # each row lies below all earlier ones, so the running minimum starts anew
        drop = row * (2 * int(np.abs(gain).sum()) + 1)
        low = np.minimum.accumulate(total - gain - drop) + drop
        return np.minimum(np.maximum(np.maximum.reduceat(total - low, first), 0), MATCH * common)

    def settle(self, waiting: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], best: dict) -> None:
        """Align passages with their items, those of like size together, and keep each pair's best."""
        for some in by_size([len(w[2]) for w in waiting], [len(self.words[w[1]]) for w in waiting]):
            rows = [waiting[i] for i in some]
            length = np.array([len(self.words[w[1]]) for w in rows])
            score, end = align(padded([self.words[w[1]] for w in rows], 1), padded([w[2] for w in rows], 0))
            good = np.flatnonzero(score >= self.least_score * MATCH * length)
            if not len(good):
                continue
            back = [rows[r][2][: end[r]][::-1] for r in good]
            _, size = align(padded([self.words[rows[r][1]][::-1] for r in good], 1), padded(back, 0))
            for r, n in zip(good.tolist(), size.tolist(), strict=True):
                t, k, _, starts, ends = rows[r]
                found = (float(score[r] / (MATCH * length[r])), int(starts[end[r] - n]), int(ends[end[r] - 1]))
                if (t, k) not in best or found[0] > best[t, k][0]:
                    best[t, k] = found


def runs_of(count: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def slices(size: np.ndarray) -> Iterator[np.ndarray]:
    """Places of rows in groups whose sizes add up to some PAIR_ROWS, one larger row by itself."""
    if len(size):
        yield from np.split(np.arange(len(size)), np.flatnonzero(np.diff((np.cumsum(size) - size) // PAIR_ROWS)) + 1)


def by_size(width: Sequence[int], length: Sequence[int], cells: int = 1 << 18) -> Iterator[list[int]]:
    """Numbers of passages in groups of like widths and lengths whose padded cells are bounded."""
    order = sorted(range(len(width)), key=lambda i: (length[i].bit_length(), width[i]))
    i = 0
    while i < len(order):
        j, most = i + 1, width[order[i]]
        while j < len(order) and length[order[j]].bit_length() == length[order[i]].bit_length() and width[order[j]] <= 2 * most + 16 and width[order[j]] * (j - i + 1) <= cells:
            j += 1
        yield order[i:j]
        i = j


#: Rows of an Arrow batch whose texts are in Python's memory at a time.
ROWS = 1024


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Lower-cased texts; what a match says of bytes is about these."""
    return [x.lower().encode() if isinstance(x, str) else b"" for x in batch.column(column).to_pylist()]


def item_blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str, n: int, least_score: float, block_bytes: int) -> Iterator[Items]:
    """The benchmark's items in blocks, with all their n-grams as seeds."""
    rows = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        own = sorted((r["item_id"] is None, r["item_id"] or 0, r["text"], r["item_id"]) for r in dealt.filter(F.col("block") == block).collect())
        words = [fold([r[2].lower().encode()])[0] for r in own]
        keep = [i for i, w in enumerate(words) if len(w)]
        ids, words = [own[i][3] for i in keep], [words[i] for i in keep]
        if not words:
            continue
        # a seed that an item repeats counts once
        grams = [np.unique(ngrams(w, np.zeros(len(w), int), min(n, len(w)))[0]) for w in words]
        seeds, seed_item = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(seeds, kind="stable")
        yield Items(ids, words, seeds[order], seed_item[order], n, least_score)


PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 3, least_score: float = 0.45, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of documents and benchmark items that they hold a copy of.

    doc_id, item_id, score (of the best alignment, 1 for a perfect copy of the whole item),
    start_byte and end_byte (of the lower-cased UTF-8 text) of the aligned passage. Null and blank texts and items
    match nothing; an item of fewer than ``n`` words is found where all its words stand in a row; equal items with one id count once; repeated documents
    give repeated pairs; null ids stay null; empty tables give no pairs; other columns are not
    read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark, item_id_col, item_text_col, n, least_score, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[t], items.ids[k], *rest) for t, k, *rest in items.matches(_texts(batch, "text"))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), PAIRS, strict=True)], schema=PAIRS)

        part = rows.mapInArrow(run, "doc_id long, item_id long, score double, start_byte long, end_byte long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, start_byte long, end_byte long")
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 3, least_score: float = 0.45, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, whole, that hold no copy of an item by ``decontaminate``.

    Texts are not shuffled. Null and blank texts stay; repeated rows and null ids are judged by
    their texts; without items, or with an empty table, the rows come back; other columns are not
    read.
    """
    for items in item_blocks(benchmark, item_id_col, item_text_col, n, least_score, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                hit = {t for t, *_ in items.matches(_texts(batch, text_col))}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
