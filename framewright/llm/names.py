"""Distributed naming rounds for exact repeats.

Both repeat-removal operators work in *homes* (hash groups of documents, rows of one shuffle
that is reused) and *buckets* (hash groups of names). In a round every home sends each distinct
name once to the name's bucket, as packed binaries, one row per home and bucket; the bucket
sorts its names, compares neighbours, and answers with one bit per name. A name that occurs
a billion times is therefore at most one record per home, and no group of copies meets in a
task. There are two homes a shuffle partition, and more where that leaves a home more text than
HOME_BYTES. Windows, of which there can be one a byte, are sorted a range of buckets at a time.

A window's name has two independent 64-bit halves. Its bucket comes from 48 bits of the second;
all of the first and 16 further bits are sent and compared: 80 bits besides the bucket.

Order inside a home is fixed by (doc_id, text), so each pass sees the same positions whatever
order the shuffle delivered.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, shuffle_partitions, text_bytes

SENT = "bucket int, home int, names binary, extra binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("names", pa.binary()), ("extra", pa.binary())])
#: Text bytes that one vectorised step works on.
CHUNK = 1 << 19


#: Bytes of text that a home gets on average at most.
HOME_BYTES = 32 << 20
#: Ranges of buckets in a home, and of names in a bucket, that are sorted one after the other.
PART_BITS = 4
PARTS = 1 << PART_BITS


def home_count(docs: DataFrame, text_col: str) -> int:
    """Homes for all the text, by a pass that only adds up sizes."""
    size = docs.agg(F.sum(F.length(text_bytes(F.col(text_col))))).first()[0] or 0
    return max(2 * shuffle_partitions(docs.sparkSession), -(-size // HOME_BYTES))


def homes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(home, doc_id, data), dealt to ``n`` homes by a hash of id and text."""
    data = text_bytes(F.col(text_col))
    key = F.xxhash64(F.col(id_col).cast("long"), F.crc32(data))
    return docs.select(F.pmod(key, F.lit(n)).cast("int").alias("home"), F.col(id_col).cast("long").alias("doc_id"), data.alias("data"))


class Home:
    """The documents of a home in their fixed order."""

    def __init__(self, table: pa.Table) -> None:
        self.number = table.column("home")[0].as_py()
        ids, texts = table.column("doc_id").to_pylist(), table.column("data").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.rank = np.array([NULL_ID if i is None else i for i in self.ids], np.int64)

    def chunks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first document, end, their bytes joined, start of each and the end)."""
        i = 0
        while i < len(self.texts):
            j, size = i, 0
            while j < len(self.texts) and (j == i or size + len(self.texts[j]) <= CHUNK):
                size += len(self.texts[j])
                j += 1
            bounds = np.zeros(j - i + 1, np.int64)
            np.cumsum([len(t) for t in self.texts[i:j]], out=bounds[1:])
            yield i, j, np.frombuffer(b"".join(self.texts[i:j]), np.uint8), bounds
            i = j


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each distinct name (a, b) first stands, the number of each name's, how often each occurs)."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = x[1:] == x[:-1]
    new = np.ones(len(a), bool)
    new[1:] = ~same | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    at = np.empty(len(a), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[first], at, np.diff(np.append(first, len(a)))


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct names by bucket, and where each bucket starts in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def pack_sorted(key: np.ndarray, size: int) -> bytes:
    """Ascending numbers of ``size`` bytes as differences, all first bytes, then all second ones ...: the last are mostly zero."""
    return np.diff(key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def unpack_sorted(data: bytes, n: int, size: int) -> np.ndarray:
    cells = np.zeros((n, 8), np.uint8)
    cells[:, :size] = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T
    return np.cumsum(cells.view(np.uint64).ravel(), dtype=np.uint64)


#: Bytes that are sent of a seed's name and of the first half of a window's.
SEED, WINDOW = 5, 8
SEED_MASK = np.uint64((1 << 8 * SEED) - 1)


def send(home: Home, bucket: np.ndarray, key: np.ndarray, size: int, columns: list[np.ndarray], n: int, extra: bytes = b"") -> pa.Table:
    """One row for each bucket that has names: their ascending keys, then each column's cells. ``extra`` travels with one row there and back."""
    order, at = by_bucket(bucket, n)
    own = [(b, order[at[b] : at[b + 1]]) for b in np.flatnonzero(np.diff(at)).tolist()]
    own = own or ([(home.number % n, order)] if extra else [])
    names = [b"".join([pack_sorted(key[o], size), *(c[o].tobytes() for c in columns)]) for _, o in own]
    rows = {"bucket": [b for b, _ in own], "home": [home.number] * len(own), "names": names, "extra": [extra if k == 0 else b"" for k in range(len(own))]}
    return pa.table(rows, schema=SENT_ARROW)


def answers(bucket: np.ndarray, n: int, table: pa.Table) -> np.ndarray:
    """The bit of each of the distinct names that this home sent."""
    bit = np.zeros(len(bucket), bool)
    order, at = by_bucket(bucket, n)
    for b, mask in zip(table.column("bucket").to_pylist(), table.column("names").to_pylist(), strict=True):
        own = order[at[b] : at[b + 1]]
        bit[own] = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(own)).astype(bool)
    return bit


def least_ranks(ranks: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, NULL_ID, np.int64)
    np.minimum.at(least, at, ranks)
    return least


def resolve_texts(blobs: list[bytes]) -> list[bytes]:
    """Answers to the texts' names and ranks that came as extras: two bits each."""
    tables = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in blobs]
    a, b, ranks = (np.concatenate([t[k] for t in tables]) for k in range(3))
    first, at, count = distinct(a, b)
    shared, smaller = count[at] > 1, least_ranks(ranks.view(np.int64), at, len(first))[at] < ranks.view(np.int64)
    ends = np.cumsum([t.shape[1] for t in tables])
    return [np.packbits(np.concatenate([shared[e - t.shape[1] : e], smaller[e - t.shape[1] : e]])).tobytes() for t, e in zip(tables, ends, strict=True)]


def resolver(size: int, kinds: tuple[str, ...] = (), texts: bool = False) -> Callable[[pa.Table], pa.Table]:
    """Bucket step: sort the names, a range at a time, compare neighbours, answer by row.

    Names are keys of ``size`` bytes and, if ``kinds`` says so, second halves and ranks. A bit
    says that another home has the name too or, if there are ranks, that another home has it at
    a smaller rank than this home's smallest.
    """
    sizes = [np.dtype(k).itemsize for k in kinds]

    def resolve(table: pa.Table) -> pa.Table:
        blobs = table.column("names").to_pylist()
        counts = [len(x) // (size + sum(sizes)) for x in blobs]
        key = np.concatenate([unpack_sorted(x, c, size) for x, c in zip(blobs, counts, strict=True)])
        columns = [np.concatenate([np.frombuffer(x, kind, c, c * (size + sum(sizes[:k]))) for x, c in zip(blobs, counts, strict=True)]) for k, kind in enumerate(kinds)]
        part = (key >> np.uint64(8 * size - PART_BITS)).astype(np.uint8)
        bits = np.zeros(len(key), bool)
        for p in range(PARTS):
            own = np.flatnonzero(part == p)
            first, at, count = distinct(key[own], columns[0][own] if columns else np.zeros(len(own), bool))
            if len(columns) > 1:
                bits[own] = least_ranks(columns[1][own], at, len(first))[at] < columns[1][own]
            else:
                bits[own] = count[at] > 1
        if texts:
            table = table.set_column(3, "extra", pa.array(resolve_texts(table.column("extra").to_pylist()), pa.binary()))
        ends = np.cumsum(counts)
        masks = [np.packbits(bits[e - c : e]).tobytes() for c, e in zip(counts, ends, strict=True)]
        return pa.table({"bucket": table.column("bucket"), "home": table.column("home"), "names": pa.array(masks, pa.binary()), "extra": table.column("extra")}, schema=SENT_ARROW)

    return resolve


class Copies:
    """A home's distinct texts that can hold a window, and which of its documents are copies.

    Names of whole texts go to their buckets along with the seeds, with the least id here.
    """

    def __init__(self, home: Home, least_size: int, n: int) -> None:
        first: dict[bytes, int] = {}
        self.text = np.full(len(home.texts), -1)
        for i, text in enumerate(home.texts):
            if len(text) >= least_size:
                self.text[i] = first.setdefault(text, len(first))
        lead = np.flatnonzero(self.leads())
        self.names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(home.texts[i]) for i in lead), np.uint64).reshape(-1, 2)
        self.ranks = home.rank[lead]
        self.bucket = ((self.names[:, 1] >> np.uint64(16)) % np.uint64(n)).astype(np.int64)

    def leads(self) -> np.ndarray:
        """The first document of each text."""
        out = np.zeros(len(self.text), bool)
        some = np.flatnonzero(self.text >= 0)
        out[some[np.unique(self.text[some], return_index=True)[1]]] = True
        return out

    def send(self, sent: pa.Table, home: Home, n: int) -> pa.Table:
        """The rows to the buckets, with names and ranks of the texts that belong there as extras."""
        own = {b: np.flatnonzero(self.bucket == b) for b in np.unique(self.bucket).tolist()}
        blob = lambda at: np.concatenate([self.names[at, 0], self.names[at, 1], self.ranks[at].view(np.uint64)]).tobytes()
        there = sent.column("bucket").to_pylist()
        sent = sent.set_column(3, "extra", pa.array([blob(own.pop(b)) if b in own else b"" for b in there], pa.binary()))
        rest = {"bucket": list(own), "home": [home.number] * len(own), "names": [b""] * len(own), "extra": [blob(at) for at in own.values()]}
        return pa.concat_tables([sent, pa.table(rest, schema=SENT_ARROW)])

    def settle(self, answered: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Masks of documents: has an equal text anywhere; another one speaks for it."""
        shared, smaller = np.zeros(len(self.names), bool), np.zeros(len(self.names), bool)
        for b, mask in zip(answered.column("bucket").to_pylist(), answered.column("extra").to_pylist(), strict=True):
            at = np.flatnonzero(self.bucket == b)
            bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=2 * len(at)).astype(bool)
            shared[at], smaller[at] = bits[: len(at)], bits[len(at) :]
        some = self.text >= 0
        copied, silent = np.zeros(len(self.text), bool), np.zeros(len(self.text), bool)
        here = np.bincount(self.text[some], minlength=len(self.names))
        copied[some] = (shared | (here > 1))[self.text[some]]
        silent[some] = (smaller[self.text] | ~self.leads())[some]
        return copied, silent


def pack_mask(mask: np.ndarray) -> bytes:
    """Empty for a mask of nothing."""
    return b"" if not mask.any() else zlib.compress(np.packbits(mask).tobytes(), 1)


def unpack_mask(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool) if data else np.zeros(n, bool)


def pack_parts(parts: list[bytes]) -> bytes:
    """Byte strings as one, which is empty if all are."""
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts) if any(parts) else b""


def unpack_parts(data: bytes, n: int) -> list[bytes]:
    if not data:
        return [b""] * n
    ends = 8 * n + np.cumsum([0, *struct.unpack_from(f"<{n}q", data)])
    return [data[a:b] for a, b in itertools.pairwise(ends.tolist())]


class Repeats:
    """What a repeat-removal operator tells the rounds. Window starts are numbered through a home."""

    #: Whether a window counts only as the copy of one in a document of smaller rank.
    ranked = False
    #: Whether a text that has an equal text of smaller id sends no windows: all of it goes, and the other sends them.
    silence_copies = False
    #: Least bytes of a text with a window; window starts are bytes then.
    least_size = 0
    #: Arrow schema of finish().
    schema: pa.Schema

    def seeds(self, home: Home) -> np.ndarray:
        """Names of the sparse sampled positions; any two equal windows share one at the same place."""
        raise NotImplementedError

    def marked(self, home: Home, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mask of the window starts that a flagged seed (one that occurs elsewhere) can belong to; flagged seeds of each document."""
        raise NotImplementedError

    def starts(self, home: Home) -> int:
        raise NotImplementedError

    def names(self, home: Home, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the names of the whole windows at the marked starts."""
        raise NotImplementedError

    def ranks(self, home: Home, mask: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def finish(self, home: Home, mask: np.ndarray, flagged: np.ndarray) -> pa.Table:
        """Result rows, given the starts of the windows to remove and the flagged seeds of each document."""
        raise NotImplementedError


def window_bucket(half: np.ndarray, n: int) -> np.ndarray:
    return ((half >> np.uint64(16)) % np.uint64(n)).astype(np.int64)


def in_parts(half: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of the windows whose bucket lies in it), by the second halves of their names."""
    part = np.empty(len(half), np.uint8)
    for i in range(0, len(half), CHUNK):
        part[i : i + CHUNK] = window_bucket(half[i : i + CHUNK], n) * PARTS // n
    for p in range(PARTS):
        own = np.flatnonzero(part == p)
        if len(own):
            yield p, own


def send_windows(job: Repeats, home: Home, mask: np.ndarray, n: int, extra: bytes) -> pa.Table:
    """The rows to the buckets with the distinct names of the marked windows; ``extra`` travels with one."""
    a, b = job.names(home, mask)
    ranks = job.ranks(home, mask) if job.ranked else None
    sent = []
    for _, own in in_parts(b, n):
        x, y = a[own], b[own]
        names, at, _ = distinct(x, y)
        columns = [y[names].astype(np.uint16)]
        if ranks is not None:
            columns.append(least_ranks(ranks[own], at, len(names)))
        sent.append(send(home, window_bucket(y[names], n), x[names], WINDOW, columns, n))
    if not sent:
        none = np.empty(0, np.int64)
        return send(home, none, none.view(np.uint64), WINDOW, [], n, extra)
    first = sent[0].set_column(3, "extra", pa.array([extra] + [b""] * (len(sent[0]) - 1), pa.binary()))
    return pa.concat_tables([first, *sent[1:]])


def repeated_windows(job: Repeats, home: Home, mask: np.ndarray, n: int, answered: pa.Table) -> np.ndarray:
    """Of the marked windows, in their order, those to remove."""
    a, b = job.names(home, mask)
    ranks = job.ranks(home, mask) if job.ranked else None
    answered = answered.select(["bucket", "names"])
    part = answered.column("bucket").to_numpy().astype(np.int64) * PARTS // n
    hit = np.zeros(len(a), bool)
    for p, own in in_parts(b, n):
        x, y = a[own], b[own]
        names, at, count = distinct(x, y)
        bit = answers(window_bucket(y[names], n), n, answered.filter(pa.array(part == p)))
        if ranks is not None:
            hit[own] = bit[at] | (ranks[own] > least_ranks(ranks[own], at, len(names))[at])
        else:
            hit[own] = (bit | (count > 1))[at]
    return hit


def rounds(docs: DataFrame, id_col: str, text_col: str, job: Repeats, ddl: str) -> DataFrame:
    """A naming round for the seeds, one for the windows that they mark, and the final pass."""
    n_homes = home_count(docs, text_col)
    n = n_homes // 2
    dealt = homes(docs, id_col, text_col, n_homes)

    def seeds_of(home: Home) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bucket and key of each distinct name, in the order of keys; the number of each seed's; how often each occurs."""
        seeds = job.seeds(home)
        key, rest = seeds & SEED_MASK, seeds >> np.uint64(8 * SEED)
        first, at, count = distinct(key, rest)
        return (rest[first] % np.uint64(n)).astype(np.int64), key[first], at, count

    def first(table: pa.Table) -> pa.Table:
        home = Home(table)
        bucket, key, _, _ = seeds_of(home)
        sent = send(home, bucket, key, SEED, [], n)
        return Copies(home, job.least_size, n).send(sent, home, n) if job.silence_copies else sent

    def second(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows or not answered.num_rows:
            return SENT_ARROW.empty_table()
        home = Home(table)
        bucket, _, at, count = seeds_of(home)
        mask, flagged = job.marked(home, (answers(bucket, n, answered) | (count > 1))[at])
        copied = b""
        if job.silence_copies:
            whole, silent = Copies(home, job.least_size, n).settle(answered)
            mask &= ~np.repeat(silent, [len(t) for t in home.texts])
            copied = pack_mask(whole)
        extra = [copied, pack_mask(mask), zlib.compress(flagged.astype(np.uint32).tobytes(), 1) if flagged.any() else b""]
        return send_windows(job, home, mask, n, pack_parts(extra))

    def last(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return job.schema.empty_table()
        home = Home(table)
        copied, mask, flagged = unpack_parts(next((x for x in answered.column("extra").to_pylist() if x), b""), 3)
        mask = unpack_mask(mask, job.starts(home))
        if mask.any():
            hit = repeated_windows(job, home, mask, n, answered)
            mask[np.flatnonzero(mask)[~hit]] = False
        if copied:
            mask |= np.repeat(unpack_mask(copied, len(home.texts)), [len(t) for t in home.texts])
        return job.finish(home, mask, np.frombuffer(zlib.decompress(flagged), np.uint32) if flagged else np.zeros(len(home.texts), np.uint32))

    told = dealt.groupBy("home").applyInArrow(first, SENT).groupBy("bucket").applyInArrow(resolver(SEED, texts=job.silence_copies), SENT)
    named = dealt.groupBy("home").cogroup(told.groupBy("home")).applyInArrow(second, SENT)
    settled = named.groupBy("bucket").applyInArrow(resolver(WINDOW, ("u2", "i8") if job.ranked else ("u2",)), SENT)
    return dealt.groupBy("home").cogroup(settled.groupBy("home")).applyInArrow(last, ddl)
