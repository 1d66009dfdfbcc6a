"""Shared pieces of the training-data operators.

Nulls and duplicates are treated alike everywhere: a null text is an empty text, rows that
repeat a ``doc_id`` are separate documents, and columns other than the named id and text
columns are never read, so extra columns cannot clash with an operator's own names.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word as a Java and Python pattern, and the six bytes that separate words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: id that stands for a null doc_id: larger than every other.
NULL_ID = np.iinfo(np.int64).max


def shuffle_partitions(spark: SparkSession) -> int:
    """The cluster's own sizing hint; every fan-out below is a multiple of it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where all run on this machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``shared_table`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if re.search(r"/tables/[0-9a-f]{32}$", path):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def shared_table(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows, whole in one column ``row``, beside named columns: no name of theirs can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *(c.alias(name) for name, c in columns.items()))


def text_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def words(text: Column) -> Column:
    """Native array of a text's words; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != F.lit(""))


# ---------------------------------------------------------------- numpy hashing

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: One random-looking 64-bit symbol for each byte, from the finaliser.
BYTE_SYMBOL = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

#: Words up to so many bytes are named together, longer ones one by one.
SHORT = 32


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit name of each word ``data[start:end]``; equal words have equal names."""
    size = ends - starts
    order = np.argsort((SHORT + 1 - np.minimum(size, SHORT + 1)).astype(np.uint8), kind="stable")
    at, left = starts[order], size[order]
    first = int(np.searchsorted(-left, -SHORT, "left"))
    out = np.empty(len(starts), np.uint64)
    text = memoryview(np.ascontiguousarray(data))
    out[order[:first]] = np.fromiter((xxhash.xxh3_64_intdigest(text[a : a + n]) for a, n in zip(at[:first].tolist(), left[:first].tolist(), strict=True)), np.uint64, first)
    at, left = at[first:], left[first:]
    h = left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    # the words are in order of size, so those with a k-th byte come first
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))
        part = h[:n]
        part ^= BYTE_SYMBOL[data[at[:n] + k]]
        part *= _M1
        part ^= part >> np.uint64(32)
    out[order[first:]] = mix(h)
    return out


def chain(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit name of each range ``symbols[start:end]``, one symbol after the other."""
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
    for k in range(int(size.max()) if len(size) else 0):
        some = np.flatnonzero(size > k) if (size <= k).any() else slice(None)
        part = (h[some] ^ symbols[starts[some] + k]) * _M2
        h[some] = part ^ (part >> np.uint64(32))
    return mix(h)


def split_words(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc index) of every word in concatenated documents."""
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inside = doc_starts[doc_starts < len(data)]
    first[inside] |= solid[inside]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(doc_starts, starts, "right") - 1


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the cells that one of the ranges covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


#: Text bytes that one vectorised step works on.
CHUNK = 1 << 19


def in_chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Joined bytes and bounds of runs of texts, out of Arrow's own buffers; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j
