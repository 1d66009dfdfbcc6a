"""Importance resampling towards a target distribution, over an integer word dictionary.

A block of texts gets a dictionary of its distinct words; an n-gram is a tuple of their integer
ids. Each distinct tuple's bytes are put together again from the dictionary and hashed once, and
its counts are joined back to that hash, by documents and over all. Ratios of the hash buckets
between the target and all documents weigh the documents, and seeded Gumbel noise turns the
largest weights into a draw without replacement.

Dictionaries are those of blocks, not of the corpus: the tail of rare words grows with the corpus,
and looking words up in one dictionary would move every word of every block over the network and
back, where only counts of ``buckets`` numbers a task are needed.

A null text is empty; a document without words has weight 0 and stays. Rows that repeat an id
are separate documents; a null id draws as the text ``null`` and comes last among ties. Rows
equal in everything take neighbouring ranks. An empty table gives no rows; an empty target gives
every bucket its smoothed ratio. Only the id and text columns are read, so no column can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, in_chunks, shared_table, text_bytes

#: Text bytes of a block, unless one text is longer.
BLOCK = 8 * CHUNK

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SOLID = np.zeros(256, bool)
_SOLID[0x30:0x3A] = _SOLID[0x61:0x7B] = _SOLID[0x80:] = True


def word_array(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of joined texts, and the text of each."""
    low = _LOWER[data]
    solid = _SOLID[low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inside = bounds[:-1][bounds[:-1] < len(data)]
    first[inside] |= solid[inside]
    starts = np.flatnonzero(first)
    places = np.cumsum(solid) - 1  # of each byte among those of words
    offsets = np.append(places[starts], solid.sum()).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])])
    return words, np.searchsorted(bounds, starts, "right") - 1


def block_features(data: np.ndarray, bounds: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each n the bucket of every n-gram and the text that it is in."""
    words, doc = word_array(data, bounds)
    coded = words.dictionary_encode()
    code, dictionary = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    out = []
    at, ids = np.arange(len(code)), np.arange(len(dictionary))  # places of n-grams, and for each of their names a tuple of word ids
    name, tuples = code.astype(np.int64), ids[:, None]
    for n in range(1, longest + 1):
        if n > 1:
            more = at[at + n - 1 < len(code)]
            more = more[doc[more] == doc[more + n - 1]]
            longer = name[: len(at)][np.searchsorted(at, more)] * len(dictionary) + code[more + n - 1]
            found, name = np.unique(longer, return_inverse=True)
            tuples = np.hstack([tuples[found // max(len(dictionary), 1)], (found % max(len(dictionary), 1))[:, None]])
            at = more
        spelled = dictionary if n == 1 else (b" ".join([dictionary[i] for i in ids]) for ids in tuples.tolist())
        hashes = np.fromiter(map(zlib.crc32, spelled), np.int64, len(tuples)) % buckets
        out.append((hashes[name], doc[at]))
    return np.bincount(doc, minlength=len(bounds) - 1), out


def texts_of(df: DataFrame) -> DataFrame:
    return df.select(text_bytes(F.col("text").cast("string")).alias("text"))


def bucket_counts(df: DataFrame, name: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, name): features of all texts; a task sends one number a bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, bounds in in_chunks(batch.column(0), BLOCK):
                for hashes, _ in block_features(data, bounds, longest, buckets)[1]:
                    total += np.bincount(hashes, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int32()), "n": pa.array(total[met])})

    return texts_of(df).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed ratio of target to documents, floored."""
    both = bucket_counts(docs, "s", longest, buckets).join(bucket_counts(target, "t", longest, buckets), "bucket", "full")
    filled = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    all_ = Window.partitionBy()  # at most ``buckets`` rows
    ratio = (F.col("t") + 1) * (F.sum("s").over(all_) + buckets) / ((F.col("s") + 1) * (F.sum("t").over(all_) + buckets))
    out = np.zeros(buckets, np.int64)
    for r in filled.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def features_of(words: Column, longest: int) -> Column:
    """Number of runs of 1 to ``longest`` of so many words."""
    return sum((F.greatest(words - n, F.lit(0).cast("long")) for n in range(longest)), F.lit(0).cast("long"))


def noise(seed: str, doc_id: Column) -> Column:
    """1000 times the standard Gumbel variable of a document, floored."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def document_weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document; texts are read twice and not moved."""
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(docs, target, longest, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for data, bounds in in_chunks(batch.column(1), BLOCK):
                sizes, features = block_features(data, bounds, longest, buckets)
                gained = np.zeros(len(sizes), np.int64)
                for hashes, doc in features:
                    np.add.at(gained, doc, gains.value[hashes])
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(at, len(sizes)), "n_words": pa.array(sizes, pa.int64()), "gained": pa.array(gained)})
                at += len(sizes)

    pair = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text").cast("string")).alias("text"))
    n = features_of(F.col("n_words"), longest)
    weight = F.when(n > 0, F.expr("(gained - pmod(gained, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return pair.mapInArrow(run, "doc_id long, n_words long, gained long").withColumn("n_features", n).select("doc_id", "n_words", "n_features", weight.alias("weight"))


def importance_resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null where it isn't drawn.

    Of the documents with ``least_words`` words or more, ``percent`` of 100 are drawn. Scores are
    whole numbers within some 60,000 of each other (gains are thousandths of logarithms of
    ratios, and so is the noise), whatever the input: their histogram finds the last score that is
    drawn and the place of each, and only ties of one score are ordered.
    """
    weights = document_weights(docs, target, longest, buckets)
    same = weights.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))).groupBy("doc_id", "n_words", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("copies"))
    scored = shared_table(same)
    down = Window.orderBy(F.col("score").desc())
    histogram = scored.filter(F.col("n_words") >= least_words).groupBy("score").agg(F.sum("copies").alias("n"))
    upto = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = histogram.select(F.col("score").alias("at_score"), (upto - F.col("n")).alias("before"), F.expr(f"{percent} * sum(n) over () div 100").alias("drawn")).filter("before < drawn")
    met = scored.join(F.broadcast(places), (F.col("score") == F.col("at_score")) & (F.col("n_words") >= least_words), "left")
    ties = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "weight")
    last = F.col("before") + F.sum("copies").over(ties.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    drawn = met.filter("before is not null").withColumn("last", last)
    rest = met.filter("before is null").withColumn("last", F.lit(None).cast("long"))
    each = drawn.unionByName(rest).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    place = F.col("last") - F.col("copies") + F.col("copy")
    return each.select("doc_id", "n_words", "n_features", "weight", "score", F.when(place <= F.col("drawn"), place).alias("rank"))
