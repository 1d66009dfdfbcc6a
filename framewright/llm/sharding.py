"""Sharding by weighted rendezvous hashing, with native functions only.

Each shard scores each key by ``-weight / ln(u)``, u being a uniform number from a hash of key
and shard; the best score takes the key. A new shard changes only the keys that it wins, a
removed one only its own, and shares follow the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed

#: Hash chunks of a shard in which slots are counted; bounds both a window group and the broadcast of offsets.
CHUNKS = 1024


def score(key: Column, shard: int, weight: float) -> Column:
    """A shard's score for a key, from 52 bits of an MD5, which SQL elsewhere repeats."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.lit(float(weight)) / F.ln((drawn + 0.5) / F.lit(float(1 << 52)))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """(score, shard) of the shard that wins the key; the higher number on equal scores."""
    live = [(s, w) for s, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight")
    scored = [F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in live]
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def rendezvous_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 24, new_weight: float = 1.0, chunks: int = CHUNKS, whole: bool = False) -> DataFrame:
    """Every row's shard, its place there, and its shard if one more were added.

    One row per input row: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard,
    slot (0, 1, 2 ... within the shard), grown_shard (with a further shard of ``new_weight``, over 0).
    The shard depends on the id and the weights alone. Null ids are one key, so they share a
    shard; a null text has no bytes; repeated rows share a shard and take slots of their own; an
    empty table gives no rows; other columns are not read, but if ``whole`` the input row comes
    along as the struct ``row``.

    Slots are gapless without a shard's rows meeting in a task: rows are numbered in hash chunks
    of a shard, and a chunk's offset is the sum of the counts before it (shards x chunks numbers,
    the only data broadcast).
    """
    data = F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).cast("binary")
    key = F.col(f"row.`{id_col}`").cast("long")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    chunk = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("slot"), name, F.crc32(data)).cast("binary")), 1, 8), 16, 10).cast("long") % chunks
    carry = ["row"] if whole else []
    rows = packed(docs).select(
        *carry,
        key.alias("doc_id"),
        (F.octet_length(data) + F.lit(8)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        winner(name, weights).alias("won"),
        score(name, len(weights), new_weight).alias("new"),
        chunk.cast("int").alias("chunk"),
    )
    grown = F.when(F.col("new") >= F.col("won.score"), F.lit(len(weights))).otherwise(F.col("won.shard"))
    rows = rows.select(*carry, "doc_id", "size", "text_crc32", F.col("won.shard").alias("shard"), grown.alias("grown_shard"), "chunk")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "chunk").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "chunk"]).select(*carry, "doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("offset")).cast("long").alias("slot"), "grown_shard")


def sharded_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 24, new_weight: float = 1.0) -> DataFrame:
    """The rows of ``docs``, whole, with shard, slot and grown_shard, which take the place of columns of these names."""
    new = ["shard", "slot", "grown_shard"]
    out = rendezvous_shards(docs, id_col, text_col, weights, new_weight, whole=True)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in new], *new)


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder a shard, its rows in ``files_per_shard`` files. No rows give no folder; nulls and repeats are written as they are."""
    spread = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    sharded.repartition(F.col("shard"), spread).write.partitionBy("shard").parquet(path)
