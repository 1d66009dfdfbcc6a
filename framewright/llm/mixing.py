"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source is a hash of its id. Sizes are summed by source and hash bucket;
the running sums show the bucket in which the source's budget ends; only that bucket is summed
again by the next hash bits, and so on. The budget thus becomes one hash threshold per source and
the mix is a filter: no sort, no shuffle of texts, and budgets that grow take supersets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, shared_checkpoint

#: Hash bits that each histogram adds, and the number of histograms: thresholds have 30 bits.
BITS, LEVELS = 10, 3
#: Sources up to which the table of thresholds (64 bytes a source) is broadcast.
BROADCAST_SOURCES = 100_000


def place(key: Column, text: Column) -> Column:
    """BITS * LEVELS uniform bits of an MD5, which SQL elsewhere repeats; a row without id is placed by its text."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), text)).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - BITS * LEVELS)


def join_sources(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with their source's line of a checkpointed table, broadcast if it is small."""
    side = table.withColumnRenamed("source", "its_source")
    if side.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, rows["source"].eqNullSafe(side["its_source"])).drop("its_source")


def targets(totals: DataFrame, share: float, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` of
    all sizes; none gets over ``cap`` times its size, the excess going to the others by weight.
    That is a common level: a source gets level x weight or its cap, whichever is less.
    """
    ranked = totals.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(table, (F.col("n") % len(weights)).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rising = Window.orderBy(F.col("most") / F.col("weight"), "n")
    everyone = Window.partitionBy()
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if all sources before this one are held at their caps
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("level", level)
    uncapped = F.min(F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("n"), F.col("level")))).over(everyone)
    target = F.coalesce(F.least(F.col("most"), uncapped["level"] * F.col("weight")), F.col("most"))
    return levelled.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: Sequence[float] = (3, 1, 2), cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): each row's id, source, place and size; each source's target and threshold.

    A row is taken ``base`` times, and once more if its place lies below ``threshold``.
    """
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    rows = shared_checkpoint(docs.select(key.alias("doc_id"), F.col(source_col).cast("string").alias("source"), place(key, text).alias("place"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, share, weights, cap)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("base", base).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")).withColumn("threshold", F.lit(0).cast("long"))
    plan = shared_checkpoint(plan)
    for level in range(1, LEVELS + 1):
        rest = BITS * (LEVELS - level)
        bucket = F.shiftright(F.col("place"), rest)
        # within the boundary bucket of the level before: all rows on the first level
        inside = F.shiftright(F.col("place"), rest + BITS) == F.shiftright(F.col("threshold"), rest + BITS)
        hist = join_sources(rows, plan).filter(inside).groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"))
        running = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        ends = hist.withColumn("after", running).filter(F.col("after") > F.col("budget"))
        # nearest: the last level takes or leaves the boundary bucket whole
        edge = F.min(F.struct("bucket", F.col("after"), F.col("n")))
        ends = ends.groupBy("source").agg(edge.alias("edge"))
        plan = plan.join(ends.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source")), "left").drop("its_source")
        start = F.shiftleft(F.col("edge.bucket"), rest)
        left = F.col("budget") - (F.col("edge.after") - F.col("edge.n"))
        if level == LEVELS:
            start = F.when(left * 2 >= F.col("edge.n"), start + 1).otherwise(start)
        open_ended = F.shiftleft(F.shiftright(F.col("threshold"), rest + BITS) + 1, rest + BITS)
        plan = plan.withColumns({"threshold": F.coalesce(start, open_ended), "budget": F.coalesce(left, F.lit(0.0))}).drop("edge")
        plan = shared_checkpoint(plan)
    return rows, plan


def copies_of(at: Column, base: str, threshold: str, cap: float) -> Column:
    return F.least(F.col(base) + F.when(at < F.col(threshold), 1).otherwise(0), F.lit(math.ceil(cap))).cast("int")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: Sequence[float] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """How often the mix takes every row.

    One row per input row: doc_id, source, size (words), source_size, target (its source's words
    in the mix), copies (0 to ``cap``), taken (size x copies). A null text has no words; null is a
    source like others, the last in order; null ids are placed by their text; rows that repeat an
    id share its decision; an empty table gives no rows; other columns are not read.
    """
    rows, plan = mix_plan(docs, id_col, text_col, source_col, share, weights, cap)
    out = join_sources(rows, plan)
    copies = copies_of(F.col("place"), "base", "threshold", cap)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: Sequence[float] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """The mix itself: whole rows of ``docs``, each as often as ``mix_sources`` takes it.

    Texts are not shuffled. Nulls, ties, repeated rows and empty tables are as in ``mix_sources``;
    other columns come along whatever their names.
    """
    _, plan = mix_plan(docs, id_col, text_col, source_col, share, weights, cap)
    side = plan.select(F.col("source").alias("its_source"), "base", "threshold")
    if side.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    at = place(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    rows = packed(docs, source=F.col(source_col).cast("string"), at=at)
    joined = rows.join(side, rows["source"].eqNullSafe(side["its_source"]))
    taken = joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies_of(F.col("at"), "base", "threshold", cap))))
    return taken.select("row.*")
