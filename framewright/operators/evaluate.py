"""Equal error rate, word and character error rates, and their spreads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..stored import stored


#: Slices that a group of many scores is cut into at most, and distinct scores of a slice that make another worth while.
SLICES, SLICE = 1024, 100_000


def eer(scores: DataFrame, by: Sequence[str] = ("tgt_speaker",), score: str = "score", label: str = "label", slice_size: int = SLICE) -> DataFrame:
    """(by, eer): where the false positive and false negative rates meet; label 1 scores low.

    Ties count together. Closed form on the ROC polyline: the first point with fpr + tpr >= 1 and
    the one before it. Running counts are made in slices: approximate percentiles cut a group of
    more than ``slice_size`` distinct scores into ranges, each of which is summed by itself and
    raised by the totals of those before, so that no group is sorted in one task. A group without
    both labels has a null rate.
    """
    by = list(by)
    counts = scores.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    cuts = F.percentile_approx("s", [i / SLICES for i in range(1, SLICES)])
    step = F.greatest(F.lit(1), F.ceil(F.lit(SLICES) * F.lit(slice_size) / F.count(F.lit(1))).cast("int"))
    groups = counts.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("q").alias("nq"), F.array_distinct(cuts).alias("cuts"), step.alias("step"))
    groups = groups.withColumn("cuts", F.filter("cuts", lambda c, i: (i + 1) % F.col("step") == 0)).drop("step")
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"c.{k}")) for k in by]
    placed = counts.alias("c").join(groups.alias("g"), reduce(and_, same), "inner") if by else counts.alias("c").join(groups.alias("g"))
    placed = placed.select("c.*", "np", "nq", F.size(F.filter("cuts", lambda c: c < F.col("s"))).alias("slice"))
    totals = placed.groupBy(*by, "slice").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("slice").alias("_slice"), F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("op"), F.coalesce(F.sum("tq").over(before), F.lit(0)).alias("oq"))
    up = Window.partitionBy(*by, "slice").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({"cp": F.sum("p").over(up), "cq": F.sum("q").over(up)})
    summed = summed.join(offsets, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*by, "slice"]]))
    share = lambda n, of: F.try_divide(n.cast("double"), F.col(of))
    cp, cq = F.col("cp") + F.col("op"), F.col("cq") + F.col("oq")
    rates = summed.select(*by, share(cq, "nq").alias("fpr"), share(cp, "np").alias("tpr"), share(cq - F.col("q"), "nq").alias("f0"), share(cp - F.col("p"), "np").alias("t0"))
    crossing = rates.filter("fpr + tpr >= 1 and f0 + t0 < 1")
    rate = F.col("f0") + (1 - F.col("f0") - F.col("t0")) / (F.col("fpr") + F.col("tpr") - F.col("f0") - F.col("t0")) * (F.col("fpr") - F.col("f0"))
    return groups.select(*by).join(crossing.select(*by, rate.alias("eer")), by, "left") if by else crossing.select(rate.alias("eer"))


def eer_summary(rates: DataFrame) -> DataFrame:
    """Unweighted mean and sample deviation over groups."""
    return rates.agg(F.avg("eer").alias("mean_eer"), F.stddev_samp("eer").alias("std_eer"))


def zero_positive(scores: DataFrame, label: str = "label") -> DataFrame:
    """Labels the other way round (P10)."""
    return scores.withColumn(label, 1 - F.col(label))


def error_counts(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", words: bool = True, strip: bool = False) -> DataFrame:
    """Rows with edits and ref_len after normalisation, by words or by characters; a null text is empty."""
    ref, hyp = (text.normalise(F.coalesce(F.col(c), F.lit("")), strip) for c in (reference, hypothesis))
    if words:
        ref, hyp = text.word_array(ref), text.word_array(hyp)
        return pairs.withColumns({"edits": text.word_edits(ref, hyp), "ref_len": F.size(ref).cast("long")})
    return pairs.withColumns({"edits": text.char_edits(ref, hyp), "ref_len": F.length(ref).cast("long")})


def corpus_rate(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of edits over sum of reference lengths."""
    return counts.groupBy(*by).agg(F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_len")).withColumn("rate", F.try_divide(F.col("edits").cast("double"), F.col("ref_len")))


def bootstrap_index(spark: SparkSession, n: int, resamples: int = 100, seed: str = "13", draws: int | None = None) -> DataFrame:
    """(rep, idx, times): seeded resamples of n rows with replacement (R3), of n draws or of ``draws``, drawn by a hash where the rows are counted."""
    draws = n if draws is None else draws
    drawn = spark.range(draws * resamples).select(F.expr(f"id div {max(draws, 1)}").cast("int").alias("rep"), (F.col("id") % max(draws, 1)).alias("draw"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), "rep", "draw").cast("binary"))
    place = F.conv(F.right(digest, F.lit(15)), 16, 10).cast("long") % max(n, 1)
    return drawn.groupBy("rep", place.alias("idx")).agg(F.count(F.lit(1)).alias("times"))


def bootstrap_rate(counts: DataFrame, index: DataFrame, idx: str = "idx") -> DataFrame:
    """Mean and population deviation, in percent, of the rate over resamples.

    Edits are counted once a row; a resample only weighs them.
    """
    drawn = index.join(counts.select(F.col(idx).alias("idx"), "edits", "ref_len"), "idx")
    rates = drawn.groupBy("rep").agg(F.try_divide(F.sum(F.col("edits") * F.col("times")).cast("double"), F.sum(F.col("ref_len") * F.col("times"))).alias("rate"))
    return rates.agg((100 * F.avg("rate")).alias("mean_percent"), (100 * F.stddev_pop("rate")).alias("std_percent"))


#: Rows that draw together.
DRAW_BLOCK = 1 << 16


def resampled_sums(counts: DataFrame, resamples: int = 100, seed: int = 13, block: int = DRAW_BLOCK) -> DataFrame:
    """(rep, draws, edits, ref_len): sums over seeded resamples with replacement, drawn where the rows lie.

    A resample's draws are first split between stored partitions, then between a partition's blocks
    of rows, then between a block's rows, by multinomial draws all along: the distribution is that of
    drawing from all rows, but only one row each and ``resamples`` sums a task are shuffled, not
    ``resamples`` draws a row. The driver sees the partitions' sizes.
    """
    inner = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = counts.select(F.col("edits").cast("long").alias("edits"), F.col("ref_len").cast("long").alias("ref_len"))
    placed = stored(rows.withColumns({"part": F.spark_partition_id(), "block": F.floor(inner / block)}))
    sizes = dict(sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect()))
    total = sum(sizes.values())
    shares = np.array(list(sizes.values()), float) / max(total, 1)
    drawn = np.random.default_rng(seed).multinomial(total, shares, size=resamples) if sizes else np.zeros((resamples, 0), int)
    of = placed.sparkSession.sparkContext.broadcast({part: (n, drawn[:, i]) for i, (part, n) in enumerate(sizes.items())})

    def run(table: pa.Table) -> pa.Table:
        part, nth, n = table.column("part")[0].as_py(), table.column("block")[0].as_py(), table.num_rows
        size, draws = of.value[part]
        blocks = np.diff(np.append(np.arange(0, size, block), size)) / size
        own = np.random.default_rng([seed, part]).multinomial(draws, blocks)[:, nth]
        order = np.lexsort((table.column("ref_len").to_numpy(), table.column("edits").to_numpy()))
        values = [table.column(c).to_numpy()[order] for c in ("edits", "ref_len")]
        rng = np.random.default_rng([seed, part, nth + 1])
        sums = [[int(k), *(int(v @ times) for v in values)] for k in own for times in [np.bincount(rng.integers(0, n, k), minlength=n)]]
        return pa.table({"rep": pa.array(range(len(sums)), pa.int32()), **{c: pa.array([x[i] for x in sums], pa.int64()) for i, c in enumerate(("draws", "edits", "ref_len"))}})

    parts = placed.groupBy("part", "block").applyInArrow(run, "rep int, draws long, edits long, ref_len long")
    return parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("draws", "edits", "ref_len")])


def resampled_rate(sums: DataFrame) -> DataFrame:
    """Mean and population deviation, in percent, of the rate over resamples."""
    rates = sums.select(F.try_divide(F.col("edits").cast("double"), F.col("ref_len")).alias("rate"))
    return rates.agg((100 * F.avg("rate")).alias("mean_percent"), (100 * F.stddev_pop("rate")).alias("std_percent"))
