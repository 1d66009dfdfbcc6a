"""Speaker pairs, parallel utterances and evaluation pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import shuffled


#: Tasks that the cells of ``parallel_by_name`` are dealt to at most.
MOST_TASKS = 20_000


def speaker_pairs(speakers: DataFrame, name: str = "speaker") -> DataFrame:
    """All ordered pairs of different speakers (J1, P4): as many rows as the result needs."""
    a = speakers.select(F.col(name).alias("source")).distinct()
    b = speakers.select(F.col(name).alias("target")).distinct()
    return a.join(b, F.col("source") != F.col("target"))


#: Pairs that a task makes of one name, about.
CELL = 4_000_000

#: Copies of rows that a task makes for the cells, about.
COPIES = 500_000


def parallel_by_name(source: DataFrame, target: DataFrame, name: str = "file_name", cell: int = CELL, copies: int = COPIES) -> DataFrame:
    """Utterances of one file name on both sides; a name that repeats pairs with each of its like.

    A name with many pairs is cut into cells of about ``cell``: both sides are dealt to as many
    parts as keep the copies that are sent few, and cells go to tasks by number, as their input is
    small beside their output. Rows are spread before they are copied, about ``copies`` a task,
    as a small file is one task; the copies are many times the rows that Spark's estimate goes
    by, so they are never broadcast. In a cell the rows of the longer side pass by those of the
    shorter, so that what is held and what a writer's dictionary sees again is little.
    """
    spark = source.sparkSession
    count = lambda side, c: side.groupBy(name).agg(F.count(F.lit(1)).alias(c))
    sizes = count(source, "_ns").join(count(target, "_nt"), name, "full")
    cells = F.ceil(F.col("_ns") * F.col("_nt") / F.lit(float(cell)))
    rows = F.least(cells, F.col("_ns"), F.greatest(F.lit(1), F.ceil(F.sqrt(cells * F.col("_ns") / F.col("_nt")))))
    parts = sizes.filter(cells > 1).select(name, rows.cast("int").alias("_a"), F.ceil(cells / rows).cast("int").alias("_b"))
    a, b = (F.when(cells > 1, n.cast("long")).otherwise(1) for n in (rows, F.ceil(cells / rows)))
    total, lefts, rights, shorter = sizes.agg(F.sum(F.when(cells > 1, a * b)), F.sum(F.col("_ns") * b), F.sum(F.col("_nt") * a), F.sum("_ns") < F.sum("_nt")).first()
    if not total:
        return source.join(target, name)
    tasks = min(max(total, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)
    parts = F.broadcast(parts)  # names of more than ``cell`` pairs are few
    one = {"_a": F.coalesce("_a", F.lit(1)), "_b": F.coalesce("_b", F.lit(1))}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda side, n: F.pmod(F.xxhash64(*[F.col(c) for c in side.columns]), F.col(n)).cast("int")
    spread = lambda side, n: side.repartition(-(-n // copies)).join(parts, name, "left").withColumns(one)
    s, t = spread(source, lefts), spread(target, rights)
    left = s.select(*source.columns, own(source, "_a").alias("_i"), every("_b").alias("_j")).repartition(tasks, name, "_i", "_j")
    right = t.select(*target.columns, own(target, "_b").alias("_j"), every("_a").alias("_i")).repartition(tasks, name, "_i", "_j")
    held, passing = (left.alias("s"), right.alias("t")) if shorter else (right.alias("t"), left.alias("s"))
    same = [F.col(f"s.`{c}`") == F.col(f"t.`{c}`") for c in (name, "_i", "_j")]
    rest = [F.col(f"{x}.`{c}`") for x, side in (("s", source), ("t", target)) for c in side.columns if c != name]
    return passing.hint("merge").join(held, same).select(F.col(f"s.`{name}`"), *rest)


def parallel_by_number(utterances: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """(source, target, utt_no, s_utt, t_utt) of different speakers who both read a sentence."""
    rows = utterances if numbers is None else utterances.filter(F.col("utt_no").isin(numbers))
    a = rows.select("utt_no", F.col("speaker").alias("source"), F.col("utt").alias("s_utt"))
    b = rows.select("utt_no", F.col("speaker").alias("target"), F.col("utt").alias("t_utt"))
    return a.join(b, "utt_no").filter("source <> target")


def with_map(evaluation: DataFrame, maps: DataFrame) -> DataFrame:
    """Evaluation pairs with their learned map (J6); a pair without one is an error when it is met."""
    joined = evaluation.join(maps.withColumn("_known", F.lit(True)), ["source", "target"], "left")
    check = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no map for "), F.col("source"), F.lit(" and "), F.col("target"))).cast("boolean"))
    return joined.filter(check).drop("_known")


def existing(pairs: DataFrame, files: DataFrame, columns: tuple[str, ...] = ("source_path", "target_path"), name: str = "path") -> DataFrame:
    """Pairs all of whose files exist."""
    listed = files.select(name).distinct()
    for column in columns:
        pairs = pairs.join(listed.withColumnRenamed(name, column), column, "left_semi")
    return pairs


def missing(pairs: DataFrame, files: DataFrame, column: str, name: str = "path") -> DataFrame:
    """Rows whose file is absent (S13), to be reported."""
    return pairs.join(files.select(F.col(name).alias(column)).distinct(), column, "left_anti")


def first_existing(pairs: DataFrame, n: int = 5, start: int = 50, number: str = "utt_no", by: tuple[str, ...] = ("source", "target"), ties: tuple[str, ...] = ()) -> DataFrame:
    """Per (source, target), the first ``n`` utterance numbers from ``start`` on (T5); equal numbers come in order of ``ties``."""
    order = Window.partitionBy(*by).orderBy(number, *ties)
    return pairs.filter(F.col(number) >= start).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def first_parallel(utterances: DataFrame, n: int = 5, start: int = 50) -> DataFrame:
    """``first_existing`` of ``parallel_by_number`` with ties by (s_utt, t_utt), without all pairs of a sentence.

    The first n pairs of a sentence are made of the first n readings of either speaker, so no
    speaker needs more than n readings of a sentence to be joined.
    """
    place = F.row_number().over(Window.partitionBy("speaker", "utt_no").orderBy("utt"))
    few = utterances.select("speaker", "utt_no", "utt").filter(F.col("utt_no") >= start).withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")
    return first_existing(parallel_by_number(few), n, start, ties=("s_utt", "t_utt"))


def drop_first(utterances: DataFrame, n: int = 25, by: str = "speaker", order: str = "utt") -> DataFrame:
    """All but each speaker's first ``n`` utterances (T4)."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return utterances.withColumn("_n", place).filter(F.col("_n") > n).drop("_n")


def random_partner(utterances: DataFrame, seed: str = "13", by: str = "speaker", key: str = "utt") -> DataFrame:
    """Each utterance with another one of its speaker.

    Utterances stand in a circle in a seeded random order and take the next one: one window, no
    pairs within a speaker. A speaker's only utterance has no partner and is left out.
    """
    circle = Window.partitionBy(by).orderBy(shuffled(seed, F.col(key)), key)
    whole = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    partner = F.coalesce(F.lead(key).over(circle), F.first(key).over(whole))
    return utterances.withColumn("partner", partner).filter(F.col("partner") != F.col(key))


def evaluation_pairs(utterances: DataFrame, n: int = 5, start: int = 50, skip: int = 25, seed: str = "13") -> DataFrame:
    """(source, target, output_fn, reference_fn, label): conversions (0) and same-speaker truths (1).

    ``utterances`` has (speaker, utt_no, utt); a file is ``speaker/utt.wav``. Each ordered pair
    of speakers takes the first ``n`` sentences from ``start`` on that both have: the conversion
    ``source-target/utt.wav`` against the target's file, label 0. Beside these it takes the
    source's first ``n`` own sentences from ``start`` on, each against another file of the source
    that a hash of (seed, pair, utterance) draws from those after its first ``skip`` by name,
    label 1. Speakers with fewer sentences give as many rows as there are; a sentence without
    another file to draw gives none.
    """
    rows = utterances.select("speaker", "utt_no", "utt")
    wav = lambda folder, name: F.concat(folder, F.lit("/"), name, F.lit(".wav"))
    source, target = F.col("source"), F.col("target")
    both = first_parallel(rows, n, start)
    converted = both.select("source", "target", wav(F.concat_ws("-", "source", "target"), F.col("s_utt")).alias("output_fn"), wav(target, F.col("t_utt")).alias("reference_fn"), F.lit(0).alias("label"))

    by_name = Window.partitionBy("speaker").orderBy("utt", "utt_no")
    choices = rows.withColumn("place", F.row_number().over(by_name) - 1 - skip).filter("place >= 0").select(F.col("speaker").alias("source"), "place", "utt", "utt_no")
    count = choices.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    own = first_existing(rows, n, start, by=("speaker",), ties=("utt",)).select(F.col("speaker").alias("source"), "utt", "utt_no")
    own = own.join(choices, ["source", "utt", "utt_no"], "left").join(count, "source").join(speaker_pairs(rows), "source")
    # one choice less if the utterance is itself among them: places from its own on move up
    left = F.col("n") - F.when(F.col("place").isNull(), 0).otherwise(1)
    drawn = F.conv(F.substring(shuffled(seed, F.concat_ws(":", "source", "target", "utt")), 1, 8), 16, 10).cast("long") % F.when(left > 0, left)
    own = own.withColumn("drawn", drawn).withColumn("drawn", F.col("drawn") + F.when(F.col("drawn") >= F.col("place"), 1).otherwise(0))
    partner = choices.select("source", F.col("place").alias("drawn"), F.col("utt").alias("partner"))
    truth = own.select("source", "utt", "drawn").join(partner, ["source", "drawn"])
    truth = truth.select("source", source.alias("target"), wav(source, F.col("utt")).alias("output_fn"), wav(source, F.col("partner")).alias("reference_fn"), F.lit(1).alias("label"))
    return converted.unionByName(truth)
