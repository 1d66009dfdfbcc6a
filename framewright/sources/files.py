"""Scans of listings, lists, evaluation tables, transcripts and segments."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths

EVALUATION = T.StructType([T.StructField(n, T.StringType()) for n in ("src_speaker", "tgt_speaker", "x_path", "y_path")] + [T.StructField("label", T.IntegerType())])


def listing(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, length) of all files below ``root`` with the suffix, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", "length")


def speaker_listing(spark: SparkSession, root: str, suffix: str, depth: int = 2) -> DataFrame:
    """(speaker, utt, path, length); the speaker is the folder ``depth`` levels above the end of the path."""
    files = listing(spark, root, suffix)
    return files.select(F.element_at(paths.parts(F.col("path")), -depth).alias("speaker"), paths.stem(F.col("path")).alias("utt"), "path", "length")


def ids_of(lines: DataFrame, column: str = "value", name: str = "speaker") -> DataFrame:
    """One id a line, trimmed; null and blank lines are no ids."""
    return lines.select(F.trim(column).alias(name)).filter(F.col(name) != "")


def id_list(spark: SparkSession, path: str, name: str = "speaker") -> DataFrame:
    """The ids of a text file (S3)."""
    return ids_of(spark.read.text(path), name=name)


def exclusion_set(spark: SparkSession, path: str, name: str = "utt") -> DataFrame:
    """Distinct ids of a list."""
    return id_list(spark, path, name).distinct()


def evaluation_table(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation pairs by position under either header (S5a); ids stay strings."""
    return spark.read.csv(path, header=True, schema=EVALUATION, enforceSchema=True)


def converted_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of lines that end in 0, split into exactly five fields (S5b); the header ends otherwise."""
    line = F.trim(F.col(column))
    fields = F.split(line, ",")
    rows = lines.filter(line.endswith("0")).select(F.when(F.size(fields) == 5, fields).otherwise(F.raise_error(F.concat(F.lit("not five fields: "), line))).alias("f"))
    return rows.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(EVALUATION.fieldNames()[:4])], F.get("f", F.lit(4)).cast("int").alias("label"))


def keyed_lines(lines: DataFrame, column: str = "value", *keys: str) -> DataFrame:
    """(keys, utt_key, text): first word and the rest joined by single spaces."""
    words = F.filter(F.split(F.trim(F.col(column)), r"\s+"), lambda w: w != "")
    rows = lines.select(*keys, words.alias("w")).filter(F.size("w") > 0)
    return rows.select(*keys, F.get("w", F.lit(0)).alias("utt_key"), F.array_join(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), " ").alias("text"))


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(utt_key, text) of all ``*.trans.txt`` below ``root``."""
    return keyed_lines(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.trans.txt").text(root))


def last_lines(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(utt_key, text): a file's stem and its last line, null for an empty file."""
    lines = F.split(F.regexp_replace(F.col(text), r"(\r?\n)+$", ""), r"\r?\n")
    last = F.trim(F.element_at(lines, -1))
    return texts.select(paths.stem(F.col(path)).alias("utt_key"), F.when(last != "", last).alias("text"))


def file_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(utt_key, text) of one text file per utterance."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    return last_lines(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def segment_lines(lines: DataFrame, column: str = "value", *keys: str) -> DataFrame:
    """(keys, start_sample, end_sample, phone) of lines of three fields."""
    f = F.split(F.trim(F.col(column)), " ")
    rows = lines.select(*keys, f.alias("f")).filter(F.size("f") == 3)
    return rows.select(*keys, F.get("f", F.lit(0)).cast("long").alias("start_sample"), F.get("f", F.lit(1)).cast("long").alias("end_sample"), F.get("f", F.lit(2)).alias("phone"))


def segments(spark: SparkSession, root: str, suffix: str = ".PHN") -> DataFrame:
    """(speaker, utt, start_sample, end_sample, phone) of all segment files below ``root``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root)
    path = F.col("_metadata.file_path")
    return segment_lines(files.select("value", paths.parent_name(path).alias("speaker"), paths.stem(path).alias("utt")), "value", "speaker", "utt")


def to_folder(root: str) -> Callable[[str, bytes], None]:
    """A writer of files below a folder that all executors mount; a file appears whole, so a task may run twice."""

    def write(path: str, content: bytes) -> None:
        whole = os.path.join(root, path)
        os.makedirs(os.path.dirname(whole), exist_ok=True)
        part = f"{whole}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, whole)

    return write


def write_files(rows: DataFrame, write: Callable[[str, bytes], None]) -> None:
    """Hand each row's path and content to ``write`` on the executors, which opens the store it belongs to."""

    def run(part: Iterator) -> None:
        for r in part:
            write(r["path"], bytes(r["content"]))

    rows.select("path", "content").foreachPartition(run)
