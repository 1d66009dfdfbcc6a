"""Voice conversion from end to end: files in, frames, a learned map, converted files out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import models
from ..functions import vectors
from ..operators import factorise as fz
from ..operators import frames as fr
from ..operators.matching import aligned_to_first, matched_pairs, topk_blocks
from ..operators.moments import pair_factors, pair_moments
from ..operators.pairs import speaker_pairs
from ..operators.project import project
from ..operators.pruned import topk_pruned
from ..operators.signal import prepared
from ..operators.solvers import fit_factors, fit_maps

# Frames of a speaker that are matched, and the penalty of parallel fits.
CAP = 8192
PARALLEL_ALPHA = 0.3


def with_ids(frames: DataFrame) -> DataFrame:
    """Frames with frame_id, a hash of (speaker, utt, frame_idx) that any run repeats."""
    return frames.withColumn("frame_id", F.xxhash64("speaker", "utt", "frame_idx"))


def coded(name: Column) -> Column:
    """A name in letters, digits, ``+``, ``/`` and ``=``, so that marks can be put beside it."""
    return F.base64(name.cast("binary"))


class Converter:
    """Learns and applies linear maps between speakers; the models are injected as factories."""

    def __init__(self, featurizer: Callable[[], models.Featurizer], vocoder: Callable[[], models.Vocoder]) -> None:
        self.featurizer, self.vocoder = featurizer, vocoder

    def get_features(self, audio: DataFrame) -> DataFrame:
        return models.featurize(audio, self.featurizer)

    def get_projmat(self, source: DataFrame, target: DataFrame, parallel: bool = False, lasso: float | None = None, k: int = 1, cap: int | None = CAP) -> DataFrame:
        """(source, target, w, bias) from the two sides' frames.

        Non-parallel: all (capped) frames of a side against all of the other. Parallel: frames of
        utterances of one name on both sides, uncapped, and lasso with alpha 0.3 unless given.
        Least squares works on triangular factors, which keep all singular values of the rows.
        """
        # the two sides' speakers apart, under names that any speaker's name can be read back from
        source, target = (s.withColumn("speaker", F.concat(F.lit(side), coded(F.col("speaker")))) for s, side in ((source, "s:"), (target, "t:")))
        if parallel:
            lasso = PARALLEL_ALPHA if lasso is None else lasso
            # an utterance on both sides is a speaker of its own while frames are matched
            sides = [s.withColumn("speaker", F.concat_ws("|", "speaker", coded(F.col("utt")))) for s in (source, target)]
            pairs = sides[0].select(F.col("speaker").alias("source"), "utt").distinct().join(sides[1].select(F.col("speaker").alias("target"), "utt").distinct(), "utt").select("source", "target")
        else:
            sides = [fr.cap(s, cap) for s in (source, target)]
            # every source speaker meets every target speaker: these pairs are the result that is asked for
            pairs = sides[0].select(F.col("speaker").alias("source")).distinct().join(sides[1].select(F.col("speaker").alias("target")).distinct(), F.lit(True))
        both = with_ids(sides[0].unionByName(sides[1]))
        matched = matched_pairs(topk_blocks(both, pairs, k), both)
        plain = lambda c: F.unbase64(F.split(F.substring(c, 3, 1 << 30), r"\|")[0]).cast("string").alias(c)
        rows = matched.select(plain("source"), plain("target"), "x", "y")
        return fit_maps(pair_moments(rows), "lasso", alpha=lasso) if lasso is not None else fit_factors(pair_factors(rows))

    def project_and_vocode(self, frames: DataFrame, maps: DataFrame) -> DataFrame:
        """Converted audio of frames (speaker, utt, frame_idx, feat) under (source, target, w, bias)."""
        rows = frames.withColumnRenamed("speaker", "source").join(maps.select("source", "target").distinct(), "source")
        moved = project(rows, maps, ["source", "target"])
        named = moved.select(F.concat_ws("-", "source", "target").alias("speaker"), "utt", "frame_idx", "projected")
        return models.vocode(named, self.vocoder, "projected")


def factorised_maps(frames: DataFrame, rank: int, cap: int | None = CAP) -> tuple[DataFrame, DataFrame]:
    """(bases, maps) of all speakers from one joint factorisation, first speaker aligned to every one."""
    capped = with_ids(fr.cap(frames, cap))
    bases = fz.factorise(aligned_to_first(capped), rank).bases
    return bases, fz.maps_from_bases(bases, speaker_pairs(bases))


def content_codes(frames: DataFrame, bases: DataFrame) -> DataFrame:
    """(speaker, utt, frame_idx, code) of every frame under its speaker's basis."""
    return project(frames, fz.content_maps(bases), ["speaker"], name="code").drop("feat")


def knn_converted(frames: DataFrame, pairs: DataFrame, k: int = 4, cap: int | None = None, skip: bool = False) -> DataFrame:
    """(source, target, s_id, y): each frame replaced by the mean of its k nearest target frames.

    ``skip`` finds the same ones by bounds, for many frames that lie in clusters.
    """
    own = with_ids(fr.cap(frames, cap))
    return matched_pairs((topk_pruned if skip else topk_blocks)(own, pairs, k), own).drop("x")


def pair_scores(evaluation: DataFrame, converted: DataFrame, real: DataFrame, embedder: Callable[[], models.Embedder], rate: int = 16_000, zero_positive: bool = False) -> DataFrame:
    """(src_speaker, tgt_speaker, score, label): cosine distance of the speaker vectors of evaluation pairs.

    ``evaluation`` is as ``files.evaluation_table`` reads it; paths are taken without their suffix. Conversions (label 0) are looked up below the converted audio, all other files
    below the real audio. Every file is embedded once. With ``zero_positive`` the labels change sides.
    """

    def embedded(audio: DataFrame) -> DataFrame:
        named = prepared(audio, rate, trim=None).withColumn("speaker", F.concat_ws("/", "speaker", "utt"))
        return models.embed(named, embedder).select(F.col("speaker").alias("file"), "embedding")

    bare = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    pairs = evaluation.withColumns({"x": bare("x_path"), "y": bare("y_path")})
    truth = embedded(real)
    x = embedded(converted).withColumn("of", F.lit(0)).unionByName(truth.withColumn("of", F.lit(1)))
    rows = pairs.join(x.select(F.col("file").alias("x"), F.col("of").alias("label"), F.col("embedding").alias("a")), ["x", "label"])
    rows = rows.join(truth.select(F.col("file").alias("y"), F.col("embedding").alias("b")), "y")
    label = 1 - F.col("label") if zero_positive else F.col("label")
    return rows.select("src_speaker", "tgt_speaker", vectors.cosine_distance("a", "b").alias("score"), label.alias("label"))


def with_references(said: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``said`` (utt_key, ...) with the reference that transcripts (utt_key, text) have of its key; a key without one is an error when it is met."""
    joined = said.join(transcripts.select("utt_key", F.col("text").alias("reference"), F.lit(True).alias("known")), "utt_key", "left")
    known = F.when(F.col("known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no transcript of "), F.col("utt_key"))).cast("boolean"))
    return joined.filter(known).drop("known")


def recognised_pairs(converted: DataFrame, transcripts: DataFrame, recogniser: Callable[[], models.Recogniser], by: str = "utt") -> DataFrame:
    """(utt_key, reference, hypothesis) of converted audio and transcripts (utt_key, text); ``by`` names the column that is the key.

    A file without transcript is an error when it is met.
    """
    said = models.recognise(converted, recogniser).withColumn("utt_key", F.col(by))
    return with_references(said, transcripts).select(F.concat_ws("/", "speaker", "utt").alias("utt_key"), "reference", "hypothesis")
