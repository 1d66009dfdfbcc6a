"""Command line: ``python -m framewright COMMAND ...``.

Commands that need a neural model take ``--featurizer`` and the like as ``module:factory``.
"""

from __future__ import annotations

import argparse
import importlib
import random
from collections.abc import Callable

from pyspark.sql import functions as F

from .operators import evaluate, pairs, signal
from .operators import frames as fr
from .session import session
from .sources import arrays, audio, files


def factory(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def convert(spark, a) -> None:
    """Learn a map from one folder's utterances to the other's and convert an input folder with it."""
    from .plans.convert import Converter

    model = Converter(factory(a.featurizer), factory(a.vocoder))
    read = lambda root: audio.read_audio(spark, root, a.extension)
    trimmed = (lambda x: signal.not_empty(signal.prepared(x))) if a.vad else (lambda x: signal.prepared(x, trim=None))
    source, target = (model.get_features(trimmed(read(root))) for root in (a.source_dir, a.target_dir))
    maps = model.get_projmat(source, target, parallel=a.parallel, lasso=a.lasso)
    # the input utterance is never trimmed; every speaker of the source folder has the same map
    given = model.get_features(signal.prepared(read(a.input_dir), trim=None))
    made = model.project_and_vocode(given, maps)
    if a.tables:
        made.write.parquet(a.output_dir)
    else:
        audio.write_audio(made.withColumn("path", F.concat_ws("/", "speaker", F.concat("utt", F.lit(".wav")))), files.to_folder(a.output_dir))


def resample(spark, a) -> None:
    """Bring the listed speakers' audio to one rate without leading silence; prints the hours."""
    wanted = files.id_list(spark, a.speakers)
    ready = signal.prepared(fr.keep(audio.read_audio(spark, a.input_dir, a.extension), wanted), a.sample_rate)
    if a.tables:
        signal.not_empty(ready).write.partitionBy("speaker").parquet(a.output_dir)
        done = spark.read.parquet(a.output_dir)
    else:
        audio.write_audio(signal.not_empty(ready).withColumn("path", F.concat_ws("/", "speaker", F.concat("utt", F.lit(".wav")))), files.to_folder(a.output_dir))
        done = audio.read_audio(spark, a.output_dir)
    print(signal.hours(done).first()["hours"])


def extract(spark, a) -> None:
    """Features of a corpus as a frames table, by speaker or utterance."""
    from .models import featurize

    rows = audio.read_audio(spark, a.input_dir, a.extension)
    if a.exclude:
        rows = fr.exclude(rows, files.exclusion_set(spark, a.exclude))
    if a.utterance:
        rows = rows.filter(F.col("utt").endswith(f"_{a.utterance}"))
    feats = featurize(signal.prepared(rows, trim=None), factory(a.featurizer))
    if a.pca:
        from .operators.project import pca_whiten

        parts = {r["key"]: r for r in arrays.import_npz(spark, a.pca).collect()}
        mean, variance = parts["mean"]["values"], parts["explained_variance"]["values"]
        width = len(mean)
        components = [parts["components"]["values"][i : i + width] for i in range(0, len(parts["components"]["values"]), width)]
        feats = pca_whiten(feats, mean, components, variance).select("speaker", "utt", "frame_idx", F.col("whitened").cast("array<float>").alias("feat"))
    if a.npy:
        arrays.export_npy(feats, files.to_folder(a.output_dir), a.save_mode)
    else:
        arrays.write_frames(feats, a.output_dir, a.save_mode)


def make_eval(spark, a) -> None:
    """Evaluation pairs of the listed speakers' files ``<speaker>_<number>``."""
    listed = files.listing(spark, a.input_dir, a.extension)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    utts = listed.select(F.regexp_extract(stem, r"^(.*)_(\d+)$", 1).alias("speaker"), F.regexp_extract(stem, r"_(\d+)$", 1).alias("n"), stem.alias("utt")).filter("n <> ''")
    utts = fr.keep(utts.select("speaker", F.col("n").cast("int").alias("utt_no"), "utt"), files.id_list(spark, a.speakers))
    arrays.write_evaluation(pairs.evaluation_pairs(utts), a.output)


def eer(spark, a) -> None:
    """Equal error rate a target speaker, and its mean and deviation, of evaluation pairs and the converted and real audio.

    Without the audio folders, the table holds ready scores: src_speaker, tgt_speaker, score, label.
    """
    if a.converted_dir:
        from .plans.convert import pair_scores

        scores = pair_scores(files.evaluation_table(spark, a.table), audio.read_audio(spark, a.converted_dir), audio.read_audio(spark, a.real_dir, a.extension), factory(a.embedder), zero_positive=a.zero_positive)
    else:
        scores = spark.read.csv(a.table, header=True, schema="src_speaker string, tgt_speaker string, score double, label int")
        scores = evaluate.zero_positive(scores) if a.zero_positive else scores
    rates = evaluate.eer(scores)
    rates.orderBy("tgt_speaker").show(1000, False)
    evaluate.eer_summary(rates).show()


def wer(spark, a) -> None:
    """Word and character error rates with bootstrap deviations of converted audio and the real speech's transcripts.

    Without the folder of transcripts, the input is a table utt_key, reference, hypothesis.
    """
    if a.transcripts_dir:
        from .plans.convert import recognised_pairs

        librispeech = a.format == "librispeech"
        texts = files.transcripts(spark, a.transcripts_dir) if librispeech else files.file_transcripts(spark, a.transcripts_dir)
        rows = recognised_pairs(audio.read_audio(spark, a.input), texts, factory(a.recogniser), "speaker" if librispeech else "utt")
    else:
        rows = spark.read.csv(a.input, header=True, schema="utt_key string, reference string, hypothesis string")
    rows = rows.persist()
    for words in (True, False):
        counts = evaluate.error_counts(rows, words=words)
        numbered = fr.numbered(counts.select("utt_key", "edits", "ref_len"), "utt_key")
        index = evaluate.bootstrap_index(spark, numbered.count())
        print("words" if words else "characters")
        evaluate.bootstrap_rate(numbered, index).show()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framewright")
    sub = top.add_subparsers(required=True)

    def command(f: Callable, *positional: str) -> argparse.ArgumentParser:
        p = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        p.set_defaults(run=f)
        for name in positional:
            p.add_argument(name)
        return p

    p = command(convert, "source_dir", "target_dir", "input_dir", "output_dir")
    p.add_argument("--parallel", action="store_true")
    p.add_argument("--lasso", type=float)
    p.add_argument("--vad", action="store_true")
    p.add_argument("--extension", default=".wav")
    p.add_argument("--featurizer", default="framewright.models:BandFeaturizer")
    p.add_argument("--vocoder", default="framewright.models:ToneVocoder")
    p.add_argument("--tables", action="store_true", help="write a Parquet table of samples instead of WAV files")
    p = command(resample, "speakers", "input_dir", "output_dir")
    p.add_argument("--sample_rate", type=int, default=16_000)
    p.add_argument("--tables", action="store_true", help="write a Parquet table of samples instead of WAV files")
    p.add_argument("--extension", default=".wav")
    p = command(extract, "input_dir", "output_dir")
    p.add_argument("--pca")
    p.add_argument("--exclude")
    p.add_argument("--utterance")
    p.add_argument("--save_mode", choices=("speakers", "utterances"), default="speakers")
    p.add_argument("--extension", default=".wav")
    p.add_argument("--featurizer", default="framewright.models:BandFeaturizer")
    p.add_argument("--npy", action="store_true", help="write .npy files instead of a Parquet table")
    p = command(make_eval, "speakers", "input_dir", "output")
    p.add_argument("--extension", default=".wav")
    p = command(eer, "table")
    p.add_argument("converted_dir", nargs="?")
    p.add_argument("real_dir", nargs="?")
    p.add_argument("--zero_positive", action="store_true")
    p.add_argument("--extension", default=".wav")
    p.add_argument("--embedder", default="framewright.models:BandEmbedder")
    p = command(wer, "input")
    p.add_argument("transcripts_dir", nargs="?")
    p.add_argument("--format", choices=("librispeech", "vctk"), default="vctk")
    p.add_argument("--recogniser", default="framewright.models:LengthRecogniser")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    random.seed(13)
    a.run(session(), a)


if __name__ == "__main__":
    main()
