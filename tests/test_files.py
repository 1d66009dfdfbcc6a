"""Sources, sinks, plans, streams and the command line on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import __main__ as cli
from framewright import models
from framewright.operators import signal
from framewright.plans.convert import Converter, content_codes, factorised_maps, knn_converted, pair_scores, recognised_pairs
from framewright.sources import arrays, audio, files
from framewright.streaming.incremental import read_moments, stream_moments, stream_projection


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Two speakers' tones, two parallel utterances each."""
    root = tmp_path_factory.mktemp("corpus")
    for s, base in (("p1", 200), ("p2", 320)):
        for u in (1, 2):
            t = np.arange(8000) / 16000
            x = 0.4 * np.sin(2 * np.pi * base * u * t) * (1 + np.sin(2 * np.pi * 3 * t)) / 2
            write(root / s / f"{s}_{u:03d}.wav", audio.encode_wav(np.concatenate([np.zeros(1600), x]), 16000))
    return root


def test_lists_and_tables(spark, tmp_path):
    write(tmp_path / "ids.txt", " p1 \np2\n\np1\n")
    assert [r["speaker"] for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["p1", "p2", "p1"]
    assert files.exclusion_set(spark, str(tmp_path / "ids.txt")).count() == 2
    write(tmp_path / "eval.csv", "source,target,output_fn,reference_fn,label\n01,02,a/1,b/2,0\n02,01,c/3,d/4,1\n")
    rows = files.evaluation_table(spark, str(tmp_path / "eval.csv")).collect()
    assert rows[0]["src_speaker"] == "01" and [r["label"] for r in rows] == [0, 1]
    lines = spark.read.text(str(tmp_path / "eval.csv"))
    assert [tuple(r) for r in files.converted_lines(lines).collect()] == [("01", "02", "a/1", "b/2", 0)]
    arrays.write_evaluation(files.evaluation_table(spark, str(tmp_path / "eval.csv")), str(tmp_path / "out"))
    assert files.evaluation_table(spark, str(tmp_path / "out")).count() == 2


def test_transcripts_and_segments(spark, tmp_path):
    write(tmp_path / "a" / "x.trans.txt", "1-2-3 HELLO  BIG WORLD\n1-2-4 BYE\n")
    assert sorted(tuple(r) for r in files.transcripts(spark, str(tmp_path / "a")).collect()) == [("1-2-3", "HELLO BIG WORLD"), ("1-2-4", "BYE")]
    write(tmp_path / "b" / "p1_001.txt", "old\nnew line\n")
    write(tmp_path / "b" / "p1_002.txt", "only")
    assert sorted(tuple(r) for r in files.file_transcripts(spark, str(tmp_path / "b")).collect()) == [("p1_001", "new line"), ("p1_002", "only")]
    write(tmp_path / "c" / "spk" / "SA1.PHN", "0 640 h#\n640 1280 aa\n")
    got = sorted(tuple(r) for r in files.segments(spark, str(tmp_path / "c")).collect())
    assert got == [("spk", "SA1", 0, 640, "h#"), ("spk", "SA1", 640, 1280, "aa")]


def test_frames_round_trip(spark, tmp_path):
    matrix = np.random.default_rng(0).normal(size=(5, 3)).astype(np.float32)
    import io

    out = io.BytesIO()
    np.save(out, matrix)
    write(tmp_path / "npy" / "p1" / "u1.npy", out.getvalue())
    frames = arrays.import_npy(spark, str(tmp_path / "npy"))
    for mode in ("speakers", "utterances"):
        arrays.write_frames(frames, str(tmp_path / mode), mode)
        back = arrays.read_frames(spark, str(tmp_path / mode)).orderBy("frame_idx").collect()
        np.testing.assert_array_equal([r["feat"] for r in back], matrix)
        assert {r["speaker"] for r in back} == {"p1"}
    half = arrays.half_rounded(frames).orderBy("frame_idx").collect()
    np.testing.assert_array_equal([r["feat"] for r in half], matrix.astype(np.float16).astype(np.float32))
    out = io.BytesIO()
    np.savez(out, mean=np.arange(3.0), components=np.eye(3)[:2])
    write(tmp_path / "npz" / "pca.npz", out.getvalue())
    got = {r["key"]: (r["shape"], r["values"]) for r in arrays.import_npz(spark, str(tmp_path / "npz")).collect()}
    assert got == {"mean": ([3], [0.0, 1.0, 2.0]), "components": ([2, 3], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0])}


def test_pickled_arrays_are_refused(spark, tmp_path):
    import io

    out = io.BytesIO()
    np.save(out, np.array([{"a": 1}], dtype=object), allow_pickle=True)
    write(tmp_path / "p1" / "u.npy", out.getvalue())
    with pytest.raises(Exception, match="allow_pickle"):
        arrays.import_npy(spark, str(tmp_path)).collect()


def test_audio(spark, corpus, tmp_path):
    rows = audio.read_audio(spark, str(corpus))
    got = {r["utt"]: r for r in rows.collect()}
    assert set(got) == {"p1_001", "p1_002", "p2_001", "p2_002"} and got["p1_001"]["speaker"] == "p1" and len(got["p1_001"]["samples"]) == 9600
    assert files.speaker_listing(spark, str(corpus), ".wav").filter("speaker = 'p2'").count() == 2
    ready = signal.prepared(rows, 8000).collect()
    assert all(r["sr"] == 8000 and 3900 <= len(r["samples"]) <= 4100 for r in ready)
    assert signal.hours(rows).first()["hours"] == pytest.approx(4 * 0.6 / 3600)
    silent = rows.withColumn("samples", F.array_repeat(F.lit(0.0).cast("float"), 100))
    assert signal.not_empty(signal.prepared(silent)).count() == 0
    saved = {r["path"]: bytes(r["content"]) for r in audio.encoded(rows).collect()}
    again, rate = audio.decode_wav(next(iter(saved.values())))
    assert rate == 16000 and len(again) == 9600
    peak = max(signal.spectrogram(rows.filter("utt = 'p2_002'")).filter("window = 30").first()["power_db"])
    bins = signal.spectrogram(rows.filter("utt = 'p2_002'")).filter("window = 30").first()["power_db"]
    assert bins.index(peak) == round(640 / (16000 / 256))


def test_resampling_keeps_a_tone():
    t = np.arange(48000) / 48000
    y = signal.resample(np.sin(2 * np.pi * 440 * t), 48000, 16000)
    assert len(y) == 16000
    np.testing.assert_allclose(y[500:-500], np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)[500:-500], atol=0.02)


def test_conversion(spark, corpus):
    model = Converter(models.BandFeaturizer, models.ToneVocoder)
    feats = model.get_features(audio.read_audio(spark, str(corpus))).cache()
    source, target = (feats.filter(F.col("speaker") == s) for s in ("p1", "p2"))
    maps = model.get_projmat(source, target).collect()
    assert [(r["source"], r["target"]) for r in maps] == [("p1", "p2")] and len(maps[0]["w"]) == 8
    number = F.regexp_extract("utt", r"_(\d+)$", 1)
    parallel = model.get_projmat(source.withColumn("utt", number), target.withColumn("utt", number), parallel=True)
    assert parallel.count() == 1
    out = model.project_and_vocode(source, model.get_projmat(source, target)).collect()
    assert sorted((r["speaker"], r["utt"]) for r in out) == [("p1-p2", "p1_001"), ("p1-p2", "p1_002")] and len(out[0]["samples"]) == 30 * 320
    same = model.get_projmat(source, source).first()
    x = np.array([r["feat"] for r in source.collect()])
    np.testing.assert_allclose(x @ np.array(same["w"]), x, atol=1e-3)
    odd = [s.withColumn("speaker", F.lit(name)) for s, name in ((source, "a|b"), (source, "a|c"), (target, "t:é"))]
    named = model.get_projmat(odd[0].unionByName(odd[1]), odd[2])
    assert sorted((r["source"], r["target"]) for r in named.collect()) == [("a|b", "t:é"), ("a|c", "t:é")]
    bases, both = factorised_maps(feats, 3)
    assert both.count() == 2 and content_codes(feats, bases).filter(F.size("code") == 3).count() == feats.count()
    assert knn_converted(feats, both.select("source", "target"), 4).count() == feats.filter("array_max(feat) > 0").count()  # silence has no direction
    near, skipped = (sorted((r["target"], r["s_id"], [round(v, 9) for v in r["y"]]) for r in knn_converted(feats, both.select("source", "target"), 4, skip=s).collect()) for s in (False, True))
    assert near == skipped
    assert models.recognise(audio.read_audio(spark, str(corpus)), lambda: lambda x, rate: f"{len(x)} at {rate}").first()["hypothesis"] == "9600 at 16000"
    assert models.embed(audio.read_audio(spark, str(corpus)), lambda: lambda x, rate: x[:4]).filter(F.size("embedding") == 4).count() == 4


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(60, 3))
    ddl = "source string, target string, x array<double>, y array<double>"
    rows = [("a", "b", a.tolist(), b.tolist()) for a, b in zip(x, y)]
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], ddl).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream_moments(stream, str(tmp_path / "state"), str(tmp_path / "c1")).awaitTermination()
    np.testing.assert_allclose(np.array(read_moments(spark, str(tmp_path / "state")).first()["sxy"]), (x.T @ y).ravel())
    maps = spark.createDataFrame([("a", [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 2.0]], None)], "source string, w array<array<double>>, bias array<double>")
    feats = stream.select("source", F.col("x").alias("feat"))
    stream_projection(feats, maps, ["source"], str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_command_line(spark, corpus, tmp_path, capsys):
    write(tmp_path / "ids.txt", "p1\np2\n")
    cli.main(["resample", str(tmp_path / "ids.txt"), str(corpus), str(tmp_path / "ready")])
    assert float(capsys.readouterr().out.split()[-1]) == pytest.approx(4 * 0.5 / 3600, rel=0.05)
    cli.main(["extract", str(corpus), str(tmp_path / "frames")])
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 4 * 30
    cli.main(["convert", str(corpus / "p1"), str(corpus / "p2"), str(corpus / "p1"), str(tmp_path / "converted")])
    assert sorted(p.relative_to(tmp_path).as_posix() for p in (tmp_path / "converted").rglob("*.*")) == ["converted/p1-p2/p1_001.wav", "converted/p1-p2/p1_002.wav"]
    cli.main(["convert", "--tables", str(corpus / "p1"), str(corpus / "p2"), str(corpus / "p1"), str(tmp_path / "table")])
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    cli.main(["make-eval", str(tmp_path / "ids.txt"), str(corpus), str(tmp_path / "pairs")])
    write(tmp_path / "scores.csv", "src_speaker,tgt_speaker,score,label\na,b,0.1,1\na,b,0.9,0\n")
    cli.main(["eer", str(tmp_path / "scores.csv")])
    write(tmp_path / "texts.csv", "utt_key,reference,hypothesis\nu,the cat sat,the cat sad\n")
    cli.main(["wer", str(tmp_path / "texts.csv")])
    assert "33.3" in capsys.readouterr().out


def test_rates_from_audio(spark, corpus, tmp_path, capsys):
    cli.main(["convert", str(corpus / "p1"), str(corpus / "p2"), str(corpus / "p1"), str(tmp_path / "converted")])
    rows = [f"p1,p2,p1-p2/p1_{u:03d}.wav,p2/p2_{u:03d}.wav,0" for u in (1, 2)] + [f"p2,p2,p2/p2_{u:03d}.wav,p2/p2_{v:03d}.wav,1" for u, v in ((1, 2), (2, 1))]
    write(tmp_path / "pairs.csv", "source,target,output_fn,reference_fn,label\n" + "\n".join(rows) + "\n")
    read = lambda root: audio.read_audio(spark, str(root))
    scores = pair_scores(files.evaluation_table(spark, str(tmp_path / "pairs.csv")), read(tmp_path / "converted"), read(corpus), models.BandEmbedder).collect()
    vector = lambda root, name: models.BandEmbedder()(*audio.decode_wav((root / name).read_bytes()))
    cosine = lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    want = sorted(cosine(vector(tmp_path / "converted" if label == "0" else corpus, x), vector(corpus, y)) for _, _, x, y, label in (r.split(",") for r in rows))
    np.testing.assert_allclose(sorted(r["score"] for r in scores), want, atol=1e-6)
    cli.main(["eer", str(tmp_path / "pairs.csv"), str(tmp_path / "converted"), str(corpus)])
    assert "p2" in capsys.readouterr().out
    for u in (1, 2):
        write(tmp_path / "texts" / f"p1_{u:03d}.txt", "9600 at 16000\n" if u == 1 else "seven words\n")
    texts = files.file_transcripts(spark, str(tmp_path / "texts"))
    said = {r["utt_key"]: (r["reference"], r["hypothesis"]) for r in recognised_pairs(read(tmp_path / "converted"), texts, models.LengthRecogniser).collect()}
    assert said == {"p1-p2/p1_001": ("9600 at 16000", "9600 at 16000"), "p1-p2/p1_002": ("seven words", "9600 at 16000")}
    cli.main(["wer", str(tmp_path / "converted"), str(tmp_path / "texts")])
    assert "words" in capsys.readouterr().out
    with pytest.raises(Exception, match="no transcript of"):
        recognised_pairs(read(corpus), texts, models.LengthRecogniser).collect()


def test_array_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(s, u, i, [float(x) for x in rng.normal(size=3).astype(np.float32)]) for s in ("a", "b") for u in ("u1", "u2") for i in range(5)]
    frames = spark.createDataFrame(rows, arrays.FRAMES)
    for mode in ("speakers", "utterances"):
        arrays.export_npy(frames, files.to_folder(str(tmp_path / mode)), mode)
    whole = np.load(tmp_path / "speakers" / "b.npy")
    np.testing.assert_array_equal(whole, np.array([r[3] for r in rows if r[0] == "b"], np.float32))
    back = arrays.import_npy(spark, str(tmp_path / "utterances"))
    key = lambda r: (r["speaker"], r["utt"], r["frame_idx"], tuple(r["feat"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, frames.collect()))
    maps = spark.createDataFrame([("a", "b", [[1.0, 2.0], [3.0, 4.0]], [5.0, 6.0]), ("b", "a", None, [7.0, 8.0])], "source string, target string, w array<array<double>>, bias array<double>")
    assert arrays.export_npz(maps, str(tmp_path / "w.npz")) == 1 and arrays.export_npz(maps, str(tmp_path / "bias.npz"), "bias") == 2
    with np.load(tmp_path / "w.npz") as found:
        assert found.files == ["a-b"] and found["a-b"].tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert {r["key"]: list(r["values"]) for r in arrays.import_npz(spark, str(tmp_path)).collect() if r["path"].endswith("bias.npz")} == {"a-b": [5.0, 6.0], "b-a": [7.0, 8.0]}


def test_planes_and_counts(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 2)) @ np.array([[3.0, 0.0, 1.0], [0.0, 1.0, 0.0]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "frame_id long, feat array<double>")
    out = models.plane(rows, models.PlanePca)
    at = np.array([[r["x"], r["y"]] for r in out.orderBy("frame_id").collect()])
    apart = lambda m: np.linalg.norm(m[:, None] - m[None], axis=2)
    np.testing.assert_allclose(apart(at), apart(x), atol=1e-9)
    assert models.plane(rows, models.PlanePca, bound=7).count() == 7 and models.plane(rows.filter("false"), models.PlanePca).count() == 0

    class Part:
        def __init__(self, shape, requires_grad=True):
            self.shape, self.requires_grad = shape, requires_grad

    class Model:
        def parameters(self):
            return [Part((3, 4)), Part((5,)), Part((100,), False)]

    assert models.parameter_count(Model()) == 17
