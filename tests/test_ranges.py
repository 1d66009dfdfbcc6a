"""Array and audio files in ranges, sinks that commit, long recordings in chunks, and where speech begins."""

import math
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import signal
from framewright.sources import audio, ranges


def table(rows):
    return {(r["speaker"], r["utt"], r["frame_idx"]): r["feat"] for r in rows.collect()}


def save(path, x):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    np.save(path, x)


def test_array_files_are_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    big, one, half = rng.normal(size=(1000, 7)).astype(np.float32), rng.normal(size=5), rng.normal(size=(3, 4)).astype(np.float16)
    for name, x in (("p1/u1.npy", big), ("p1/u2.npy", one), ("p2/u1.npy", half), ("p2/none.npy", np.zeros((0, 3))), ("_hidden/x.npy", big)):
        save(f"{tmp_path}/{name}", x)
    rows = ranges.load_npy(spark, str(tmp_path), part_bytes=1000)
    assert rows.rdd.getNumPartitions() > 25
    got = table(rows)
    assert len(got) == 1000 + 1 + 3
    np.testing.assert_allclose([got["p1", "u1", i] for i in range(1000)], big)
    np.testing.assert_allclose(got["p1", "u2", 0], one, rtol=1e-6)
    np.testing.assert_allclose([got["p2", "u1", i] for i in range(3)], half, rtol=1e-3)


@pytest.mark.parametrize("x", [np.array([{"a": 1}], dtype=object), np.asfortranarray(np.ones((3, 2)))])
def test_arrays_that_have_no_ranges_are_refused(spark, tmp_path, x):
    np.save(f"{tmp_path}/x.npy", x, allow_pickle=True)
    with pytest.raises(Exception, match="unpickled|column order"):
        ranges.load_npy(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(("mode", "half"), [("speakers", False), ("utterances", True)])
def test_array_files_are_written_in_ranges(spark, tmp_path, mode, half):
    rng = np.random.default_rng(2)
    sizes = {("hot", "a"): 700, ("hot", "b"): 5, ("cold", "a"): 3}
    rows = [(s, u, i, v) for (s, u), n in sizes.items() for i, v in enumerate(rng.normal(size=(n, 4)).tolist())]
    df = spark.createDataFrame(rows, "speaker string, utt string, frame_idx long, feat array<double>").repartition(5)
    ranges.save_npy(df, str(tmp_path), mode, half)
    files = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    assert files == (["cold.npy", "hot.npy"] if mode == "speakers" else ["cold/a.npy", "hot/a.npy", "hot/b.npy"])
    for name in files:
        key = name.removesuffix(".npy").split("/")
        want = np.array([v for s, u, _, v in rows if [s, u][: len(key)] == key])
        got = np.load(tmp_path / name)
        assert got.dtype == (np.float16 if half else np.float32)
        np.testing.assert_allclose(got, want, rtol=2e-3 if half else 1e-6, atol=1e-3)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    ok = spark.range(20).select(F.concat(F.lit("d/"), "id", F.lit(".bin")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    bad = ok.repartition(4).withColumn("content", F.when(F.col("path") == "d/13.bin", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        ranges.save_files(bad, str(tmp_path))
    assert not list(tmp_path.rglob("*.bin")) and not list(tmp_path.glob("_writing*"))
    ranges.save_files(ok, str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.rglob("*.bin")} == {f"{i}.bin": str(i).encode() for i in range(20)}
    assert not list(tmp_path.glob("_writing*"))


@pytest.mark.parametrize("path", ["../out.bin", "/etc/x", "a/../../b", ""])
def test_paths_stay_below_the_folder(spark, tmp_path, path):
    with pytest.raises(Exception, match="no path below"):
        ranges.save_files(spark.createDataFrame([(path, b"x")], "path string, content binary"), str(tmp_path / "root"))


# ---------------------------------------------------------------- audio


def recording(seed, n, rate, onset=None):
    rng = np.random.default_rng(seed)
    x = 0.004 * rng.normal(size=n)
    if onset is not None:
        t = np.arange(n - onset) / rate
        x[onset:] += 0.3 * np.sin(2 * np.pi * 220 * t) * (0.6 + 0.4 * np.sin(2 * np.pi * 4 * t))
    return x


def write_wav(path, x, rate, channels=1, width=2):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    scaled = np.round(np.clip(x, -1, 1) * (2 ** (8 * width - 1) - 1)).astype("<i4")
    raw = np.repeat(scaled, channels)
    data = raw.astype("<i2").tobytes() if width == 2 else b"".join(int(v).to_bytes(3, "little", signed=True) for v in raw)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(data)


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    root = tmp_path_factory.mktemp("long")
    write_wav(f"{root}/p1/a.wav", recording(1, 70_000, 22_050, 30_000), 22_050)
    write_wav(f"{root}/p1/b.wav", recording(2, 48_000, 48_000, 20_000), 48_000, channels=2)
    write_wav(f"{root}/p2/c.wav", recording(3, 20_000, 16_000, 9_000), 16_000, width=3)
    write_wav(f"{root}/p2/silent.wav", recording(4, 20_000, 16_000), 16_000)
    write_wav(f"{root}/p2/short.wav", recording(5, 50, 8_000), 8_000)
    return str(root)


def chunks(spark, root, **options):
    return ranges.load_chunks(spark, root, **({"chunk_samples": 5000, "overlap": 700, "part_bytes": 20_000} | options))


def test_chunks_hold_the_whole_files(spark, recordings):
    rows = chunks(spark, recordings)
    assert rows.rdd.getNumPartitions() > 10
    whole = {r["utt"]: r for r in audio.read_audio(spark, recordings).collect()}
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r["utt"], r["chunk"])):
        got.setdefault(r["utt"], []).extend(r["samples"][r["lead"] : r["lead"] + r["own"]])
        assert (r["sr"], r["total"]) == (whole[r["utt"]]["sr"], len(whole[r["utt"]]["samples"]))
    assert set(got) == set(whole)
    for utt, x in got.items():
        np.testing.assert_allclose(x, whole[utt]["samples"], atol=1e-7)


@pytest.mark.parametrize("rate", [16_000, 8_000, 44_100])
def test_chunks_resample_like_whole_files(spark, recordings, rate):
    whole = {r["utt"]: signal.resample(np.asarray(r["samples"]), r["sr"], rate) for r in audio.read_audio(spark, recordings).collect()}
    voice = signal.Voice()
    rows = signal.resampled_chunks(chunks(spark, recordings), rate).collect()
    for utt, x in whole.items():
        own = sorted((r for r in rows if r["utt"] == utt), key=lambda r: r["chunk"])
        assert own[0]["total"] == len(x)
        np.testing.assert_allclose(np.concatenate([r["samples"] for r in own]), x, atol=1e-6)
        powers = [p for r in own for p in r["powers"]]
        want = voice.powers(x, rate)
        assert len(powers) == len(want)
        if len(want):
            np.testing.assert_allclose(powers, want, rtol=1e-3, atol=1e-10)


def test_trimmed_chunks_equal_trimmed_files(spark, recordings):
    want = {}
    for r in audio.read_audio(spark, recordings).collect():
        x = signal.resample(np.asarray(r["samples"]), r["sr"], 16_000)
        if len(y := signal.voice_trim(x, 16_000)):
            want[r["utt"]] = y
    assert set(want) == {"a", "b", "c"}
    out = signal.trimmed_chunks(signal.resampled_chunks(chunks(spark, recordings))).cache()
    assert {r["total"] for r in out.filter("utt = 'a'").collect()} == {len(want["a"])}
    got = {r["utt"]: r["samples"] for r in signal.joined_chunks(out).collect()}
    assert set(got) == set(want)
    for utt, x in want.items():
        np.testing.assert_allclose(got[utt], x, atol=1e-6)


def test_short_overlaps_are_an_error(spark, recordings):
    with pytest.raises(Exception, match="too short"):
        signal.resampled_chunks(chunks(spark, recordings, overlap=10)).collect()


def plain_start(v, powers):
    """The tracker written out sample by sample."""
    a, b, up, down = (math.exp(-v.hop / s) for s in (v.smooth, v.trigger, v.rise, v.fall))
    boot, power, floor, level, seen = round(v.boot / v.hop), None, None, 0.0, []
    for i, row in enumerate(powers.tolist()):
        row = [x + v.quiet for x in row]
        power = row if power is None else [a * p + (1 - a) * x for p, x in zip(power, row)]
        if i < boot:
            floor = row if floor is None else [f + (x - f) / (i + 1) for f, x in zip(floor, row)]
        else:
            floor = [(up if p > f else down) * f + (1 - (up if p > f else down)) * p for p, f in zip(power, floor)]
        above = sorted((max(0.0, 10 * math.log10(p / f)) for p, f in zip(power, floor)), reverse=True)[: math.ceil(len(row) / 4)]
        seen.append(sum(above) / len(above))
        level = b * level + (1 - b) * seen[-1]
        if level >= v.level:
            start, quiet = i, 0
            for k in range(i, max(-1, i - round(v.search / v.hop)), -1):
                if seen[k] >= v.level / 2:
                    start, quiet = k, 0
                elif (quiet := quiet + 1) > round(v.gap / v.hop):
                    break
            return max(0, start - round(v.pre / v.hop))
    return None


@pytest.mark.parametrize("voice", [signal.Voice(), signal.Voice(bands=1, level=5.0, pre=0.05), signal.Voice(gap=0.02, search=0.1)])
def test_start_of_noisy_onsets(voice):
    rate, found = 16_000, 0
    for seed in range(12):
        onset = [None, 4_000, 12_000, 20_000][seed % 4]
        x = recording(seed, 32_000, rate, onset) * 10 ** (-seed / 12)
        powers = voice.powers(x, rate)
        start = voice.start(powers)
        assert start == plain_start(voice, powers)
        assert (start is None) == (onset is None)
        if onset is not None:
            found += 1
            assert onset / rate - voice.pre - voice.gap - 0.1 <= start * voice.hop <= onset / rate + 0.1
    assert found == 9


def test_a_soft_onset_is_kept_and_steady_noise_is_not():
    rng = np.random.default_rng(7)
    noise = 0.02 * rng.normal(size=48_000)  # well over the level of an energy gate
    assert len(signal.voice_trim(noise, 16_000)) == 0
    soft = 1e-5 * rng.normal(size=32_000)
    soft[16_000:] += 5e-4 * np.sin(2 * np.pi * 300 * np.arange(16_000) / 16_000)  # well under it
    assert 16_000 <= len(signal.voice_trim(soft, 16_000)) + 1_600 <= 19_200
    assert len(signal.energy_trim(noise, 16_000)) == 48_000 and len(signal.energy_trim(soft, 16_000)) == 0


@pytest.mark.parametrize("rate, new", [(48_000, 16_000), (16_000, 22_050), (11_025, 8_000), (3, 2)])
def test_any_stretch_is_that_of_the_whole(rate, new):
    x = np.random.default_rng(3).normal(size=5_000)
    bank = signal.Bank(rate, new)
    whole = signal.resample(x, rate, new)
    for first, last in ((0, 10), (len(whole) // 2, len(whole) // 2 + 33), (len(whole) - 5, len(whole))):
        begin = max(0, first * bank.down // bank.up - bank.half - 5)
        end = last * bank.down // bank.up + bank.half + 5
        np.testing.assert_allclose(bank.span(x[begin:end], begin, first, last), whole[first:last], atol=1e-6)
