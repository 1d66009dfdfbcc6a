"""Estimators, matching, factorisation, scores and segments against numpy and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import hashing, text, vectors
from framewright.operators import evaluate, factorise, matching, matrixstats, moments, pairs, project, segments, solvers
from framewright.operators import frames as fr


def frame_table(spark, groups):
    rows = [(s, "u", i, 1000 * k + i, [float(v) for v in x]) for k, (s, m) in enumerate(groups.items()) for i, x in enumerate(m)]
    return spark.createDataFrame(rows, "speaker string, utt string, frame_idx long, frame_id long, feat array<float>")


def pair_table(spark, x, y, source="a", target="b"):
    return spark.createDataFrame([(source, target, [float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, y)], "source string, target string, x array<double>, y array<double>")


@pytest.fixture(scope="module")
def xy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 12))
    b = rng.normal(size=(12, 12))
    return x, x @ b + 0.7 + 0.05 * rng.normal(size=(400, 12))


@pytest.fixture(scope="module")
def moment_row(spark, xy):
    return moments.pair_moments(pair_table(spark, *xy)).cache()


def fitted(moment_row, method, **options):
    row = solvers.fit_maps(moment_row, method, **options).first()
    return (None if row["w"] is None else np.array(row["w"])), (None if row["bias"] is None else np.array(row["bias"]))


def test_moments(moment_row, xy):
    x, y = xy
    row = solvers.Moments.of(moment_row.first().asDict())
    assert row.n == 400
    np.testing.assert_allclose(row.g, x.T @ x)
    np.testing.assert_allclose(row.c, x.T @ y)
    np.testing.assert_allclose(row.h, y.T @ y)


def test_moments_merge_alike_in_any_split(spark, xy):
    x, y = xy
    parts = moments.pair_moments(pair_table(spark, x[:150], y[:150])).unionByName(moments.pair_moments(pair_table(spark, x[150:], y[150:]), salts=3))
    np.testing.assert_allclose(np.array(moments.merge_moments(parts).first()["sxy"]), (x.T @ y).ravel())


def test_least_squares(moment_row, xy):
    x, y = xy
    w, b = fitted(moment_row, "least_squares")
    np.testing.assert_allclose(w, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)
    assert b is None
    w, b = fitted(moment_row, "least_squares_bias")
    full = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    np.testing.assert_allclose(w, full[:-1], atol=1e-8)
    np.testing.assert_allclose(b, full[-1], atol=1e-8)


def test_minimum_norm_with_few_frames(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 12)), rng.normal(size=(5, 12))
    w, _ = fitted(moments.pair_moments(pair_table(spark, x, y)), "least_squares")
    np.testing.assert_allclose(w, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)


def test_orthogonal_recovers_a_rotation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 6))
    r, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    w, _ = fitted(moments.pair_moments(pair_table(spark, x, x @ r)), "orthogonal")
    np.testing.assert_allclose(w, r, atol=1e-8)
    w, b = fitted(moments.pair_moments(pair_table(spark, x, x @ r + 3)), "orthogonal_bias")
    np.testing.assert_allclose(w, r, atol=1e-8)
    np.testing.assert_allclose(b, 3, atol=1e-8)


@pytest.mark.parametrize("alpha", [0.01, 0.3])
def test_lasso_meets_its_conditions(moment_row, xy, alpha):
    x, y = xy
    w, _ = fitted(moment_row, "lasso", alpha=alpha)
    slope = x.T @ (y - x @ w) / len(x)
    active = w != 0
    np.testing.assert_allclose(slope[active], alpha * np.sign(w[active]), atol=1e-7)
    assert np.abs(slope).max() <= alpha + 1e-7


def test_ridge_and_reduced_rank(moment_row, xy):
    x, y = xy
    w, _ = fitted(moment_row, "ridge", alpha=7.0)
    beta = np.linalg.solve(x.T @ x + 7 * np.eye(12), x.T @ y)
    np.testing.assert_allclose(w, beta, atol=1e-8)
    w, _ = fitted(moment_row, "reduced_rank_ridge", alpha=7.0, rank=4)
    augmented = np.r_[x, np.sqrt(7) * np.eye(12)]
    top = np.linalg.svd(augmented @ beta)[2][:4].T
    np.testing.assert_allclose(w, beta @ top @ top.T, atol=1e-7)
    stats = matrixstats.rank_and_determinant(solvers.fit_maps(moment_row, "reduced_rank_ridge", alpha=7.0, rank=4), 1e-8).first()
    assert stats["rank"] == 4 and stats["low_rank_parameters"] == 96 and abs(stats["determinant"]) < 1e-9


def test_additive_and_bias_only(spark, moment_row, xy):
    x, y = xy
    w, b = fitted(moment_row, "additive")
    assert w is None
    np.testing.assert_allclose(b, y.mean(0) - x.mean(0))
    frames = frame_table(spark, {"a": x[:7], "b": y[:9]})
    got = {(r["source"], r["pos"]): r["bias"] for r in solvers.bias_only(frames, pairs.speaker_pairs(frames)).collect()}
    np.testing.assert_allclose([got["a", i] for i in range(12)], y[:9].mean(0) - x[:7].mean(0), atol=1e-6)


def test_matching_ways_agree_and_ties_go_to_the_least_id(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-2, 3, size=(40, 3)), rng.integers(-2, 3, size=(70, 3))
    b[5] = b[3]
    frames = frame_table(spark, {"a": a, "b": b})
    one = spark.createDataFrame([("a", "b")], "source string, target string")
    blocks = {(r["s_id"], r["rank"]): (r["t_id"], round(r["distance"], 9)) for r in matching.topk_blocks(frames.filter("array_max(feat) <> 0 or array_min(feat) <> 0"), one, 3, block=16).collect()}
    s = frames.filter("speaker = 'a'").select(F.col("frame_id").alias("s_id"), F.col("feat").alias("s_feat"))
    t = frames.filter("speaker = 'b'").select(F.col("frame_id").alias("t_id"), F.col("feat").alias("t_feat"))
    plain = {(r["s_id"], r["rank"]): (r["t_id"], round(r["distance"], 9)) for r in matching.topk_expression(s, t, 3).collect()}
    assert {k: v[1] for k, v in blocks.items()} == {k: v[1] for k, v in plain.items()}
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    with np.errstate(all="ignore"):
        d = np.where(norms > 0, 1 - a @ b.T / norms, np.inf)
    for i in np.flatnonzero(np.linalg.norm(a, axis=1)):
        assert blocks[i, 1][1] == round(d[i].min(), 9)


def test_self_match_is_the_frame_itself(spark):
    x = np.random.default_rng(4).normal(size=(30, 5))
    frames = frame_table(spark, {"a": x})
    own = spark.createDataFrame([("a", "a")], "source string, target string")
    assert all(r["s_id"] == r["t_id"] for r in matching.topk_blocks(frames, own, 1, block=8).collect())


def test_factorisation_rebuilds_speakers_of_low_rank(spark):
    rng = np.random.default_rng(5)
    codes = rng.normal(size=(40, 4))
    bases = {s: rng.normal(size=(4, 6)) for s in "abc"}
    aligned = spark.createDataFrame([(i, s, (codes[i] @ v).tolist()) for s, v in bases.items() for i in range(40)], "ref_idx long, speaker string, feat array<double>")
    found = factorise.factorise(aligned, 4)
    wide = np.hstack([codes @ bases[s] for s in "abc"])
    np.testing.assert_allclose(found.singular, np.linalg.svd(wide)[1][:4], rtol=1e-6)
    maps = factorise.maps_from_bases(found.bases, pairs.speaker_pairs(found.bases))
    w = {(r["source"], r["target"]): np.array(r["w"]) for r in maps.collect()}
    np.testing.assert_allclose(codes @ bases["a"] @ w["a", "c"], codes @ bases["c"], atol=1e-6)
    gram = {(r["a"], r["b"], r["i"], r["j"]): r["value"] for r in factorise.gram_entries(aligned).collect()}
    assert gram["a", "b", 1, 2] == pytest.approx((codes @ bases["a"]).T[1] @ (codes @ bases["b"])[:, 2])
    assert gram["c", "a", 3, 0] == pytest.approx((codes @ bases["c"]).T[3] @ (codes @ bases["a"])[:, 0])


def test_project_with_parts_left_out(spark, monkeypatch):
    frames = frame_table(spark, {"a": [[1, 2]], "b": [[3, 4]], "c": [[5, 6]], "d": [[7, 8]]})
    maps = spark.createDataFrame([("a", [[0.0, 1.0], [1.0, 0.0]], [10.0, 20.0]), ("b", None, [1.0, 1.0]), ("c", [[2.0, 0.0], [0.0, 2.0]], None)], "speaker string, w array<array<double>>, bias array<double>")
    want = {"a": [12.0, 21.0], "b": [4.0, 5.0], "c": [10.0, 12.0]}
    assert {r["speaker"]: r["projected"] for r in project.project(frames, maps, ["speaker"]).collect()} == want
    monkeypatch.setattr(project, "BROADCAST_BYTES", -1)
    assert {r["speaker"]: r["projected"] for r in project.project(frames, maps, ["speaker"]).collect()} == want


def test_pca(spark):
    x = np.random.default_rng(6).normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 4
    frames = frame_table(spark, {"a": x})
    mean, components, variance = project.pca(frames, 2)
    cov = np.cov(x.astype(np.float32).astype(float).T)
    np.testing.assert_allclose(variance, np.linalg.eigvalsh(cov)[::-1][:2], rtol=1e-6)
    z = np.array([r["whitened"] for r in project.pca_whiten(frames, mean, components, variance).collect()])
    np.testing.assert_allclose(np.cov(z.T), np.eye(2), atol=1e-6)


@pytest.mark.parametrize(("scores", "want"), [([(0.1, 1), (0.2, 1), (0.8, 0), (0.9, 0)], 0.0), ([(0.1, 0), (0.9, 1)], 1.0), ([(0.5, 0), (0.5, 1)], 0.5), ([(0.1, 1), (0.3, 0), (0.3, 1), (0.9, 0)], 0.25)])
def test_eer(spark, scores, want):
    df = spark.createDataFrame([("t", s, y) for s, y in scores], "tgt_speaker string, score double, label int")
    assert evaluate.eer(df).first()["eer"] == pytest.approx(want)


def test_eer_of_random_ties_equals_the_interpolated_crossing(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for g in range(30):
        s, y = rng.integers(0, 12, 40) / 12, rng.integers(0, 2, 40)
        rows += [(str(g), float(a), int(b)) for a, b in zip(s, y)]
        cut = np.unique(s)
        fpr = np.r_[0, [((s <= c) & (y == 0)).sum() / (y == 0).sum() for c in cut]]
        tpr = np.r_[0, [((s <= c) & (y == 1)).sum() / (y == 1).sum() for c in cut]]
        low, high = 0.0, 1.0
        at = lambda v: np.interp(v, (fpr + tpr) / 2, fpr)
        want[str(g)] = at(0.5)
    df = spark.createDataFrame(rows, "tgt_speaker string, score double, label int")
    got = {r["tgt_speaker"]: r["eer"] for r in evaluate.eer(df).collect()}
    for g, v in want.items():
        assert got[g] == pytest.approx(v)


def test_one_label_has_no_rate(spark):
    df = spark.createDataFrame([("t", 0.5, 1), ("t", 0.6, 1)], "tgt_speaker string, score double, label int")
    assert evaluate.eer(df).first()["eer"] is None


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_text_pairs(spark):
    cases = [("The cat, sat", "the cat sat"), ("", "a b"), ("a  b\tc", "a b c"), (" lead", "lead"), ("Été à l'aube", "été a l aube"), (None, "x"), ("one two three four", "two one three"), ("x" * 50, "x")]
    rng = np.random.default_rng(8)
    cases += [(" ".join(rng.choice(list("abcde"), 12)), " ".join(rng.choice(list("abcde"), 9))) for _ in range(20)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, reference string, hypothesis string")
    norm = {r["i"]: (r["a"], r["b"]) for r in df.select("i", *[text.normalise(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in (("reference", "a"), ("hypothesis", "b"))]).collect()}
    assert norm[0] == ("the cat sat", "the cat sat") and norm[2][0] == "a b c" and norm[3][0] == " lead" and norm[4][0] == "été à laube"
    words = {r["i"]: (r["edits"], r["ref_len"]) for r in evaluate.error_counts(df).collect()}
    chars = {r["i"]: (r["edits"], r["ref_len"]) for r in evaluate.error_counts(df, words=False).collect()}
    for i, (a, b) in norm.items():
        assert words[i] == (word_distance(a.split(), b.split()), len(a.split()))
        assert chars[i] == (word_distance(a, b), len(a))


def test_bootstrap(spark):
    edits, lengths = [1, 0, 3, 2], [4, 5, 6, 7]
    counts = spark.createDataFrame([(i, e, n) for i, (e, n) in enumerate(zip(edits, lengths))], "idx long, edits long, ref_len long")
    index = evaluate.bootstrap_index(spark, 4, 50)
    import hashlib

    rates = []
    for rep in range(50):
        at = [int(hashlib.md5(f"13:{rep}:{k}".encode()).hexdigest()[-15:], 16) % 4 for k in range(4)]
        rates.append(sum(edits[i] for i in at) / sum(lengths[i] for i in at))
    row = evaluate.bootstrap_rate(counts, index).first()
    assert row["mean_percent"] == pytest.approx(100 * np.mean(rates)) and row["std_percent"] == pytest.approx(100 * np.std(rates))


def test_segments(spark):
    frames = frame_table(spark, {"s": [[i] for i in range(10)]})
    rows = [("s", "u", 0, 640, "a"), ("s", "u", 640, 700, "b"), ("s", "u", 700, 1300, "h#"), ("s", "u", 1600, 9000, "c"), ("s", "u", 2000, 2600, "a")]
    raw = spark.createDataFrame(rows, "speaker string, utt string, start_sample long, end_sample long, phone string")
    out = segments.label_frames(frames, segments.bounded(raw))
    assert sorted((r["phone"], r["frame_idx"]) for r in out.collect()) == [("a", 0), ("a", 1), ("a", 6), ("a", 7)] + [("c", i) for i in range(5, 10)]
    assert segments.smallest_group(out, ["phone"]).first()["sample_size"] == 4
    last = segments.bounded(raw, last_only=True)
    assert sorted((r["phone"], r["start_frame"]) for r in last.collect()) == [("a", 6), ("c", 5)]
    sample = segments.stratified(out, ["phone"], 2, "x", "frame_id")
    assert sorted(r["phone"] for r in sample.collect()) == ["a", "a", "c", "c"]


def test_cap_and_exclude(spark):
    frames = frame_table(spark, {"a": [[i] for i in range(5)], "b": [[i] for i in range(2)]})
    assert sorted((r["speaker"], r["frame_idx"]) for r in fr.cap(frames, 3).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert fr.cap(frames, None).count() == 7
    listed = spark.createDataFrame([("b",), ("b",)], "speaker string")
    assert fr.exclude(frames, listed, "speaker").count() == 5 and fr.keep(frames, listed).count() == 2
    assert fr.stacked(frames).filter("speaker = 'b'").first()["matrix"] == [[0.0], [1.0]]


def test_vectors_and_hash(spark):
    row = spark.sql("select array(3.0D, 4.0D) a, array(0.0D, 0.0D) z, array(array(1.0D, 2.0D), array(3.0D, 4.0D)) m")
    out = row.select(vectors.norm("a").alias("n"), vectors.cosine_distance("a", "z").alias("d"), vectors.vector_matrix("a", "m").alias("v"), vectors.mean_of("m").alias("u"), vectors.binarise("a", 3.0).alias("b"), hashing.seed_of(F.lit("abc")).alias("h")).first()
    assert out["n"] == 5 and out["d"] is None and out["v"] == [15.0, 22.0] and out["u"] == [2.0, 3.0] and out["b"] == [3.0, 1.0]
    import hashlib

    assert out["h"] == int(hashlib.sha256(b"abc").hexdigest(), 16) % 2**32


def test_evaluation_pairs(spark):
    rows = [(s, n, f"{s}_{n:03d}") for s in ("p1", "p2", "p3") for n in range(1, 60) if (s, n) != ("p3", 51)] + [("p4", 7, "p4_007")]
    out = pairs.evaluation_pairs(spark.createDataFrame(rows, "speaker string, utt_no int, utt string")).collect()
    files = {f"{s}/{u}.wav" for s, _, u in rows}
    converted, truth = [r for r in out if not r["label"]], [r for r in out if r["label"]]
    assert len(converted) == 6 * 5 and len(truth) == 9 * 5
    assert {(r["output_fn"], r["reference_fn"]) for r in converted if (r["source"], r["target"]) == ("p3", "p1")} == {(f"p3-p1/p3_{n:03d}.wav", f"p1/p1_{n:03d}.wav") for n in (50, 52, 53, 54, 55)}
    assert all(r["reference_fn"] in files for r in out) and all(r["output_fn"] in files for r in truth)
    for r in truth:
        assert r["source"] == r["target"] and r["output_fn"] != r["reference_fn"]
        assert int(r["reference_fn"][-7:-4]) > 25
    own = [r["output_fn"] for r in truth if r["source"] == "p3"]
    assert sorted(set(own)) == [f"p3/p3_{n:03d}.wav" for n in (50, 52, 53, 54, 55)] and all(own.count(x) == 3 for x in own)
    assert len({(r["output_fn"], r["reference_fn"]) for r in truth}) > 30


def test_a_missing_map_is_an_error(spark):
    wanted = spark.createDataFrame([("a", "b"), ("a", "c")], "source string, target string")
    maps = spark.createDataFrame([("a", "b", 1)], "source string, target string, v int")
    with pytest.raises(Exception, match="no map for a and c"):
        pairs.with_map(wanted, maps).collect()
