"""What engine functions must do besides what their own tests ask."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import queries
from framewright.functions import text
from framewright.operators import evaluate, factorise, frames, lasso, matching, moments, pairs, project, reduced_rank, signal, solvers

SF = "/root/testdata/sf0.001"


def test_word_edits_of_many_distinct_words(spark):
    words = [f"w{k}" for k in range(46_000)]
    rows = [(words, [words[35_400], "x", words[45_700]]), (words, words[35_327:35_330] + [words[-1]]), (["a", "b"], ["a", "c", "b"]), ([], ["a"]), ([], [])]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>")
    assert [r[0] for r in df.select(text.word_edits(F.col("x"), F.col("y"))).collect()] == [45_998, 45_996, 1, 1, 0]


def test_wrong_power_does_not_pass(spark, monkeypatch):
    right = signal.spectrogram
    assert queries.spectrogram_data(spark, SF).filter("bins is null").count() == 0
    monkeypatch.setattr(signal, "spectrogram", lambda *a: right(*a).withColumn("power_db", F.reverse("power_db")))
    assert queries.spectrogram_data(spark, SF).filter("bins is null").count() > 0


def test_wrong_codes_do_not_pass(spark, monkeypatch):
    right = project.project
    square = lambda: {r["frame_id"]: r["square"] for r in queries.content_codes(spark, SF).collect()}
    good = square()
    monkeypatch.setattr(project, "project", lambda *a, **b: right(*a, **b).withColumn("code", F.reverse("code")))
    assert square() != good


@pytest.mark.parametrize("shape", [(400, 40), (30, 64), (500, 64)])
def test_full_width_fits(spark, shape):
    """M1-M8 and the factor's least squares against numpy on the rows themselves."""
    rng = np.random.default_rng(shape[0])
    n, d = shape
    x = rng.normal(size=(n, d)) * np.logspace(0, -2, d)
    y = x @ rng.normal(size=(d, d)) + 0.1 * rng.normal(size=(n, d)) + 1
    rows = spark.createDataFrame([("a", "b", p.tolist(), q.tolist()) for p, q in zip(x, y)], "source string, target string, x array<double>, y array<double>")
    states = moments.pair_moments(rows).cache()
    fit = lambda method, **o: solvers.fit_maps(states, method, **o).first()
    close = lambda a, b: np.testing.assert_allclose(np.array(a), b, rtol=1e-5, atol=1e-6 * np.abs(b).max())
    xc, yc = x - x.mean(0), y - y.mean(0)
    close(fit("least_squares")["w"], np.linalg.lstsq(x, y, rcond=None)[0])
    close(fit("least_squares_bias")["w"], np.linalg.lstsq(xc, yc, rcond=None)[0])
    close(fit("ridge", alpha=3.0)["w"], np.linalg.solve(x.T @ x + 3 * np.eye(d), x.T @ y))
    if n > d:  # else the polar factor is not unique
        for method, a, b in (("orthogonal", x, y), ("orthogonal_bias", xc, yc)):
            u, _, vt = np.linalg.svd(a.T @ b)
            close(fit(method)["w"], u @ vt)
    beta = np.linalg.lstsq(np.vstack([x, np.sqrt(3) * np.eye(d)]), np.vstack([y, np.zeros((d, d))]), rcond=None)[0]
    top = np.linalg.svd(np.vstack([x, np.sqrt(3) * np.eye(d)]) @ beta)[2][:5]
    close(fit("reduced_rank_ridge", alpha=3.0, rank=5)["w"], beta @ top.T @ top)
    for method, a, b in (("lasso", x, y), ("lasso_bias", xc, yc)):
        w = np.array(fit(method, alpha=0.05)["w"])
        slope = a.T @ (b - a @ w) / n
        assert np.abs(slope).max() <= 0.05 + 1e-7 and (w == 0).any() and (w != 0).any()
        np.testing.assert_allclose(slope[w != 0], 0.05 * np.sign(w[w != 0]), atol=1e-7)
    factors = moments.pair_factors(rows).cache()
    close(solvers.fit_factors(factors).first()["w"], np.linalg.lstsq(x, y, rcond=None)[0])
    row = solvers.fit_factors(factors, bias=True).first()
    w = np.linalg.lstsq(xc, yc, rcond=None)[0]
    close(row["w"], w)
    close(row["bias"], y.mean(0) - x.mean(0) @ w)


def near_low_rank(seed=1, n=400, d=256, rank=6, outputs=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, d)) + 1e-3 * rng.normal(size=(n, d))
    y = x @ (rng.normal(size=(d, outputs)) * (rng.random((d, outputs)) < 0.05)) + 0.1 * rng.normal(size=(n, outputs))
    return x, y


def test_lasso_of_nearly_dependent_columns_reaches_its_gap():
    x, y = near_low_rank()
    g, c, h = x.T @ x / len(x), x.T @ y / len(x), np.square(y).mean(axis=0)
    w, gap = lasso.solve(g, c, h, 1e-3)
    assert gap.max() <= lasso.TOLERANCE
    slope = c - g @ w
    assert np.abs(slope).max() <= 1e-3 * 1.01
    # no other map does better
    cost = lambda w: np.square(y - x @ w).mean(axis=0) / 2 + 1e-3 * np.abs(w).sum(axis=0)
    rng = np.random.default_rng(2)
    for _ in range(20):
        assert (cost(w) <= cost(w + 1e-3 * rng.normal(size=w.shape)) + 1e-12).all()


def test_lasso_path_and_its_flag(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 10))
    y = x @ rng.normal(size=(10, 4)) + 2
    rows = spark.createDataFrame([("a", "b", p.tolist(), q.tolist()) for p, q in zip(x, y)], "source string, target string, x array<double>, y array<double>")
    states = moments.pair_moments(rows).cache()
    alphas = [0.01, 1.0, 0.1]
    out = {r["alpha"]: r for r in lasso.lasso_path(states, alphas, bias=True).collect()}
    assert set(out) == set(alphas) and all(r["settled"] for r in out.values())
    for alpha, r in out.items():
        one = solvers.fit_maps(states, "lasso_bias", alpha=alpha).first()
        np.testing.assert_allclose(np.array(r["w"]), np.array(one["w"]), atol=1e-4)
        np.testing.assert_allclose(np.array(r["bias"]), y.mean(0) - x.mean(0) @ np.array(r["w"]), atol=1e-8)
    assert not any(r["settled"] for r in lasso.lasso_path(states, [0.01], tolerance=-1.0).collect())
    with pytest.raises(Exception, match="gap"):
        solvers.fit_maps(states, "lasso", alpha=0.01, tolerance=-1.0).collect()


def test_lasso_without_signal():
    zero = np.zeros((3, 3))
    w, gap = lasso.solve(zero, zero, np.zeros(3), 0.1)
    assert not w.any() and not gap.any()
    w, gap = lasso.solve(np.eye(3), np.eye(3), np.ones(3), 2.0)
    assert not w.any() and (gap <= 1e-12).all()


def test_ranks_from_one_decomposition(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(60, 7)), rng.normal(size=(60, 5)) + 3
    rows = spark.createDataFrame([("a", "b", p.tolist(), q.tolist()) for p, q in zip(x, y)], "source string, target string, x array<double>, y array<double>")
    states = moments.pair_moments(rows).cache()
    spectra = reduced_rank.ridge_spectra(states, [2.0, 9.0]).cache()
    assert spectra.count() == 2
    xc, yc = x - x.mean(0), y - y.mean(0)
    for r in reduced_rank.at_ranks(spectra, [1, 3, 5]).collect():
        one = solvers.fit_maps(states, "reduced_rank_ridge_bias", alpha=r["alpha"], rank=r["rank"]).first()
        w, vr = np.array(r["w"]), np.array(r["vr"])
        np.testing.assert_allclose(w, np.array(one["w"]), atol=1e-9)
        np.testing.assert_allclose(r["bias"], one["bias"], atol=1e-9)
        beta = np.linalg.solve(xc.T @ xc + r["alpha"] * np.eye(7), xc.T @ yc)
        np.testing.assert_allclose(np.array(r["vrt_times_beta"]), vr.T @ beta.T, atol=1e-9)
        assert r["rank_"] == r["rank"] and vr.shape == (5, r["rank"])
    plain = reduced_rank.at_ranks(reduced_rank.ridge_spectra(states, [2.0], bias=False), [2]).first()
    assert plain["bias"] == [0.0] * 5
    np.testing.assert_allclose(np.array(plain["w"]), np.array(solvers.fit_maps(states, "reduced_rank_ridge", alpha=2.0, rank=2).first()["w"]), atol=1e-9)


def test_factors_keep_small_singular_values(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 12)) @ np.diag(np.logspace(0, -8, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    w = rng.normal(size=(12, 3))
    rows = spark.createDataFrame([("a", "b", p.tolist(), q.tolist()) for p, q in zip(x, x @ w)], "source string, target string, x array<double>, y array<double>")
    np.testing.assert_allclose(np.array(solvers.fit_factors(moments.pair_factors(rows)).first()["w"]), w, atol=1e-5)


def test_numbered_rows(spark):
    rows = [(i * 7919 % 1000, f"k{i}") for i in range(1000)]
    out = frames.numbered(spark.createDataFrame(rows, "a int, b string").repartition(7), "a").collect()
    assert sorted((r["a"], r["idx"]) for r in out) == [(i, i) for i in range(1000)]
    assert frames.numbered(spark.createDataFrame([], "a int"), "a").count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_factorisation_against_svd(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(factorise, "BLOCK", block)
    rng = np.random.default_rng(2)
    stacks = {s: rng.normal(size=(40, 16)) for s in "abc"}
    stacks["c"][5:9] = 0  # frames that c lacks
    rows = [(10 * i, s, m[i].tolist()) for s, m in stacks.items() for i in range(40) if s != "c" or not 5 <= i < 9]
    found = factorise.factorise(spark.createDataFrame(rows, "ref_idx long, speaker string, feat array<double>"), 6)
    u, values, vt = np.linalg.svd(np.hstack([stacks[s] for s in "abc"]), full_matrices=False)
    np.testing.assert_allclose(found.singular, values[:6])
    left = np.array([r["u"] for r in found.left.orderBy("ref_idx").collect()])
    np.testing.assert_allclose(left @ left.T, u[:, :6] @ u[:, :6].T, atol=1e-6)
    bases = {r["speaker"]: np.array(r["basis"]) for r in found.bases.collect()}
    wide = np.hstack([bases[s] for s in "abc"])
    np.testing.assert_allclose(wide.T @ wide, vt[:6].T @ vt[:6], atol=1e-6)
    np.testing.assert_allclose(left * found.singular @ wide, u[:, :6] * values[:6] @ vt[:6], atol=1e-6)
    maps = {(r["source"], r["target"]): np.array(r["w"]) for r in factorise.maps_from_bases(found.bases, pairs.speaker_pairs(found.bases)).collect()}
    for (s, t), w in maps.items():
        a, b = (vt[:6, 16 * "abc".index(k) : 16 * "abc".index(k) + 16] for k in (s, t))
        np.testing.assert_allclose(w, np.linalg.pinv(a) @ b, atol=1e-5)
    found.write(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/XS").count() == len(rows)
    assert spark.read.parquet(f"{tmp_path}/U").count() == 40
    np.testing.assert_allclose([r["value"] for r in spark.read.parquet(f"{tmp_path}/S").orderBy("place").collect()], values[:6])
    assert spark.read.parquet(f"{tmp_path}/VT").count() == 3


def test_factorisation_of_little(spark):
    ddl = "ref_idx long, speaker string, feat array<double>"
    none = factorise.factorise(spark.createDataFrame([], ddl), 3)
    assert none.left.count() == none.bases.count() == len(none.singular) == 0
    zero = factorise.factorise(spark.createDataFrame([(1, "a", [0.0, 0.0])], ddl), 3)
    assert zero.bases.count() == len(zero.singular) == 0
    # a rank over that of the matrix gives the triples that there are
    one = factorise.factorise(spark.createDataFrame([(i, "a", [3.0 * i, 4.0 * i]) for i in range(3)], ddl), 3)
    np.testing.assert_allclose(one.singular, [5 * np.sqrt(5)])
    np.testing.assert_allclose(np.abs(one.bases.first()["basis"]), [[0.6, 0.8]])


def test_factorisation_that_does_not_settle_is_an_error(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "a", v) for i, v in enumerate(rng.normal(size=(60, 50)).tolist())]
    with pytest.raises(ArithmeticError):
        factorise.factorise(spark.createDataFrame(rows, "ref_idx long, speaker string, feat array<double>"), 2, extra=1, steps=1, rounds=2)


def test_hot_speaker_is_many_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("a", "u", i, i, v) for i, v in enumerate(rng.normal(size=(300, 4)).tolist())] + [("b", "u", i, 1000 + i, v) for i, v in enumerate(rng.normal(size=(50, 4)).tolist())]
    f = spark.createDataFrame(rows, "speaker string, utt string, frame_idx long, frame_id long, feat array<double>")
    wanted = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    few, many = (sorted(map(tuple, matching.topk_blocks(f, wanted, 3, block=b).select("s_id", "t_id", "rank").collect())) for b in (16, 1024))
    assert few == many and len(few) == 350 * 3


@pytest.mark.parametrize("slice_size", [1, 7, 100_000])
def test_eer_in_slices(spark, slice_size):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for g, n in (("hot", 3000), ("b", 40), ("c", 3), (None, 50)):
        y = rng.integers(0, 2, n)
        s = np.round(rng.normal(size=n) - y, 3)
        rows += [(g, float(a), int(b)) for a, b in zip(s, y)]
        cut = np.unique(s)
        fpr, tpr = (np.r_[0, [((s <= c) & (y == k)).sum() / max((y == k).sum(), 1) for c in cut]] for k in (0, 1))
        want[g] = np.interp(0.5, (fpr + tpr) / 2, fpr) if 0 < y.sum() < n else None
    df = spark.createDataFrame(rows, "tgt_speaker string, score double, label int")
    got = {r["tgt_speaker"]: r["eer"] for r in evaluate.eer(df, slice_size=slice_size).collect()}
    assert set(got) == set(want)
    for g in ("hot", "b", "c"):
        assert (got[g] is None) if want[g] is None else got[g] == pytest.approx(want[g])
    plan = evaluate.eer(df, slice_size=slice_size)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "AS cp" in line]
    assert windows and all("slice" in line for line in windows)  # no window sorts a group's scores at once


def test_cap_counts_before_it_reads(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(s, f"u{u}", i, [float(i)]) for s in ("a", "b", None) for u in range(6) for i in range(int(rng.integers(1, 9)))]
    ddl = "speaker string, utt string, frame_idx long, feat array<double>"
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    for n in (1, 4, 11, 1000):
        want = sorted(str(r[:3]) for s in ("a", "b", None) for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1:3])[:n])
        assert sorted(str((r["speaker"], r["utt"], r["frame_idx"])) for r in frames.cap(df, n).collect()) == want
    plan = frames.cap(df, 4)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("feat" in line for line in scans) < len(scans)  # utterances are counted without their vectors
    assert "row_number() windowspecdefinition(speaker" in plan and "utt" in plan.split("row_number() windowspecdefinition(")[1].split(")")[0]


def test_resampled_sums(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows = [(int(e), int(n)) for e, n in zip(rng.integers(0, 9, 500), rng.integers(5, 30, 500))]
    df = spark.createDataFrame(rows, "edits int, ref_len int").repartition(3)
    out = evaluate.resampled_sums(df, 200, block=64).collect()
    assert len(out) == 200 and all(r["draws"] == 500 for r in out)
    # every row is drawn about as often as any other: sums are those of resamples
    for field, column in (("edits", 0), ("ref_len", 1)):
        x = np.array([r[column] for r in rows], float)
        sums = np.array([r[field] for r in out], float)
        assert abs(sums.mean() - x.sum()) < 4 * x.std() * np.sqrt(500) / np.sqrt(200)
        assert 0.8 < sums.std() / (x.std() * np.sqrt(500)) < 1.25
    assert evaluate.resampled_sums(df.filter("false"), 5).count() == 0
    one = evaluate.resampled_sums(spark.createDataFrame([(3, 7)], "edits int, ref_len int"), 4).collect()
    assert {(r["draws"], r["edits"], r["ref_len"]) for r in one} == {(1, 3, 7)}


def test_lasso_of_one_column_is_exact_where_a_coefficient_barely_enters():
    """Soft thresholding to the last digits: a met gap alone leaves a coefficient of 2e-6 at zero, and others off by 1e-5."""
    g, alpha = np.array([[0.0149]]), 0.002
    c = np.array([[0.002 + 3e-8, -0.002 - 3e-8, 0.002, 0.0019, 0.0031, -0.0155]])
    w, gap = lasso.solve(g, c, np.full(6, 0.0161), alpha)
    np.testing.assert_allclose(w[0], np.sign(c[0]) * np.maximum(np.abs(c[0]) - alpha, 0) / g[0, 0], rtol=1e-7, atol=1e-13)
    assert (gap <= lasso.TOLERANCE).all()
