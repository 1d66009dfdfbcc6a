"""Nearest frames in cells: blocks that pass by, and rows made where they meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import factorise, matching, moments, solvers


def table(spark, sides):
    rows = [(s, i, v) for s, (ids, x) in sides.items() for i, v in zip(ids, x.tolist(), strict=True)]
    return spark.createDataFrame(rows, "speaker string, frame_id long, feat array<double>")


@pytest.mark.parametrize("k", [1, 3])
def test_matched_rows_are_made_where_blocks_meet(spark, monkeypatch, k):
    """Many blocks a cell, ties, a frame without direction, a target of fewer than k frames; no exchange follows the products."""
    monkeypatch.setattr(matching, "ROWS", 7)
    monkeypatch.setattr(matching, "TILE", 5)
    monkeypatch.setattr(matching, "HELD_FRAMES", 10)
    rng = np.random.default_rng(21)
    x, y, few = rng.normal(size=(90, 6)), rng.normal(size=(70, 6)), rng.normal(size=(2, 6))
    x[4], y[9], y[50] = 0, 2 * y[30], 3 * y[30]
    frames = table(spark, {"a": (range(90), x), "b": (range(100, 170), y), "c": (range(300, 302), few)})
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "source string, target string")
    out = matching.matched_blocks(frames, pairs, k, block=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]
    got = {(r["source"], r["target"], r["s_id"]): (r["x"], r["y"]) for r in out.collect()}
    ids = {"a": (0, x), "b": (100, y), "c": (300, few)}
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1), 1e-300)[:, None]
    want = {}
    for s, t in (("a", "b"), ("b", "a"), ("a", "c")):
        (first, own), (_, other) = ids[s], ids[t]
        distance = np.round(1 - unit(own) @ unit(other).T, 12)
        for i in np.flatnonzero(np.linalg.norm(own, axis=1)):
            near = [j for j in np.lexsort((np.arange(len(other)), distance[i])) if np.linalg.norm(other[j])][:k]
            want[s, t, first + int(i)] = (own[i], other[near].mean(0))
    assert set(got) == set(want)
    for key, (p, q) in want.items():
        assert got[key][0] == p.tolist()
        np.testing.assert_allclose(got[key][1], q, atol=1e-12)
    ranked = matching.matched_pairs(matching.topk_blocks(frames, pairs, k, block=8), frames)
    for r in ranked.collect():
        np.testing.assert_allclose(got[r["source"], r["target"], r["s_id"]][1], r["y"], atol=1e-12)


def test_additive_map_from_moments_of_each_dimension(spark):
    rng = np.random.default_rng(22)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=(50, 3))
    rows = spark.createDataFrame([("a", "b", p, q) for p, q in zip(x.tolist(), y.tolist())], "source string, target string, x array<double>, y array<double>")
    maps = solvers.fit_maps(moments.diagonal_moments(rows), "additive", keys=["source", "target", "pos"])
    got = [r["b"] for r in maps.orderBy("pos").select(F.col("bias")[0].alias("b")).collect()]
    np.testing.assert_allclose(got, (y - x).mean(0), atol=1e-12)


def test_adjoint_is_summed_where_the_blocks_meet(spark):
    """No group of blocks that grows with the frames: one sum a speaker and task is what is shuffled."""
    rng = np.random.default_rng(23)
    n, x = 120, rng.normal(size=(120, 6))
    rows = spark.createDataFrame([(i, s, x[i, 3 * j : 3 * j + 3].tolist()) for i in range(n) for j, s in enumerate("ab")], "ref_idx long, speaker string, feat array<double>")
    blocks, q = factorise.blocks_of(rows), rng.normal(size=(n, 2))
    narrow = factorise.times(blocks, spark.createDataFrame([(s, bytearray(v.tobytes())) for s, v in zip("ab", np.linalg.lstsq(x, q, rcond=None)[0].reshape(2, 3, 2))], factorise.PARTS))
    found = factorise.adjoint(blocks, narrow)
    assert found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0].count("FlatMapGroupsInArrow") == 1
    fit = x @ np.linalg.lstsq(x, q, rcond=None)[0]
    for r in found.collect():
        j = "ab".index(r["speaker"])
        np.testing.assert_allclose(np.frombuffer(r["x"]).reshape(3, 2), x[:, 3 * j : 3 * j + 3].T @ fit, atol=1e-9)
