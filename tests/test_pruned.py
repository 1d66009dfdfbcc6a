"""Top-k joins that skip pairs of balls."""

import numpy as np
import pytest

from framewright.operators import pruned

SCHEMA = "speaker string, frame_id long, feat array<double>"


def table(spark, sides):
    rows, at = [], 0
    for speaker, x in sides.items():
        rows += [(speaker, at + i, v) for i, v in enumerate(x.tolist())]
        at += len(x)
    return spark.createDataFrame(rows, SCHEMA)


def clustered(rng, centres, n, spread):
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, centres.shape[1])) * spread


def plain(x, y, first_y, k):
    """(row of x, rank) -> (id, distance) by all products."""
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
    with np.errstate(all="ignore"):
        d = np.where(norm > 0, 1 - x @ y.T / norm, np.inf)
    out = {}
    for i, row in enumerate(d):
        order = np.lexsort((np.arange(len(row)), np.round(row, 12)))[:k]
        out |= {(i, rank + 1): (first_y + int(j), round(float(row[j]), 9)) for rank, j in enumerate(order) if np.isfinite(row[j])}
    return out


def found(df):
    return {(r["s_id"], r["rank"]): (r["t_id"], round(r["distance"], 9)) for r in df.collect()}


@pytest.mark.parametrize(("spread", "k"), [(0.02, 1), (0.3, 5), (3.0, 5)])
def test_equals_all_products(spark, spread, k):
    rng = np.random.default_rng(int(spread * 100) + k)
    centres = rng.normal(size=(12, 16)) * 3
    a, b = clustered(rng, centres, 150, spread), clustered(rng, centres, 260, spread)
    frames = table(spark, {"a": a, "b": b})
    one = spark.createDataFrame([("a", "b")], "source string, target string")
    assert found(pruned.topk_pruned(frames, one, k, block=16)) == plain(a, b, len(a), k)


def test_clustered_frames_skip_most_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 24)) * 4
    frames = table(spark, {"a": clustered(rng, centres, 400, 0.02), "b": clustered(rng, centres, 800, 0.02)})
    one = spark.createDataFrame([("a", "b")], "source string, target string")
    held = pruned.balls(frames, block=16)
    pairs = pruned.bounded_pairs(held, one, 3).collect()
    counts = {r["speaker"]: r["count"] for r in held.groupBy("speaker").count().collect()}
    assert len(pairs) == counts["a"] * counts["b"]
    assert sum(r["near"] for r in pairs) < len(pairs) / 2
    assert all(r["low"] <= r["high"] + 1e-12 for r in pairs)
    assert held.agg({"n": "sum"}).first()[0] == 1200


def test_bounds_hold(spark):
    rng = np.random.default_rng(6)
    frames = table(spark, {"a": rng.normal(size=(120, 6)), "b": rng.normal(size=(90, 6))})
    one = spark.createDataFrame([("a", "b")], "source string, target string")
    held = pruned.balls(frames, block=16)
    rows = {(r["speaker"], r["ball"]): np.frombuffer(r["matrix"]).reshape(r["n"], -1) for r in held.collect()}
    for r in pruned.bounded_pairs(held, one, 2).collect():
        x, y = pruned.unit(rows["a", r["a"]]), pruned.unit(rows["b", r["b"]])
        d = 1 - x @ y.T
        assert r["low"] - 1e-9 <= d.min() and d.max() <= r["high"] + 1e-9


def test_ties_copies_zeros_and_few_targets(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(-1, 2, size=(60, 3)).astype(float), rng.integers(-1, 2, size=(90, 3)).astype(float)
    b[10:70] = [1.0, 1.0, 0.0]  # one direction is most of a speaker
    frames = table(spark, {"a": a, "b": b, "c": a[:0].reshape(0, 3), "d": rng.normal(size=(2, 3))})
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "nobody"), ("a", "b")], "source string, target string")
    got = pruned.topk_pruned(frames, pairs, 4, block=8).cache()
    assert found(got.filter("target = 'b'")) == plain(a, b, 60, 4)
    directed = int((np.linalg.norm(a, axis=1) > 0).sum())
    assert got.filter("target = 'd'").count() == 2 * directed
    assert got.filter("target not in ('b', 'd')").count() == 0
    assert pruned.balls(frames, block=8).agg({"n": "max"}).first()[0] <= 64


def test_empty(spark):
    one = spark.createDataFrame([("a", "b")], "source string, target string")
    assert pruned.topk_pruned(spark.createDataFrame([], SCHEMA), one, 2).count() == 0
    assert pruned.topk_pruned(table(spark, {"a": np.zeros((3, 2)), "b": np.ones((2, 2))}), one, 2).count() == 0


def test_rows_that_meet_do_not_grow_with_the_number_of_balls(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(900, 8)), rng.normal(size=(1100, 8))
    frames = table(spark, {"a": a, "b": b})
    one = spark.createDataFrame([("a", "b")], "source string, target string")
    met, right = [], pruned.bounded_pairs
    monkeypatch.setattr(pruned, "bounded_pairs", lambda *x: met.append(right(*x)) or met[-1])
    assert found(pruned.topk_pruned(frames, one, 3, block=4)) == plain(a, b, 900, 3)
    assert met[0].count() == 1
    monkeypatch.setattr(pruned, "pages", lambda held, pages=pruned.pages: pages(held, 100))
    assert found(pruned.topk_pruned(frames, one, 3, block=4)) == plain(a, b, 900, 3)
