"""The pipeline's stages, each against what it must do to its own input."""

from collections import Counter
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm.decontaminate import decontaminate
from framewright.llm.mixing import mix_sources
from framewright.llm.quality_classifier import quality_classifier

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, steps):
    raw, good, single, clean, mixed, sharded = steps
    for a, b in ((raw, good), (good, single), (single, clean), (clean, mixed)):
        assert a.columns == b.columns
        before = {tuple(r) for r in a.collect()}
        assert {tuple(r) for r in b.collect()} <= before
    assert ids(good) == Counter(r["doc_id"] for r in quality_classifier(raw).collect() if r["kept"])
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert ids(single) == Counter({c for _, _, c in brute.components(rows)})
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate(single, bench).collect()}
    assert hit and ids(clean) == Counter(set(ids(single)) - hit)
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    items = [r["text"] for r in bench.collect()]
    for i, text in texts.items():  # verbatim copies are among them
        assert i in hit or not any(item in text for item in items)
    assert ids(mixed) == Counter({r["doc_id"]: r["copies"] for r in mix_sources(clean).collect() if r["copies"]})
    assert ids(sharded) == ids(mixed) and sharded.columns[-3:] == ["shard", "slot", "grown_shard"]
    for shard in {r["shard"] for r in sharded.collect()}:
        slots = sorted(r["slot"] for r in sharded.collect() if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_run_is_the_chain(spark, steps):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, steps[-1].collect()))


CLASHES = ["size", "chunk", "shard", "place", "offset", "row", "n", "key", "fp", "hash", "_fp", "_id", "_mix_copy", "_mix_source", "copy", "base", "threshold", "its_source", "at", "score", "votes", "data", "item_id"]


def test_stages_keep_clashing_columns_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.select((docs["doc_id"] % 7).alias("doc_id"), *docs.columns[1:])).unionByName(docs.limit(3).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes}))
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        extra = ["shard", "slot", "grown_shard"] if name == "sharding" else []
        assert out.columns == [c for c in docs.columns if c not in extra] + extra
        rows = out.collect()
        assert rows and all(r[c] is None or r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES if c not in extra)
        assert all(stage(spark, docs.filter("false"), SF).count() == 0 for _ in range(1))


def test_run_leaves_one_table(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(Path(folder, "tables").glob("*"))
    corpus_pipeline.run(spark, SF).count()
    assert len(set(Path(folder, "tables").glob("*")) - before) == 1
