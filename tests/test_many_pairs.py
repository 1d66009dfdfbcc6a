"""Joins of utterances whose pairs are many more than they are."""

from pyspark.sql import functions as F

from framewright import queries
from framewright.operators import evaluate, pairs


def test_first_sentences_of_many_readings(spark):
    """90,000 readings of two sentences by three speakers: 3.6 billion pairs, of which 30 are wanted."""
    rows = spark.range(90_000).select(F.concat(F.lit("p"), F.col("id") % 3).alias("speaker"), (50 + F.col("id") % 2).cast("int").alias("utt_no"), F.format_string("u%06d", "id").alias("utt"))
    got = pairs.first_parallel(rows, 5, 50).filter("source = 'p1' and target = 'p2'").orderBy("s_utt", "t_utt").collect()
    # sentence 50 is read by p1 from u000004 on, by p2 from u000002 on, every sixth
    assert [(r["utt_no"], r["s_utt"], r["t_utt"]) for r in got] == [(50, "u000004", f"u{2 + 6 * k:06d}") for k in range(5)]
    out = pairs.evaluation_pairs(rows, 5, 50, 25).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {0: 30, 1: 30}


def test_first_parallel_is_the_first_of_all_pairs(spark):
    rows = spark.range(400).select(F.concat(F.lit("p"), F.col("id") % 4).alias("speaker"), (47 + F.hash("id") % 6).cast("int").alias("utt_no"), F.concat(F.lit("u"), F.hash("id") % 50).alias("utt"))
    cells = lambda df: sorted(map(tuple, df.select("source", "target", "utt_no", "s_utt", "t_utt").collect()))
    assert cells(pairs.first_parallel(rows, 5, 48)) == cells(pairs.first_existing(pairs.parallel_by_number(rows), 5, 48, ties=("s_utt", "t_utt")))


def test_a_name_with_many_pairs_is_many_tasks(spark):
    s = spark.range(300).select(F.when(F.col("id") < 290, "a").when(F.col("id") < 299, "b").alias("file_name"), F.col("id").alias("s_utt"))
    t = spark.range(500).select(F.when(F.col("id") < 480, "a").otherwise("b").alias("file_name"), F.col("id").alias("t_utt"))
    out = pairs.parallel_by_name(s, t, cell=10_000)
    assert out.columns == ["file_name", "s_utt", "t_utt"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {("a", i, j) for i in range(290) for j in range(480)} | {("b", i, j) for i in range(290, 299) for j in range(480, 500)}
    made = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(made) < 290 * 480 / 2


def test_copies_for_cells_are_spread_and_not_broadcast(spark, request):
    """A file of one task, 600 rows in 40 cells: its copies are made by many tasks and dealt, not sent whole to each."""
    s = spark.range(0, 200, 1, 1).select(F.lit("a").alias("file_name"), F.col("id").alias("s_utt"))
    t = spark.range(0, 400, 1, 1).select(F.lit("a").alias("file_name"), F.col("id").alias("t_utt")).unionByName(spark.range(3).select(F.lit(None).cast("string").alias("file_name"), F.col("id").alias("t_utt")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2**63 - 1))  # as if each side were estimated to be small
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    out = pairs.parallel_by_name(s, t, cell=2_000, copies=100)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {("a", i, j) for i in range(200) for j in range(400)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    cells = [x for x in plan.splitlines() if "Join" in x and "_i#" in x]
    assert len(cells) == 1 and "SortMergeJoin" in cells[0]
    dealt = [int(x.split("RoundRobinPartitioning(")[1].split(")")[0]) for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "RoundRobinPartitioning(" in x]
    assert len(dealt) >= 2 and min(dealt) >= 10


def test_either_side_may_be_the_shorter(spark):
    s = spark.range(400).select(F.col("id").alias("note"), F.lit("a").alias("file_name"), F.col("id").alias("s_utt"))
    t = spark.range(50).select(F.lit("a").alias("file_name"), F.col("id").alias("note"))
    want = {("a", i, i, j) for i in range(400) for j in range(50)}
    out = pairs.parallel_by_name(s, t, cell=1_000)
    assert out.columns == ["file_name", "note", "s_utt", "note"] and {tuple(r) for r in out.collect()} == want
    out = pairs.parallel_by_name(t, s, cell=1_000)
    assert out.columns == ["file_name", "note", "note", "s_utt"] and {(n, i, k, j) for n, j, i, k in map(tuple, out.collect())} == want
    assert out.count() == 400 * 50


def test_bootstrap_draws_what_its_sql_draws(spark, monkeypatch):
    index = evaluate.bootstrap_index(spark, 50, 20, draws=8)
    sums = {r["rep"]: r["n"] for r in index.groupBy("rep").agg(F.sum("times").alias("n")).collect()}
    assert sums == {k: 8 for k in range(20)} and index.filter("idx >= 8").count() > 0
    assert f"range({queries.SQL_DRAWS})" in queries.ORACLE_SQL["bootstrap_cer"]
