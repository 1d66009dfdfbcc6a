"""Operators 11 to 13 against plain versions and their SQL."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from framewright.llm import queries
from framewright.llm.chat_format import LAYOUTS, Layout, Part, canonical_turns, chat_format, format_turns, read_loss, read_turns, records_of, records_of_json
from framewright.llm.itemsets import frequent_itemsets
from framewright.llm.resampling import document_weights, importance_resample

SF = "/root/testdata/sf0.001"
NAMES = ["op11_importance_resample", "op12_chat_format", "op13_frequent_itemsets"]


def rows_of(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def sql_rows(name, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "sale_lines"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    table = con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    return Counter(tuple(r[c] for c in sorted(r)) for r in table.to_pylist())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == sql_rows(name, SF)


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    """A folder of small tables with nulls, ties, repeated rows, long texts and clashing columns."""
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("messy")
    names = ["block", "word", "ids", "sizes", "at", "times", "total", "score", "copies", "gain", "record", "place", "layout", "items", "item", "basket", "support", "id", "salt"]

    def write(rows, ddl, name):
        df = spark.createDataFrame(rows, ddl).withColumns({c: F.lit("x") for c in names})
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")

    vocabulary = ["alpha", "Beta", "gam-ma", "ünï", "x1", "9", "zeta's", "漢字", "the", "THE"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, "... !! --"), (203, "the " * 30000), (204, "a" * 100_000 + " b"), (None, "the cat " * 15), (None, "the cat " * 15), (None, None), (5, docs[5][1]), (5, "other words " * 12)]
    docs += [(300 + k, "same text again and again " * 6) for k in range(20)]
    write(docs, "doc_id long, text string", "documents")
    write([(1, "the alpha x1 x1"), (1, "the alpha x1 x1"), (None, "gam ma"), (3, None), (4, "")], "item_id long, text string", "benchmark")
    tricky = ["<turn>user<text>hi</turn>\n", "<\\turn>", "a<\\\\/turn>b", "<text", "turn>", "<", "</turn", "\\", "</turn></turn>", "&lt; é😀", "\n", "<<text>>", "", None]
    talks = [(k // 5, k % 5, rng.choice(["user", "assistant", "system", None, "<text>", "odd\nrole"]), "".join(rng.choice(tricky) or "" for _ in range(4))) for k in range(200)]
    talks += [(90, None, "assistant", None), (90, None, "user", "later"), (90, 1, "assistant", "same"), (90, 1, "assistant", "same"), (None, 0, "assistant", "no id"), (None, 1, None, None), (91, 3, "assistant", "</turn>" * 5000)]
    write(talks, "conv_id long, turn long, role string, text string", "conversations")
    lines = [(b, rng.choice([1, 2, 3, 5, 8, -70, 640]), rng.choice(["kept", "swapped", "returned", None])) for b in range(300) for _ in range(rng.randrange(1, 5))]
    lines += [(1000, i, "kept") for i in range(400)] + [(1000, 2, "kept")] * 500 + [(None, 2, "kept"), (7, None, "kept")]
    lines += [(2000 + b, i, "kept") for b in range(12) for i in (701, 702, 703, 704)]
    write(lines, "sale_id long, item_id long, flag string", "sale_lines")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_on_messy_tables(spark, messy, name):
    assert rows_of(queries.QUERIES[name](spark, messy)) == sql_rows(name, messy)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, messy, tmp_path, name):
    for t in ("documents", "benchmark", "conversations", "sale_lines"):
        spark.read.parquet(f"{messy}/{t}.parquet").filter("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (name == "op12_chat_format")


# ---------------------------------------------------------------- operator 11


def plain_weights(docs, target, longest, buckets):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    ours, theirs = [(i, *grams(t)) for i, t in docs], [x for _, t in target for x in grams(t)[1]]
    s, t = Counter(x for _, _, g in ours for x in g), Counter(theirs)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    return Counter((i, n, len(g), sum(gain[x] for x in g) // len(g) if g else 0) for i, n, g in ours)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_weights_equal_plain_ones(spark, messy, longest):
    docs, target = (spark.read.parquet(f"{messy}/{t}.parquet") for t in ("documents", "benchmark"))
    got = document_weights(docs, target, longest=longest, buckets=97)
    want = plain_weights([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in target.select("item_id", "text").collect()], longest, 97)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_draw_prefers_the_target(spark):
    rng = random.Random(1)
    near = [(k, " ".join(rng.choice(["cell", "gene", "protein", "membrane"]) for _ in range(40))) for k in range(100)]
    far = [(1000 + k, " ".join(rng.choice(["goal", "match", "league", "striker"]) for _ in range(40))) for k in range(900)]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    target = spark.createDataFrame([(0, "gene protein cell membrane " * 20)], "item_id long, text string")
    rows = importance_resample(docs, target, percent=5).filter("rank is not null").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 51))
    assert sum(r["doc_id"] < 1000 for r in rows) >= 45
    by_rank = sorted(rows, key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"]) for r in by_rank] == sorted((-r["score"], r["doc_id"]) for r in rows)


def test_few_words_are_never_drawn(spark, messy):
    docs, target = (spark.read.parquet(f"{messy}/{t}.parquet") for t in ("documents", "benchmark"))
    out = importance_resample(docs, target, percent=100).collect()
    assert all((r["rank"] is None) == (r["n_words"] < 20) for r in out)
    assert len(out) == docs.count()


# ---------------------------------------------------------------- operator 12

RECORDS = [
    ({"prompt": "p", "response": "r"}, "prompt and response", [("user", "p"), ("assistant", "r")]),
    ({"system": "s", "prompt": "p", "response": "r", "id": 5, "meta": {"source": "x"}}, "prompt and response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": ""}, "prompt and completion", [("user", "p"), ("assistant", "")]),
    ({"question": "q", "context": "c", "answer": None}, "question and answer", [("user", "c\n\nq"), ("assistant", "")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": "b", "name": "n"}]}, "messages", [("user", "a"), ("tool", "b")]),
    ({"data": {"messages": [{"role": "user", "content": 7}]}}, "nested messages", [("user", "7")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"value": "c"}]}, "conversations", [("system", "s"), ("user", "a"), ("assistant", "b"), ("", "c")]),
    ({"role": "user", "text": None}, "turn", [("user", "")]),
    ({"messages": []}, None, []),
    ({"prompt": "p", "response": "r", "messages": [{"role": "a", "content": "b"}]}, None, []),
    ({"unknown": 1}, None, []),
    ([1, 2], None, []),
    ("just text", None, []),
]


def test_layouts(spark):
    rows = [(k, 0, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(len(RECORDS), 0, "{broken"), (len(RECORDS) + 1, 0, None)]
    found = canonical_turns(records_of_json(spark.createDataFrame(rows, "conv_id long, turn long, record string"))).collect()
    want = [(k, name, i, *turn) for k, (_, name, turns) in enumerate(RECORDS) for i, turn in enumerate(turns)]
    want += [(k, None, None, None, None) for k in range(len(RECORDS) + 2) if k >= len(RECORDS) or RECORDS[k][1] is None]
    assert Counter((r["conv_id"], r["layout"], r["place"], r["role"], r["text"]) for r in found) == Counter(want)


def test_record_without_turns_keeps_its_conversation(spark):
    df = records_of_json(spark.createDataFrame([(1, 0, "{}"), (2, 0, '{"prompt": "a", "response": "b"}'), (2, 1, "{}")], "conv_id long, turn long, record string"))
    out = {r["conv_id"]: r for r in chat_format(df).collect()}
    assert out[1]["formatted"] == "" and out[1]["loss"] == []
    assert out[2]["formatted"] == "<turn>user<text>a</turn>\n<turn>assistant<text>b</turn>\n"


def test_layouts_with_equal_paths_are_refused(spark):
    two = (Layout("one", (Part("=user", ("a", "b?")),)), Layout("two", (Part("=user", ("a",)),)))
    with pytest.raises(ValueError):
        canonical_turns(records_of_json(spark.createDataFrame([(1, 0, "{}")], "conv_id long, turn long, record string")), two)


def test_every_layout_has_its_own_paths():
    sets = [p for layout in LAYOUTS for p in layout.fingerprints()]
    assert len(sets) == len(set(sets))


def test_round_trip_of_control_strings(spark):
    rng = random.Random(9)
    bits = ["<", "\\", "/", "turn>", "text>", "<turn>", "</turn>", "<text>", "\n", "é", "😀", "x", "$1", "\\1"]
    turns = [(c, t, 0, rng.choice(["user", "assistant", "<text>a"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for c in range(60) for t in range(6)]
    out = format_turns(spark.createDataFrame(turns, "conv_id long, turn long, place int, role string, text string"))
    read = out.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    for r in read:
        own = [(role, text) for c, _, _, role, text in turns if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == own
        assert r["learned"] == [text for role, text in own if role == "assistant"]


def test_plain_text_is_not_escaped(spark):
    text = "if a < b && c > d: <b>x</b> \\turn> &lt;"
    rows = spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")
    assert chat_format(records_of(rows, "role", "text")).first()["formatted"] == f"<turn>user<text>{text}</turn>\n"


def test_chat_format_is_native(spark):
    plan = queries.op12_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|RDD", plan)


# ---------------------------------------------------------------- operator 13


def plain_itemsets(pairs, least, per, percent):
    baskets = {}
    for b, i in pairs:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = len(baskets)

    def support(items):
        return sum(items <= b for b in baskets.values())

    found, level = {}, [frozenset([i]) for i in sorted({i for b in baskets.values() for i in b})]
    while level:
        kept = {x: s for x in level if (s := support(x)) >= least and s * per >= n}
        found |= kept
        level = list({a | b for a, b in itertools.combinations(kept, 2) if len(a | b) == len(a) + 1})
    out = []
    for x, s in found.items():
        if any(x < y and t == s for y, t in found.items()):
            continue
        rules = [(c, found[x - {c}], found[frozenset([c])]) for c in sorted(x)] if len(x) > 1 else []
        out.append((tuple(sorted(x)), s, tuple((c, a, u) for c, a, u in rules if 100 * s >= percent * a and s * n > a * u)))
    return Counter(out)


def itemset_rows(df):
    return Counter((tuple(r["items"]), r["support"], tuple(tuple(x) for x in r["rules"])) for r in df.collect())


@pytest.mark.parametrize(("least", "per", "percent"), [(8, 2000, 10), (3, 40, 50), (1, 10, 0)])
def test_itemsets_equal_plain_ones(spark, least, per, percent):
    rng = random.Random(least)
    pairs = []
    for b in range(150):
        own = {99} | {rng.choice([1, 2, 3, 4, 5, -64, 700]) for _ in range(rng.randrange(1, 6))}
        if 2 in own:
            own |= {3, 64}  # 2 never comes without them
        pairs += [(b, i) for i in own for _ in range(rng.randrange(1, 3))]
    pairs += [(None, 1), (3, None)]
    df = spark.createDataFrame(pairs, "b long, i long")
    assert itemset_rows(frequent_itemsets(df, "b", "i", least, per, percent)) == plain_itemsets(pairs, least, per, percent)


def test_items_of_all_baskets(spark):
    pairs = [(b, i) for b in range(9) for i in (5, 6, 7)]
    out = frequent_itemsets(spark.createDataFrame(pairs, "b long, i long"), "b", "i").collect()
    assert [(r["items"], r["support"], r["rules"]) for r in out] == [([5, 6, 7], 9, [])]


def test_rule_digest(spark, messy):
    out = {r["items"]: r for r in queries.op13_frequent_itemsets(spark, messy).collect()}
    one = out["701,702,703,704"]
    assert (one["n_items"], one["support"], one["n_rules"], one["best_item"]) == (4, 12, 4, 701)
    assert one["rules_sha256"] == hashlib.sha256(b"701:12:12;702:12:12;703:12:12;704:12:12").hexdigest()
