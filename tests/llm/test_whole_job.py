"""What the operators must find besides what their own tests ask."""

import hashlib
import math
import random
import time
import tracemalloc
import unicodedata
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from framewright.llm import names, queries
from framewright.llm.common import in_chunks, mix, word_names
from framewright.llm.decontaminate import Items, align, decontaminate, item_blocks, ngrams, without_contaminated
from framewright.llm.names import distinct, pack_sorted, unpack_sorted
from framewright.llm.pii import base_spans, contexts, personal_data
from framewright.llm.quality_classifier import ABSTAIN, BAD, GOOD, LABELLERS, START, STOPWORDS, QualityModel, fit_label_model, fit_quality, quality_classifier
from framewright.llm.quality_rules import Condition, labelled_statistics, quality_rules
from framewright.llm.secrets import candidates, secret_scan
from framewright.llm.sharding import rendezvous_shards
from framewright.llm.simhash import grow, one_of_each, simhashes, tree_links, xxh64
from framewright.llm.substring_dedup import substring_dedup
from framewright.llm.suffix_dedup import ByteRepeats, suffix_array_dedup


@pytest.mark.parametrize("every", [5, 7, 8])
def test_decontaminate_edited_copy_beside_full_copy(spark, every):
    rng = random.Random(11)
    items = [[rng.choice([f"w{n}" for n in range(3000)]) for _ in range(45)] for _ in range(20)]
    edited = lambda w: ["new" if i % every == every - 1 else x for i, x in enumerate(w)]
    rows = [(k, " ".join(w)) for k, w in enumerate(items)] + [(100 + k, " ".join(edited(w))) for k, w in enumerate(items)]
    rows += [(200, " ".join(" ".join(w[:6]) for w in items))]  # pieces too short to be copies
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate(corpus, bench).collect()}
    assert got == {(d + k, k) for k in range(20) for d in (0, 100)}
    assert [r["doc_id"] for r in without_contaminated(corpus, bench).collect()] == [200]


def test_decontaminate_bound():
    rng = np.random.default_rng(3)
    words = [rng.integers(2, 40, rng.integers(5, 30)).astype(np.uint64) for _ in range(8)]
    grams = [ngrams(w, np.zeros(len(w), int), 3)[0] for w in words]
    order = np.argsort(np.concatenate(grams))
    items = Items([*range(8)], words, np.concatenate(grams)[order], np.repeat(np.arange(8), [len(g) for g in grams])[order], 3, 0.45)
    list(items.passages([b"a b c"]))
    names = rng.integers(2, 60, 3000).astype(np.uint64)
    begin = rng.integers(0, 2900, 400)
    stop, item = begin + rng.integers(1, 100, 400), rng.integers(0, 8, 400)
    bound = items.bound(names, item, begin, stop)
    for k, b, e, most in zip(item, begin, stop, bound, strict=True):
        assert align(words[k][None], names[b:e][None])[0][0] <= most
    assert (bound < 2 * (stop - begin)).any()


def test_one_of_each_with_repeated_ids(spark):
    a, b, c, d = ("a b c d e f", "p q r s t u v", "zz yy xx ww vv", "k l m n o i j")
    # 1: two texts, one of them twice; 2: a copy of b, and c, which only 2 and 3 have; null ids
    rows = [(1, a), (1, b), (1, b), (2, b), (2, c), (3, c), (None, a), (None, d), (None, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("x"))
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (1, b), (2, c), (None, d)])


def test_all_tokens_are_scored(spark):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    words = ["facade", "1948-1955", *("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(900))]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{prose(9)} token = {key(40)} {prose(9)}") for i in range(80)]
    rows += [(500 + i, f"{prose(9)} /long-word-{i}/of-many.example.com/path_{i}.html {prose(9)}") for i in range(80)]
    letters, short, rest = key(22), key(13), key(18)
    rows += [(900, f"{prose(9)} {letters} {prose(5)}"), (901, f"{prose(9)} {short} {prose(5)}"), (902, f"{prose(5)} {'0a' * 15}{rest} {prose(5)}")]
    out = {r["doc_id"]: r["spans"] for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    found = {i: [texts[i][s["start"] : s["end"]] for s in out[i] if s["kind"] == "format"] for i in out}
    assert found[900] == [letters] and found[901] == [short] and found[902] == [rest]
    assert not any(found[i] for i in range(80))


def test_candidates_are_what_base_spans_leave():
    text = "abcdef 123456 tiny abcXYZxyz0123456"
    assert [text[a:b] for a, b in candidates(text, [])] == ["abcdef", "123456", "abcXYZxyz0123456"]
    assert [text[a:b] for a, b in candidates(text, [("hex", 22, 25), ("hex", 19, 23)])] == ["abcdef", "123456", "xyz0123456"]


@pytest.mark.parametrize("size", [32, 33, 512, 1024, 2048, 4096, 8192])
def test_word_windows_tell_repetitive_words_apart(spark, size):
    bits = [bin(i).count("1") % 2 for i in range(size)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    text = lambda word: " ".join([*"abcdefghijkl", word])
    rows = [(1, text(one)), (2, text(two)), (3, text(one)), (4, " ".join([one, two] * 7)), (5, " ".join([two, one] * 7))]
    out = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(tuple(r) for r in out.select("doc_id", "n_words", queries.covered("spans"), F.sha2(F.col("kept").cast("binary"), 256)).collect())
    assert got == Counter(brute.word_repeats(rows, 13))


def test_distinct_names_that_share_a_half():
    a, b = np.array([7, 3, 7, 7, 3, 9], np.uint64), np.array([1, 5, 2, 1, 5, 0], np.uint64)
    first, at, count = distinct(a, b)
    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    assert len(first) == 4 and [pairs[first[k]] for k in at] == pairs
    assert [count[k] for k in at] == [pairs.count(p) for p in pairs]


def test_partners_show_repeats_below_the_length(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    shared = words(62)
    assert 365 < len(shared) < 400
    rows = [(k, f"{words(60 + k)} {shared} {words(40)}") for k in range(12)] + [(100 + k, words(150)) for k in range(12)]
    out = {r["doc_id"]: r for r in suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not out[i]["spans"] for i in out)
    assert all((out[i]["n_partners"] > 0) == (i < 100) for i in out)


def test_trees_have_depth_and_skip_edges():
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) & np.uint64((1 << 24) - 1))
    tree = np.sort(rng.integers(0, 3, len(fp)))
    levels = grow(fp, tree)
    assert len(levels) > 3 and sum(len(x.root) for x in levels) == len(fp)
    visits = []
    got = {tuple(sorted(x)) for a, b in tree_links(fp, tree, 2, visits) for x in zip(a.tolist(), b.tolist(), strict=True)}
    apart = np.bitwise_count(fp[:, None] ^ fp[None, :])
    want = {(a, b) for a, b in np.argwhere((apart <= 2) & (tree[:, None] == tree[None, :])).tolist() if a < b}
    assert got == want and want
    assert sum(visits) < 0.8 * sum((tree == t).sum() ** 2 for t in range(3))


def test_one_of_each_ignores_names_and_repeats_itself(spark):
    rows = [(1, "a b c d e f", k, {"m": k}) for k in range(6)] + [(2, "p q r s t u", 9, {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, row map<string,int>").withColumns({"none": F.lit(1), "id": F.lit(2), "_hash": F.lit(3)})
    kept = [one_of_each(df.repartition(n)) for n in (1, 5)]
    assert all(k.columns == df.columns for k in kept)
    one, two = (sorted((r["doc_id"], r["_id"], r["none"], r["_hash"]) for r in k.collect()) for k in kept)
    assert one == two and [r[0] for r in one] == [1, 2]


def test_winner_is_the_highest_score(spark):
    weights = (1.0, 2.0, 0.5, 0.0, 1.0)
    ids = [*range(300), -5, 2**62]
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in rendezvous_shards(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string"), weights=weights, new_weight=3.0).collect()}

    def score(key, shard, weight):
        drawn = int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16)
        return -weight / math.log((drawn + 0.5) / 2.0**52)

    best = lambda key, ws: max((score(key, s, w), s) for s, w in enumerate(ws) if w)[1]
    assert got == {i: (best(i, weights), best(i, (*weights, 3.0))) for i in ids}


def test_sorted_names_come_back():
    rng = np.random.default_rng(5)
    for size in (5, 8):
        key = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) >> np.uint64(64 - 8 * size))
        for some in (key, key[:1], key[:0]):
            data = pack_sorted(some, size)
            assert len(data) == size * len(some) and unpack_sorted(data, len(some), size).tolist() == some.tolist()


def test_decontaminate_short_items(spark):
    items = [(1, "paris france"), (2, "Xylograph"), (3, "a b c d e f g"), (4, " .,! "), (5, "paris")]
    rows = [(1, "Paris, France"), (2, "in paris . france it is"), (3, "paris of france"), (4, "one xylograph!"), (5, "nothing"), (6, "a b x y e f g")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    whole = {x for x in got if x[1] != 3}
    assert whole == {(1, 1, 1.0), (2, 1, 1.0), (1, 5, 1.0), (2, 5, 1.0), (3, 5, 1.0), (4, 2, 1.0)}
    assert {x[:2] for x in got if x[1] == 3} == {(6, 3)}


def plain_alignment(item, passage):
    """Smith-Waterman in plain words: 2 for a match, -1 for a changed, left out or additional word."""
    row, best = [0] * (len(passage) + 1), 0
    for a in item:
        new = [0]
        for j, b in enumerate(passage):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_decontaminate_against_all_alignments(spark):
    rng = random.Random(12)
    words = [f"w{n}" for n in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(rng.randrange(8, 40)) for _ in range(25)]

    def edited(w, share):
        out = []
        for x in w:
            roll = rng.random()
            out += [] if roll < share / 3 else [rng.choice(words)] if roll < share * 2 / 3 else [x, rng.choice(words)] if roll < share else [x]
        return out

    rows = [(k, text(rng.randrange(5, 40)) + edited(items[k % 25], 0.05 * (k // 25)) + text(rng.randrange(5, 40))) for k in range(200)]
    want = {}
    for d, w in rows:
        for k, item in enumerate(items):
            score = plain_alignment(item, w) / (2 * len(item))
            if score >= 0.45:
                want[d, k] = score
    corpus = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate(corpus, bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 100
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_long_words_make_whole_patterns(spark):
    end = "z" * 90
    rows = [(i, f"see {'q' * 40}{i % 2}{end} user{i}@mail.example.com") for i in range(4)]
    text, spans = F.col("text"), base_spans(F.col("text"))
    out = spark.createDataFrame(rows, "doc_id long, text string").select(F.inline(contexts(text, spans))).collect()
    assert sorted(tuple(r["patterns"]) for r in out) == sorted((f"see {'q' * 40}{i % 2}{end}", f"{'q' * 40}{i % 2}{end}") for i in range(4))


def test_held_out_identifiers(spark):
    """Half of the identifiers are such as no base pattern knows; patterns learned from the others find them, and no year or price."""
    rng = random.Random(13)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "zu") for b in ("ra", "to", "ne", "li", "po")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    cues = ["call me at", "reach us under", "my card is", "write to"]
    known = [lambda i: f"+1 (415) 555-{1000 + i}", lambda i: f"10.1.{i % 250}.{i % 7}", lambda i: f"user{i}@mail.example.com"]
    rows, want = [], {}
    for i in range(400):
        cue = cues[i % 4]
        if i % 5 == 0:
            own = f"ID-{rng.randrange(10**6, 10**7)}"
            want[i] = own
        else:
            own = known[i % 3](i)
        rows.append((i, f"{prose(9)} {cue} {own} {prose(6)}"))
    rows += [(1000 + i, f"{prose(8)} in the year {1900 + i % 100} {prose(4)} for {rng.randrange(1000, 9999)} dollars") for i in range(300)]
    out = {r["doc_id"]: r["spans"] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    found = {i: [texts[i][s["start"] : s["end"]] for s in spans if s["kind"] == "context"] for i, spans in out.items()}
    hit = sum(found[i] == [x] for i, x in want.items())
    false = sum(len(x) for i, x in found.items() if i not in want)
    assert hit >= 0.9 * len(want) and false == 0


def plain_label_model(patterns, counts, turns):
    """Expectation-maximisation in plain loops, from the same start and prior."""
    cast = [[p // 3**j % 3 for j in range(LABELLERS)] for p in patterns]
    chance = [[list(START[c]) for _ in range(LABELLERS)] for c in range(2)]
    share = 0.15
    for _ in range(turns):
        sure = []
        for row in cast:
            like = [(1 - share), share]
            for j, v in enumerate(row):
                like = [like[c] * chance[c][j][v] for c in range(2)]
            sure.append(like[1] / sum(like))
        new = [[[10 * START[c][v] for v in range(3)] for _ in range(LABELLERS)] for c in range(2)]
        for row, n, bad in zip(cast, counts, sure, strict=True):
            for j, v in enumerate(row):
                new[0][j][v] += n * (1 - bad)
                new[1][j][v] += n * bad
        chance = [[[x / sum(cell) for x in cell] for cell in new[c]] for c in range(2)]
        share = min(max((sum(n * b for n, b in zip(counts, sure, strict=True)) + 1.5) / (sum(counts) + 10), 0.001), 0.5)
    return chance, share


def test_label_model_against_plain_loops():
    rng = random.Random(14)
    patterns = sorted({rng.randrange(3**LABELLERS) for _ in range(80)})
    counts = [rng.randrange(1, 50) for _ in patterns]
    model = fit_label_model(np.array(patterns), np.array(counts, float), turns=12)
    chance, share = plain_label_model(patterns, counts, 12)
    assert np.allclose(model.chance, chance, atol=1e-9) and abs(model.bad_share - share) < 1e-9


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(15)
    bad = rng.random(20000) < 0.2
    right = np.linspace(0.7, 0.97, LABELLERS)
    votes = np.where(rng.random((20000, LABELLERS)) < 0.2, ABSTAIN, np.where(rng.random((20000, LABELLERS)) < right, np.where(bad[:, None], BAD, GOOD), np.where(bad[:, None], GOOD, BAD)))
    patterns, counts = np.unique(votes @ 3 ** np.arange(LABELLERS), return_counts=True)
    model = fit_label_model(patterns, counts.astype(float))
    assert np.abs(model.accuracy() - right).max() < 0.02 and abs(model.bad_share - 0.2) < 0.02


def test_scorer_against_held_out_labels(spark):
    """The scorer's plain form: logistic of the mean weight of words and shapes; on sf0.01 it must agree with held-out posterior labels."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_quality(docs, bound=400)
    rest = [r for r in quality_classifier(docs, model=model).collect() if abs(r["label"] - 0.5) > 0.4]
    right = [(r["label"] < 0.5) == r["kept"] for r in rest]
    bad = [r["kept"] for r in rest if r["label"] > 0.5]
    assert sum(right) >= 0.95 * len(right) and sum(bad) <= 0.2 * len(bad) and bad


def test_samples_of_repeated_ids_agree(spark):
    rng = random.Random(16)
    rows = [(i % 40, " ".join(rng.choice(["the", "of", "and", "word", "X!!", "**"]) for _ in range(40))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, two = (fit_quality(df.repartition(n), bound=30) for n in (1, 7))
    assert np.array_equal(one.weight, two.weight) and one.bias == two.bias
    one, two = (sorted(map(str, labelled_statistics(df.repartition(n), labels, "doc_id", "text", "quality", 30))) for n in (1, 7))
    assert one == two


SAMPLES = [
    "the quick brown fox and the lazy dog of the house is in it for a while and that was on the hill by the sea",
    "BUY NOW!! CHEAP!! CHEAP!! WATCHES *** $$$ | | | click# here#",
    "same same same same same words words words words",
    "a b c d e 1 2 3 x9 y8 . , ; : ?",
    "é à ü " * 12 + "Überlängewörterdievierundzwanzigbytesüberschreiten.",
    " ".join(f"word{i % 4}" for i in range(300)),
    "*** !!! |||",
    "",
    None,
]


def plain_words(text):
    """(word, its shape's flags) in a text, and whether a word repeats the one before."""
    out, last = [], None
    for w in brute.WORD.findall(text or ""):
        b = w.encode()
        upper, lower = sum(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in b), sum(c in b"abcdefghijklmnopqrstuvwxyz" for c in b)
        symbols, digits = sum(c in b"#*$%&|<>" for c in b), sum(c in b"0123456789" for c in b)
        out.append({"word": w, "upper": upper, "symbols": symbols, "flags": [upper >= 2 and lower == 0, b[-1] in b"#*$%&|<>", b[-1] in b"!", b[-1] in b".,;:?", symbols == len(b), w == last, digits > 0, len(b) > 24]})
        last = w
    return out


def plain_votes(text):
    found = plain_words(text)
    n = len(found)
    if not n:
        return 0
    rate = lambda f: sum(map(f, found)) / n
    between = lambda x, good, bad: BAD if x >= bad else GOOD if x <= good else ABSTAIN
    flag = lambda i: lambda w: w["flags"][i]
    distinct_words, enough = len({w["word"] for w in found}), n >= 20
    plain = rate(lambda w: w["upper"] <= 1 and w["symbols"] == 0 and not w["flags"][2] and not w["flags"][5])
    stop = rate(lambda w: w["word"] in STOPWORDS)
    votes = [
        between(rate(flag(1)), 0.02, 0.15),
        between(rate(lambda w: w["symbols"] > 0), 0.03, 0.2),
        between(rate(flag(4)), 0.01, 0.1),
        between(rate(flag(0)), 0.05, 0.2),
        between(rate(flag(2)), 0.03, 0.2),
        between(rate(flag(5)), 0.05, 0.2),
        BAD if enough and distinct_words < 0.3 * min(n, 200) else GOOD if enough and distinct_words > 0.5 * min(n, 200) else ABSTAIN,
        BAD if plain < 0.75 else GOOD if plain > 0.93 else ABSTAIN,
        GOOD if enough and stop > 0.08 and plain > 0.85 else ABSTAIN,
    ]
    return sum(v * 3**j for j, v in enumerate(votes))


def test_classifier_against_plain_votes_and_scores(spark):
    size = 1 << 10
    rng = np.random.default_rng(17)
    labels = fit_label_model(np.array([0, 5, 700]), np.array([3.0, 9.0, 4.0]))
    model = QualityModel(labels, rng.normal(size=size), 0.3)
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_classifier(df, model=model).collect()}

    def cell(key):
        return float(np.float32(model.weight[int(key) % size]))

    for i, text in enumerate(SAMPLES):
        found = plain_words(text)
        assert got[i]["votes"] == plain_votes(text), text
        total = 0.0
        for w in found:
            data = np.frombuffer(w["word"].encode(), np.uint8)
            shape = sum(f << k for k, f in enumerate(w["flags"]))
            total += cell(word_names(data, np.array([0]), np.array([len(data)]))[0]) + cell(mix(np.array([shape + 1], np.uint64) * np.uint64(0xD1342543DE82EF95))[0])
        want = 1 / (1 + math.exp(-(model.bias + total / len(found)))) if found else 0.0
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["kept"] == (got[i]["score"] < 0.5)
        odds = labels.prior() + sum(labels.weights()[j, got[i]["votes"] // 3**j % 3] for j in range(LABELLERS))
        assert got[i]["label"] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_rules_against_plain_statistics(spark):
    rng = random.Random(18)
    texts = SAMPLES + [" ".join(rng.choice(["one", "two!", "Three", "#four", "five"]) for _ in range(rng.randrange(5, 60))) + "\nline\nline" for _ in range(60)]
    rules = [(Condition("symbol_rate", True, 0.25), Condition("n_words", False, 40.0)), (Condition("capital_rate", True, 0.06),), (Condition("dup_line_rate", True, 0.3), Condition("mark_rate", True, 0.2))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules(df, labels, rules=rules).collect()}
    for i, text in enumerate(texts):
        n, chars, symbols, dup, repeat = brute.statistics(text)
        lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
        capitals, marks = sum(unicodedata.category(c) == "Lu" for c in text or ""), (text or "").count("!")
        rate = lambda a, b: a / b if b else 0.0
        row = {"n_words": n, "mean_chars": rate(chars, n), "symbol_rate": rate(symbols, n), "dup_line_rate": rate(dup, len(lines)), "repeat_rate": rate(repeat, n), "capital_rate": rate(capitals, chars), "mark_rate": rate(marks, n)}
        rule = next((k for k, r in enumerate(rules, 1) if all((row[c.feature] >= c.threshold) == c.above for c in r)), 0)
        failed = n < 10 or 100 * repeat > 20 * n
        assert (got[i]["rule"], got[i]["base_failed"], got[i]["kept"]) == (rule, failed, not failed and not rule)
    assert {r["rule"] for r in got.values()} == {0, 1, 2, 3}


def test_hashes_and_fingerprints_against_plain_ones():
    rng = np.random.default_rng(19)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 3800, 1500)
    ends = starts + rng.integers(0, 200, 1500)
    assert xxh64(data, starts, ends, 42).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]
    assert len(xxh64(data, starts[:0], ends[:0], 1)) == 0
    texts = [*SAMPLES, " \t\n", "One", "one TWO", "A b c d", "a b c d e", "É é\x1f Z\nz  q\x0b r", "x" * 100 + " y", "\n".join(SAMPLES[:6]) * 40, "end"]
    for width in (1, 4, 5):
        got = np.concatenate([simhashes(*part, width) for part in in_chunks(pa.array(texts))])
        assert got.tolist() == [brute.fingerprint(t, width) for t in texts]


def test_common_seeds_are_bounded_and_lose_nothing(spark):
    """A seed that thousands of items share: a text of nothing else is cheap, and a copy that kept no other seed is found."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join([*rng.choices(vocabulary, k=20), "of the following", *rng.choices(vocabulary, k=20)])) for k in range(2000)]
    words = items[7][1].split()
    broken = [w if i in (20, 21, 22) or i % 3 else "zz" for i, w in enumerate(words)]  # every third word changed, but for the shared seed
    docs = [(1, "of the following " * 5000), (2, "start " + " ".join(broken) + " end"), (3, " ".join(rng.choices(vocabulary, k=500)) + " of the following"), (4, items[9][1])]
    started = time.time()
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(2, 7), (4, 9)}
    assert time.time() - started < 60


@pytest.mark.parametrize("rare", [0, 8, 10**9])
def test_how_rare_a_seed_is_changes_no_pair(spark, monkeypatch, rare):
    rng = random.Random(22)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(40)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=40) + [w if rng.random() > 0.25 else "zz" for w in items[k % 40][1].split()])) for k in range(80)]
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    (block,) = item_blocks(frames[1], "item_id", "text", 3, 0.45, 1 << 24)
    monkeypatch.setattr("framewright.llm.decontaminate.RARE", rare)
    monkeypatch.setattr("framewright.llm.decontaminate.PAIR_ROWS", 500)
    found = {(t, k): round(score, 9) for t, k, score, *_ in block.matches([d.encode() for _, d in docs])}
    monkeypatch.undo()
    (block,) = item_blocks(frames[1], "item_id", "text", 3, 0.45, 1 << 24)
    assert found == {(t, k): round(score, 9) for t, k, score, *_ in block.matches([d.encode() for _, d in docs])}
    assert sum(t % 40 == k for t, k in found) >= 70


def test_windows_are_sorted_in_parts_within_bounded_memory():
    """A home whose windows all repeat: what numpy holds at once stays below 20 times its text."""
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, 20_000).astype(np.uint8)) for _ in range(50)]
    texts += [t + b" x" for t in texts]
    home = names.Home(pa.table({"home": pa.array([0] * 100, pa.int32()), "doc_id": list(range(100)), "data": pa.array(texts, pa.binary())}))
    job = ByteRepeats(400)
    mask = np.concatenate([np.arange(len(t)) <= len(t) - 400 for t in home.texts])
    tracemalloc.start()
    sent = names.send_windows(job, home, mask, 40, b"told")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # one chunk of bytes is worked on at a time whatever the home's size
    assert peak < 20 * len(mask) + 64 * names.CHUNK
    assert sorted(sent.column("bucket").to_pylist()) == list(range(40)) and [x for x in sent.column("extra").to_pylist() if x] == [b"told"]
    settled = names.resolver(names.WINDOW, ("u2",))(pa.concat_tables([sent, sent.set_column(1, "home", pa.array([1] * len(sent), pa.int32()))]))
    own = settled.filter(pa.array([h == 0 for h in settled.column("home").to_pylist()]))
    assert names.repeated_windows(job, home, mask, 40, own).all()
    alone = names.resolver(names.WINDOW, ("u2",))(sent)
    seen = names.repeated_windows(job, home, mask, 40, alone)
    assert seen.sum() == 2 * 50 * (20_000 - 399) and not seen.all()
