"""Quality rules: text statistics and a learned decision list, with native functions only.

The list is learned by sequential covering on a bounded sample of labelled statistics: a rule
grows one threshold at a time by information gain on two thirds of the rows, is pruned back on
the other third, and is kept while it is precise there; the rows that it covers are removed and
the next rule grows. The rules become one ordered CASE expression, applied by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Statistics that conditions are about; all are plain functions of the text.
FEATURES = ("n_words", "mean_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "capital_rate", "mark_rate")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(found: Column, width: int) -> Column:
    """Words that lie in ``width``-word windows found twice or more in the array of words."""

    def covered(names: Column) -> Column:
        pairs = F.sort_array(F.transform(names, lambda name, i: F.struct(name.alias("name"), i.alias("i"))))

        def places(p: Column) -> Column:
            twice = F.filter(p, lambda x, j: (F.get(p, j - 1)["name"] == x["name"]) | (F.get(p, j + 1)["name"] == x["name"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(d: Column) -> Column:
            new = F.transform(d, lambda at, j: F.least(F.lit(width), F.coalesce(F.get(d, j + 1) - at, F.lit(width))))
            return F.aggregate(new, F.lit(0).cast("long"), lambda n, x: n + x)

        return let(let(pairs, places), total)

    def of(w: Column) -> Column:
        names = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        same = let(names, lambda n: F.when(F.size(F.array_distinct(n)) == F.size(n), F.lit(0).cast("long")).otherwise(covered(n)))
        return F.when(F.size(w) < width + 1, F.lit(0).cast("long")).otherwise(same)

    return let(found, of)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, FEATURES ...) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("t"),
        F.size(words(text)).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).alias("n_lines"),
        repeated_words(words(text), width).alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).alias("n_marks"),
    )
    rate = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))
    return rows.select(
        *["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        rate("word_chars", "n_words").alias("mean_chars"),
        rate("n_symbols", "n_words").alias("symbol_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("n_capitals", "word_chars").alias("capital_rate"),
        rate("n_marks", "n_words").alias("mark_rate"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] < self.threshold

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def grow(rows: Sequence[dict], features: Sequence[str], most: int) -> Rule:
    """Conditions added by information gain until no bad row's company is good or ``most`` are there."""
    rule: list[Condition] = []
    inside = list(rows)
    while len(rule) < most:
        bad = sum(r["bad"] for r in inside)
        if not bad or bad == len(inside):
            break
        base, best, gain = math.log2(bad / len(inside)), None, 1e-9
        for name in features:
            ordered = sorted(inside, key=lambda r: r[name])
            b = n = 0
            for i in range(len(ordered) - 1):
                n, b = n + 1, b + ordered[i]["bad"]
                low, high = ordered[i][name], ordered[i + 1][name]
                if low == high:
                    continue
                for above, k, total in ((False, b, n), (True, bad - b, len(ordered) - n)):
                    if k and (found := k * (math.log2(k / total) - base)) > gain:
                        best, gain = Condition(name, above, (low + high) / 2), found
        if best is None:
            break
        rule.append(best)
        inside = [r for r in inside if best.holds(r)]
    return tuple(rule)


def precision(rule: Rule, rows: Sequence[dict]) -> tuple[float, int]:
    """Laplace precision for bad rows, and bad rows covered."""
    inside = [r for r in rows if all(c.holds(r) for c in rule)]
    bad = sum(r["bad"] for r in inside)
    return (bad + 1) / (len(inside) + 2), bad


def prune(rule: Rule, rows: Sequence[dict]) -> Rule:
    """The rule without last conditions that don't help on rows held back."""
    return max((rule[:n] for n in range(len(rule), 0, -1)), key=lambda r: precision(r, rows)[0], default=())


def learn(rows: Sequence[dict], features: Sequence[str] = FEATURES, least_precision: float = 0.95, least_bad: int = 4, most_conditions: int = 3, most_rules: int = 12) -> list[Rule]:
    """Ordered rules that tell bad rows, from rows with ``bad`` 0 or 1 and the features."""
    growing, held = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    rules: list[Rule] = []
    while len(rules) < most_rules and any(r["bad"] for r in growing):
        rule = prune(grow(growing, features, most_conditions), held)
        if not rule:
            break
        inside = [r for r in growing + held if all(c.holds(r) for c in rule)]
        bad = sum(r["bad"] for r in inside)
        if bad < least_bad or bad < least_precision * len(inside):
            break
        rules.append(rule)
        growing, held = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (growing, held))
    return rules


def decision(rules: Sequence[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        out = F.when(every, F.lit(i)).otherwise(out)
    return out


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int) -> list[dict]:
    """Statistics of at most ``bound`` labelled rows that pass the base, the first by a hash of their id."""
    ids = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) == 0).cast("int").alias("bad"))
    ids = ids.groupBy("doc_id").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    stats = text_statistics(own.drop("bad"), "doc_id", "text").join(F.broadcast(ids), "doc_id")
    # one row an id, of repeated ids the least figures: a label's copies don't multiply, and reruns agree
    found = stats.groupBy("doc_id").agg(F.min(F.struct("bad", *FEATURES)).alias("own")).select("doc_id", "own.*").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return [r.asDict() for r in found.collect() if not (r["n_words"] < 10 or r["repeat_rate"] > 0.2)]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = 6000, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Every row's statistics, the rule that rejects it (0: none) and the verdict.

    One row per input row: doc_id, the counts and rates of text_statistics, base_failed (under
    10 words, or over 20 % of them repeated), rule, kept. Rules are learned from at most
    ``bound`` labelled rows (label 0 is bad) unless given. A null text has no words and fails the
    base; unlabelled ids, null ids and repeated rows are judged like others; without labels there
    are no rules and the base alone decides; an empty table gives no rows; other columns are not
    read.
    """
    if rules is None:
        rules = learn(labelled_statistics(docs, labels, id_col, text_col, label_col, bound))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = text_statistics(docs, id_col, text_col).withColumns({"base_failed": failed, "rule": decision(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
