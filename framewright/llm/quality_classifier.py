"""Quality classifier from weak labels.

Overlapping heuristic labellers vote bad, good or not at all on every document. The counts of
vote patterns over the whole corpus (at most 3**labellers numbers) are all that
expectation-maximisation needs to estimate each labeller's accuracy and the share of bad
documents, and so a posterior for each pattern. Posterior labels then train a linear scorer on
hashed words and word shapes, on a bounded sample; the scorer judges every document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, mix, split_words, word_names

#: Frequent short words of the four languages.
STOPWORDS = """
the of and to in a is that it was for on are as with at be this have from or by not but what all were when
le la les de des du et en un une que qui est pour dans au aux par sur ce il elle
der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch
el los las y del se por con una para es al lo como más
""".split()

ABSTAIN, BAD, GOOD = 0, 1, 2

_CLASS = np.zeros((6, 256), bool)
UPPER, LOWER, SYMBOL, MARK, DIGIT, STOP = range(6)
for _row, _chars in ((UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (LOWER, "abcdefghijklmnopqrstuvwxyz"), (SYMBOL, "#*$%&|<>"), (MARK, "!"), (DIGIT, "0123456789"), (STOP, ".,;:?")):
    _CLASS[_row, [ord(c) for c in _chars]] = True


def _name(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_names(data, np.array([0]), np.array([len(data)]))[0])


class Words:
    """The words of joined documents: names, shapes and documents."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.starts, self.ends, self.doc = split_words(data, bounds)
        self.names = word_names(data, self.starts, self.ends)
        self.size = self.ends - self.starts
        self.n = np.bincount(self.doc, minlength=len(bounds) - 1)
        of = lambda row: (s := np.concatenate(([0], np.cumsum(_CLASS[row][data]))))[self.ends] - s[self.starts]
        self.upper, self.lower, self.symbols, self.digits = of(UPPER), of(LOWER), of(SYMBOL), of(DIGIT)
        tail = data[self.ends - 1] if len(self.ends) else np.empty(0, np.uint8)
        self.symbol_end, self.mark_end, self.stop_end = _CLASS[SYMBOL][tail], _CLASS[MARK][tail], _CLASS[STOP][tail]
        self.capital = (self.upper >= 2) & (self.lower == 0)
        self.bare = self.symbols == self.size
        self.again = np.zeros(len(self.names), bool)
        self.again[1:] = (self.names[1:] == self.names[:-1]) & (self.doc[1:] == self.doc[:-1])

    def rate(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=flag, minlength=len(self.n)) / np.maximum(self.n, 1)

    def distinct(self) -> np.ndarray:
        pairs = np.unique(mix(self.names + self.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        return np.bincount(self.doc[pairs], minlength=len(self.n))

    def shapes(self) -> np.ndarray:
        flags = (self.capital, self.symbol_end, self.mark_end, self.stop_end, self.bare, self.again, self.digits > 0, self.size > 24)
        return sum(f.astype(np.int64) << i for i, f in enumerate(flags))


def votes(w: Words, stopwords: np.ndarray) -> np.ndarray:
    """(labellers, documents) of votes. Documents of no words get no votes."""
    n = w.n
    between = lambda x, good, bad: np.where(x >= bad, BAD, np.where(x <= good, GOOD, ABSTAIN))
    stop = w.rate(np.isin(w.names, stopwords))
    plain = w.rate((w.upper <= 1) & (w.symbols == 0) & ~w.mark_end & ~w.again)
    long = n >= 20
    out = [
        between(w.rate(w.symbol_end), 0.02, 0.15),
        between(w.rate(w.symbols > 0), 0.03, 0.2),
        between(w.rate(w.bare), 0.01, 0.1),
        between(w.rate(w.capital), 0.05, 0.2),
        between(w.rate(w.mark_end), 0.03, 0.2),
        between(w.rate(w.again), 0.05, 0.2),
        np.where(long & (w.distinct() < 0.3 * np.minimum(n, 200)), BAD, np.where(long & (w.distinct() > 0.5 * np.minimum(n, 200)), GOOD, ABSTAIN)),
        np.where(plain < 0.75, BAD, np.where(plain > 0.93, GOOD, ABSTAIN)),
        np.where(long & (stop > 0.08) & (plain > 0.85), GOOD, ABSTAIN),
    ]
    return np.where(n > 0, np.array(out), ABSTAIN)


LABELLERS = 9


def pattern(text: Column) -> Column:
    """A document's votes as one number in base 3."""
    stop = np.array([_name(x) for x in STOPWORDS], np.uint64)
    scale = 3 ** np.arange(LABELLERS)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0, np.int64), *(scale @ votes(Words(*part), stop) for part in in_chunks(texts))]), pa.int64())

    return F.arrow_udf(run, "long")(text)


@dataclass
class LabelModel:
    """How each labeller votes on good and on bad documents, and the share of bad ones."""

    #: Probability of a vote: [bad document or not, labeller, vote]; the first row is for good ones.
    chance: np.ndarray
    bad_share: float

    def weights(self) -> np.ndarray:
        """What each labeller's each vote adds to the log odds of a bad document."""
        return np.log(self.chance[1] / self.chance[0])

    def prior(self) -> float:
        return float(np.log(self.bad_share / (1 - self.bad_share)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of a bad document, by pattern."""
        odds = self.prior() + self.weights()[np.arange(LABELLERS), cast_votes(patterns)].sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracy(self) -> np.ndarray:
        """Estimated share of right votes among each labeller's votes."""
        share = np.array([1 - self.bad_share, self.bad_share])
        right = share[0] * self.chance[0, :, GOOD] + share[1] * self.chance[1, :, BAD]
        return right / (share @ self.chance[:, :, [BAD, GOOD]].sum(2))


def cast_votes(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(LABELLERS) % 3


#: Votes to start from, by class: abstain, bad, good.
START = np.array([[0.2, 0.05, 0.75], [0.25, 0.35, 0.4]])


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, turns: int = 200) -> LabelModel:
    """Expectation-maximisation over pattern counts, with ten imagined documents of each class as prior."""
    model = LabelModel(np.repeat(START[:, None, :], LABELLERS, axis=1), 0.15)
    votes = np.eye(3)[cast_votes(patterns)]
    for _ in range(turns):
        bad = model.posterior(patterns)
        sure = np.stack([1 - bad, bad]) * counts
        chance = np.einsum("cp,pjv->cjv", sure, votes) + 10 * START[:, None, :]
        new = LabelModel(chance / chance.sum(2, keepdims=True), float(np.clip((sure[1].sum() + 1.5) / (counts.sum() + 10), 0.001, 0.5)))
        done = np.abs(new.chance - model.chance).max() < 1e-6
        model = new
        if done:
            break
    return model


def hashed(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, frequency): hashed words and hashed word shapes."""
    shape = mix((w.shapes() + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    feature = np.concatenate([w.names, shape]) % np.uint64(size)
    code, count = np.unique(np.concatenate([w.doc, w.doc]).astype(np.uint64) * np.uint64(size) + feature, return_counts=True)
    doc = (code // np.uint64(size)).astype(np.int64)
    return doc, (code % np.uint64(size)).astype(np.int64), count / np.maximum(w.n, 1)[doc]


def train(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, size: int, turns: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression to soft targets by Adam steps over all rows."""
    weight, bias, m, v = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    n = max(len(target), 1)
    for t in range(1, turns + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, weights=weight[feature] * value, minlength=n), -50, 50)))
        error = (p - target) / n if len(target) else np.zeros(n)
        slope = np.append(np.bincount(feature, weights=error[doc] * value, minlength=size) + decay * weight, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        weight, bias = weight - step[:-1], bias - step[-1]
    return weight, float(bias)


@dataclass
class QualityModel:
    labels: LabelModel
    weight: np.ndarray
    bias: float

    def score(self, text: Column) -> Column:
        """Probability that a text is bad; 0 for one without words."""
        weight, bias, size = self.weight.astype(np.float32), self.bias, len(self.weight)

        def run(texts: pa.Array) -> pa.Array:
            out = [np.empty(0)]
            for part in in_chunks(texts):
                w = Words(*part)
                shape = mix((w.shapes() + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                own = weight[(w.names % np.uint64(size)).astype(np.int64)] + weight[(shape % np.uint64(size)).astype(np.int64)]
                total = bias + np.bincount(w.doc, weights=own, minlength=len(w.n)) / np.maximum(w.n, 1)
                out.append(np.where(w.n > 0, 1 / (1 + np.exp(-np.clip(total, -50, 50))), 0.0))
            return pa.array(np.concatenate(out), pa.float64())

        return F.arrow_udf(run, "double")(text)

    def label(self, votes: Column) -> Column:
        """Posterior of a vote pattern, by the label model's weights."""
        odds = F.lit(self.labels.prior())
        for j, by_vote in enumerate(self.labels.weights()):
            cast = F.floor(votes / F.lit(3**j)) % 3
            odds = odds + F.when(cast == BAD, float(by_vote[BAD])).when(cast == GOOD, float(by_vote[GOOD])).otherwise(float(by_vote[ABSTAIN]))
        return 1 / (1 + F.exp(-odds))


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = 5000, size: int = 1 << 16) -> QualityModel:
    """Label model from all rows' vote patterns; scorer from at most ``bound`` rows, the first by a hash of their id."""
    cast = docs.select(pattern(F.col(text_col).cast("string")).alias("votes")).groupBy("votes").count().orderBy("votes").collect()
    patterns, counts = np.array([r["votes"] for r in cast], np.int64), np.array([r["count"] for r in cast], float)
    labels = fit_label_model(patterns, counts)
    key = F.col(id_col).cast("long")
    ids = docs.select(key.alias("key")).filter("key is not null").distinct().orderBy(F.xxhash64("key"), "key").limit(bound)
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "key")
    stop = np.array([_name(x) for x in STOPWORDS], np.uint64)
    scale = 3 ** np.arange(LABELLERS)
    schema = pa.schema([("key", pa.int64()), ("votes", pa.int64()), ("feature", pa.binary()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = 0
            for part in in_chunks(batch.column("text")):
                w = Words(*part)
                doc, feature, value = hashed(w, size)
                cut = np.searchsorted(doc, np.arange(len(w.n) + 1))
                cells = [[x[a:b].tobytes() for a, b in itertools.pairwise(cut)] for x in (feature.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(used, len(w.n)), pa.array(scale @ votes(w, stop)), *(pa.array(c, pa.binary()) for c in cells)], schema=schema)
                used += len(w.n)

    # repeated ids must not lift the sample over its bound; of their texts the least by what is learned from it stays
    seen = rows.mapInArrow(run, "key long, votes long, feature binary, value binary")
    cells = F.struct(F.xxhash64("votes", "feature", "value").alias("hash"), "votes", "feature", "value")
    own = seen.groupBy("key").agg(F.min(cells).alias("own")).select("key", "own.*").orderBy(F.xxhash64("key"), "key").limit(bound).collect()
    feature = [np.frombuffer(r["feature"], np.int32) for r in own]
    doc = np.repeat(np.arange(len(own)), [len(f) for f in feature])
    value = [np.frombuffer(r["value"], np.float32) for r in own]
    join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
    target = labels.posterior(np.array([r["votes"] for r in own], np.int64))
    weight, bias = train(doc, join(feature, np.int32), join(value, np.float32), target, size)
    return QualityModel(labels, weight, bias)


def quality_classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = 5000, threshold: float = 0.5, model: QualityModel | None = None) -> DataFrame:
    """Every row's votes, weak label, score and verdict.

    One row per input row: doc_id, votes (base-3 pattern), label (posterior of the label model),
    score (linear scorer), kept (score below ``threshold``). Null and blank texts get no votes, score 0 and are
    kept: emptiness is for length rules to judge. Null ids are judged but never in the training
    sample; repeated ids are judged alike and trained on once; an empty table gives no rows; other
    columns are not read.
    """
    model = model or fit_quality(docs, id_col, text_col, bound)
    text = F.col(text_col).cast("string")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), pattern(text).alias("votes"), model.score(text).alias("score"))
    return out.select("doc_id", "votes", model.label(F.col("votes")).alias("label"), "score", (F.col("score") < threshold).alias("kept"))
