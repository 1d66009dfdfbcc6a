"""Secret scans by grammar inference.

Base patterns find credentials of known form. A bounded sample of these labelled values forms a
prefix tree over character classes for each kind; states whose futures are statistically
compatible (Hoeffding bounds on their exits, recursively) are merged, which gives a probabilistic
automaton of the kind's format. Every token of six characters or more, or part of one,
that the base did not cover is scored by how much likelier it is under an automaton than under
ordinary tokens, a character; tokens that come
nearer to the labelled ones than to ordinary ones are added as spans of kind ``format``. Long
tokens of letters and digits are held against their own kind; all others against theirs, and,
being so many, must also outweigh their number by the likelihood of the whole token.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")
#: What is scored: tokens of the least length of a labelled value or more. What stands for ordinary tokens in the fit is longer.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
LONG_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

#: Classes of the characters that tokens are made of; a word's end is class 0.
CLASSES = {c: i for i, group in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-"), 1) for c in group}
END, N_CLASSES = 0, 12
_SHAPE = str.maketrans({c: chr(i) for c, i in CLASSES.items()})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(k in lower for k in KEYWORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], start, end) for start, k, end in sorted(out)]


def classes(token: str) -> list[int]:
    return [CLASSES[c] for c in token]


@dataclass
class Automaton:
    """Probabilistic automaton: each state's exits as {class: (target, probability)}."""

    exits: list[dict[int, tuple[int, float]]]

    def log_likelihood(self, symbols: Sequence[int]) -> float:
        state, total = 0, 0.0
        for c in [*symbols, END]:
            target, p = self.exits[state].get(c, (state, 1e-4))
            total += math.log(p)
            state = target
        return total


def infer(samples: Sequence[Sequence[int]], alpha: float = 0.05) -> Automaton:
    """Merge the compatible states of the samples' prefix tree, nearest to the root first."""
    step: list[dict[int, int]] = [{}]
    count: list[dict[int, int]] = [defaultdict(int)]

    for symbols in samples:
        state = 0
        for c in [*symbols, END]:
            count[state][c] += 1
            if c == END:
                break
            if c not in step[state]:
                step[state][c] = len(step)
                step.append({})
                count.append(defaultdict(int))
            state = step[state][c]

    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = sum(count[a].values()), sum(count[b].values())
            if not n or not m:
                continue
            gap = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in {*count[a], *count[b]}:
                if abs(count[a].get(c, 0) / n - count[b].get(c, 0) / m) > gap:
                    return False
                if c in step[a] and c in step[b]:
                    todo.append((step[a][c], step[b][c]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in count[b].items():
                count[a][c] += n
            for c, target in step[b].items():
                if c in step[a]:
                    if step[a][c] != target:
                        todo.append((step[a][c], target))
                else:
                    step[a][c] = target

    kept = [0]
    while True:
        waiting = [(s, c, t) for s in kept for c, t in step[s].items() if t not in kept]
        if not waiting:
            break
        s, c, t = max(waiting, key=lambda w: (sum(count[w[2]].values()), -w[2]))
        for other in kept:
            if alike(other, t):
                step[s][c] = other
                fold(other, t)
                break
        else:
            kept.append(t)
    number = {s: i for i, s in enumerate(kept)}
    exits = []
    for s in kept:
        total = sum(count[s].values()) + 0.1 * N_CLASSES
        exits.append({c: (number[step[s][c]] if c in step[s] else number[s], (n + 0.1) / total) for c, n in count[s].items()})
    return Automaton(exits)


@dataclass
class FormatModel:
    automata: list[Automaton]
    #: Log probability of a class after a class in ordinary tokens.
    ordinary: list[list[float]]
    threshold: float
    #: Least log likelihood ratio of a whole token.
    evidence: float = -math.inf
    #: What scores the tokens that are not long ones of letters and digits; None: the model itself.
    others: FormatModel | None = None

    def score(self, token: str) -> float:
        """Log likelihood ratio a character of the best automaton against ordinary tokens."""
        return self.score_classes(classes(token))

    def score_classes(self, symbols: Sequence[int]) -> float:
        plain, last = 0.0, END
        for c in [*symbols, END]:
            plain += self.ordinary[last][c]
            last = c
        return max(((a.log_likelihood(symbols) - plain) / (len(symbols) + 1) for a in self.automata), default=-math.inf)


class Scores:
    """A model's scores of tokens, None for too low ones; equal runs of classes are scored once while they are remembered."""

    def __init__(self, model: FormatModel, most: int = 1 << 17) -> None:
        self.model, self.most = model, most
        self.known: dict[str, float | None] = {}

    def __call__(self, token: str) -> float | None:
        shape = token.translate(_SHAPE)
        if shape in self.known:
            return self.known[shape]
        score: float | None = self.model.score_classes([ord(c) for c in shape])
        if score < self.model.threshold or score * (len(shape) + 1) < self.model.evidence:
            score = None
        if len(shape) <= 64:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[shape] = score
        return score


def candidates(text: str, base: Sequence[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """All tokens, and the parts of tokens, that no base span covers."""
    at = 0
    for start, end in [*((start, end) for _, start, end in base), (len(text), len(text))]:
        if start > at:
            yield from (m.span() for m in TOKEN.finditer(text, at, start))
        at = max(at, end)


def long_tokens(text: str, base: Sequence[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Long tokens of letters and digits that touch no base span: those most like secrets, for the fit."""
    for m in LONG_TOKEN.finditer(text):
        token = m[0]
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and all(m.end() <= start or end <= m.start() for _, start, end in base):
            yield m.start(), m.end()


def fit_formats(docs: DataFrame, text_col: str = "text", bound: int = 400, least_labelled: int = 20, longest: int = 256) -> FormatModel:
    """Automata from at most ``bound`` distinct values of each base kind, and as many ordinary tokens, the first by hash.

    The sample is of whole values of at most ``longest`` characters; all tokens are scored, whole.
    """
    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, str]] = {}
        total = 0
        for batch in batches:
            kinds, values, other = [], [], set()
            for text in (x.as_py() for x in batch.column("text")):
                if not text:
                    continue
                base = base_spans(text)
                for kind, start, end in base:
                    value = ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end]
                    if len(value) <= longest:
                        kinds.append(kind)
                        values.append(value)
                long = set(long_tokens(text, base))
                for start, end in long:
                    if end - start <= longest:
                        kinds.append("ordinary")
                        values.append(text[start:end])
                rest = [(start, end) for start, end in candidates(text, base) if (start, end) not in long]
                total += len(rest)
                other.update(text[start:end] for start, end in rest if end - start <= longest)
            for value in other:
                # as Spark's, so that the sample does not depend on the tasks
                h = int.from_bytes(xxhash.xxh64_digest(value.encode(), 42), signed=True)
                least[h % bound] = min(least.get(h % bound, (h, value)), (h, value))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array([0] * len(kinds), pa.int64())], schema=schema)
        # these tokens are most of the text: a task sends one a slot, and their number
        values = [value for _, value in least.values()]
        yield pa.RecordBatch.from_arrays([pa.array(["all", *["other"] * len(values)], pa.string()), pa.array(["", *values], pa.string()), pa.array([total, *[0] * len(values)], pa.int64())], schema=schema)

    seen = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, value string, n long")
    # the first value by hash of each of ``bound`` hash slots: each task sends one a slot at most
    rank = F.struct(F.xxhash64("value").alias("h"), F.col("value"))
    taken = seen.groupBy("kind", F.pmod(F.xxhash64("value"), F.lit(bound)).alias("slot")).agg(F.min(rank).alias("first"), F.sum("n").alias("n"))
    samples: dict[str, list[str]] = defaultdict(list)
    total = 0
    for r in taken.orderBy("kind", "first").collect():
        samples[r["kind"]].append(r["first"]["value"])
        total += r["n"]
    automata, rated = [], []
    for kind in KINDS:
        own = samples[kind]
        if len(own) >= least_labelled:
            automata.append(infer([classes(v) for i, v in enumerate(own) if i % 4]))
            rated += own[::4]
    model = rated_model(automata, rated, samples["ordinary"])
    model.others = rated_model(automata, rated, samples["other"])
    # chance gives one of ``total`` ordinary tokens this ratio at most
    model.others.evidence = math.log(max(total, 1))
    return model


def rated_model(automata: list[Automaton], rated: Sequence[str], ordinary_tokens: Sequence[str]) -> FormatModel:
    """The automata against a sample of ordinary tokens, with a threshold between these and labelled values."""
    pairs: Counter[tuple[int, int]] = Counter()
    for token in ordinary_tokens:
        symbols = classes(token)
        pairs.update(zip([END, *symbols], [*symbols, END], strict=True))
    totals = [sum(n for (a, _), n in pairs.items() if a == last) + N_CLASSES for last in range(N_CLASSES)]
    ordinary = [[math.log((pairs[last, c] + 1) / totals[last]) for c in range(N_CLASSES)] for last in range(N_CLASSES)]
    model = FormatModel(automata, ordinary, math.inf)
    labelled, plain = sorted(map(model.score, rated)), sorted(map(model.score, ordinary_tokens))
    if labelled:
        # halfway from the likelier ordinary tokens to the less likely labelled ones
        likely = labelled[len(labelled) // 10]
        usual = min(likely, plain[max(0, math.ceil(0.9 * len(plain)) - 1)]) if plain else 0.0
        model.threshold = max((likely + usual) / 2, 0.1)
    return model


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = 400, model: FormatModel | None = None) -> DataFrame:
    """Every row's secrets: doc_id, spans (kind, start, end, score; code points, end exclusive) by start and kind.

    Kinds assign, access and hex are the base, which no model changes; ``format`` spans are what
    the automata add, with their score. A null text is empty; too few labelled values (under 20
    of a kind) leave that kind without automaton; repeated rows come back as often; null ids stay
    null; an empty table gives no rows; other columns are not read.
    """
    model = model or fit_formats(docs, text_col, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, others = Scores(model), Scores(model.others or model)
        for batch in batches:
            out = []
            for text in (x.as_py() for x in batch.column("text")):
                base = base_spans(text) if text else []
                spans = [(start, KINDS.index(kind), end, kind, None) for kind, start, end in base]
                if text and model.automata:
                    long = set(long_tokens(text, base))
                    for start, end in candidates(text, base):
                        score = (scores if (start, end) in long else others)(text[start:end])
                        if score is not None:
                            spans.append((start, len(KINDS), end, "format", score))
                out.append([{"kind": kind, "start": start, "end": end, "score": score} for start, _, end, kind, score in sorted(spans, key=lambda s: s[:3])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, SCHEMA.field("spans").type)], schema=SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")
