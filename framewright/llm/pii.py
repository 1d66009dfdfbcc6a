"""Personal data by bootstrapped contextual extraction, with native functions only.

Regular expressions with checks find seed entities. The words before an entity are its lexical
patterns; tokens with digits are candidate instances. Patterns and instances form a bipartite
graph: a pattern is as sure as its different instances, an instance that is no seed as sure as
its surest pattern, and a few Spark rounds pass this back and forth. Patterns that are sure and
have many different seeds discover identifiers that no regular expression knows.

Every text is read once; all later rounds work on narrow tables of entities and candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint
from .quality_rules import let

# The patterns of the base kinds. Quantifiers are possessive where that can't
# change a match, and a run is only entered at its start (or where the last match ended), so
# that very long runs cost neither stack nor squared time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def found(kind: str, text: Column, pattern: str, hint: Column, good) -> Column:
    """Spans of a pattern's matches that are ``good``: places come from the lengths of what lies between and the matches."""

    def spans(pieces: Column) -> Column:
        def step(state: Column, match: Column) -> Column:
            start = state["at"] + F.length(F.get(pieces, state["n"]))
            end = start + F.length(match)
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), match.alias("value"))
            spans = F.when(good(match), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            return F.struct((state["n"] + 1).alias("n"), end.alias("at"), spans.alias("spans"))

        empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), no_spans().alias("spans"))
        return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), empty, step, lambda s: s["spans"])

    return F.when(hint, let(F.split(text, pattern, -1), spans)).otherwise(no_spans())


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, in that order and then by start."""
    number = text.rlike("[0-9]")
    count = lambda v: F.length(digits(v))
    return F.concat(
        found("email", text, EMAIL, text.contains("@"), lambda v: F.lit(True)),
        found("ip", text, IP, text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        found("card", text, CARD, number, lambda v: F.when(count(v).between(13, 19), F.call_function("luhn_check", digits(v))).otherwise(False)),
        found("phone", text, PHONE, text.contains("+"), lambda v: count(v).between(9, 15)),
    )


#: The last word, and the last two, of a text that ends before an entity; quotes and brackets that stand alone are passed over.
LAST = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D\"'(]*+$"
LAST_TWO = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D\"'(]*+$"


def contexts(text: Column, spans: Column, near: int = 64) -> Column:
    """(kind, start, end, value's hash, patterns): a span's patterns are the last word and the last two before it.

    They are looked for in the ``near`` characters before the span; if these hold no three
    beginnings of words, so that a pattern could be cut, in all that is before it.
    """

    def patterns(before: Column) -> Column:
        return F.filter(F.array_distinct(F.array(F.regexp_extract(before, LAST_TWO, 1), F.regexp_extract(before, LAST, 1))), lambda p: p != "")

    def one(s: Column) -> Column:
        first = F.greatest(s["start"] - near, F.lit(0))
        close = F.lower(F.substring(text, first + 1, s["start"] - first))
        whole = (first == 0) | (F.regexp_count(close, F.lit(r"[\x20\x09-\x0D][^\x20\x09-\x0D\"'(]")) >= 2)
        found = F.when(whole, patterns(close)).otherwise(patterns(F.lower(F.substring(text, F.lit(1), s["start"]))))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("value"), found.alias("patterns"))

    return F.transform(spans, one)


def scored_patterns(edges: DataFrame, rounds: int, doubt: float = 1.0) -> DataFrame:
    """(pattern, score, seeds) from edges (pattern, value, n, seed).

    A pattern's score is the mean sureness of its different instances, ``doubt`` unsure ones
    added. A seed is sure; another instance is as sure as its surest pattern among those that have
    at least two seeds, 0 without one. So a pattern that meets new identifiers keeps a high score
    if its seeds outnumber them, and new instances of such a pattern support its other patterns.
    """
    sure = edges.withColumn("sure", F.col("seed").cast("double"))
    for turn in range(rounds):
        patterns = sure.groupBy("pattern").agg((F.sum("sure") / (F.count(F.lit(1)) + doubt)).alias("score"), F.sum("seed").alias("seeds"))
        patterns = shared_checkpoint(patterns)
        if turn + 1 < rounds:
            known = edges.filter("seed = 0").join(patterns.filter("seeds >= 2"), "pattern").groupBy("value").agg(F.max("score").alias("found"))
            sure = edges.join(shared_checkpoint(known), "value", "left").withColumn("sure", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("found", F.lit(0.0)))).drop("found")
            sure = shared_checkpoint(sure)
    return patterns


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, least_score: float = 0.8, least_seeds: int = 10, least_digits: int = 4) -> DataFrame:
    """Every row's personal data: doc_id, spans (kind, start, end; code points, end exclusive).

    Kinds email, ip, card and phone are the base; kind ``context`` is what patterns add, outside
    base spans: tokens of at least ``least_digits`` digits after a pattern whose score reaches
    ``least_score`` with ``least_seeds`` different seeds. Base spans never depend on the corpus.
    A null text is empty; rows that repeat an id are judged one by one and come back as often;
    null ids stay null; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(text))
    apart = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    tokens = found("context", text, TOKEN, text.rlike("[0-9]"), lambda v: F.length(digits(v)) >= least_digits)
    rows = rows.select(
        "doc_id",
        F.xxhash64(text).alias("row"),
        F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"),
        contexts(text, F.concat(F.col("base"), F.filter(tokens, apart))).alias("seen"),
    )
    rows = shared_checkpoint(rows)
    told = rows.filter(F.size("seen") > 0).dropDuplicates(["doc_id", "row"])
    seen = told.select("doc_id", "row", F.inline("seen"))
    pairs = seen.select("value", (F.col("kind") != "context").cast("int").alias("is_seed"), F.explode("patterns").alias("pattern"))
    edges = shared_checkpoint(pairs.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("is_seed").alias("seed")))
    sure = scored_patterns(edges, rounds).filter((F.col("score") >= least_score) & (F.col("seeds") >= least_seeds)).select("pattern")
    new = seen.filter("kind = 'context'").select("doc_id", "row", "start", "end", F.explode("patterns").alias("pattern")).join(sure, "pattern", "left_semi")
    new = new.select("doc_id", "row", F.struct(F.lit("context").alias("kind"), "start", "end").alias("span")).distinct()
    new = new.groupBy(F.col("doc_id").alias("its_id"), F.col("row").alias("its_row")).agg(F.sort_array(F.collect_list("span")).alias("new"))
    out = rows.join(new, rows["doc_id"].eqNullSafe(new["its_id"]) & (rows["row"] == new["its_row"]), "left")
    return out.select("doc_id", F.concat("base", F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("spans"))
