"""Chat records of differing layouts as one text a conversation, by fingerprints of their schemas.

A record is a VARIANT. The nested paths it has, of those that any layout speaks of, are hashed;
the hash selects a layout, which says declaratively where a record's turns are. All of it, like
the template below, is made of native column expressions.

Template: ``<turn>role<text>text</turn>`` and a line feed for each turn. Where a role or text
holds a control string itself, with any number of backslashes after its ``<``, one more backslash
is put there; reading takes it off again. All other text stays as it is.

A null role or text is empty. Turns are in order of turn number, place in the record, role and
text, nulls first; equal turns are repeated. Rows of a null conversation id make one conversation.
A record that fits no layout has no turns, and layout null. An empty table gives no rows; columns
beyond those named are never read. A conversation is one string of at most 2 GB, as its digests
are over the whole of it; everything before that string works on single turns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
TURN, TEXT, END = "<turn>", "<text>", "</turn>"

CONTROL = r"(turn>|text>|/turn>)"


@dataclass(frozen=True)
class Part:
    """A turn, or one for each element of the list ``each``: paths of its texts, joined by blank lines.

    ``role`` names a path, or after ``=`` the role itself. ``?`` ends paths that may be missing.
    """

    role: str
    texts: tuple[str, ...]
    each: str | None = None

    def paths(self) -> list[str]:
        own = [p for p in (self.role, *self.texts) if not p.startswith("=")]
        return [f"{self.each}[].{p}" if self.each else p for p in own]


@dataclass(frozen=True)
class Layout:
    name: str
    parts: tuple[Part, ...]
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> list[str]:
        """The path sets that have this layout: its needed paths with any of those that may be missing."""
        paths = [p for part in self.parts for p in part.paths()]
        free = [p.rstrip("?") for p in paths if p.endswith("?")]
        needed = [p for p in paths if not p.endswith("?")]
        return [joined([*needed, *some]) for n in range(len(free) + 1) for some in combinations(free, n)]


def joined(paths: Sequence[str]) -> str:
    return "\n".join(sorted(set(paths)))


# Field names of common chat and instruction data sets.
LAYOUTS = (
    Layout("turn", (Part("role", ("text",)),)),
    Layout("prompt and response", (Part("=system", ("system?",)), Part("=user", ("prompt",)), Part("=assistant", ("response",)))),
    Layout("prompt and completion", (Part("=system", ("system?",)), Part("=user", ("prompt",)), Part("=assistant", ("completion",)))),
    Layout("question and answer", (Part("=user", ("context?", "question")), Part("=assistant", ("answer",)))),
    Layout("instruction", (Part("=system", ("system?",)), Part("=user", ("instruction", "input?")), Part("=assistant", ("output",)))),
    Layout("messages", (Part("role", ("content",), "messages"),)),
    Layout("nested messages", (Part("role", ("content",), "data.messages"),)),
    Layout("conversations", (Part("=system", ("system?",)), Part("from", ("value",), "conversations")), (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))),
)


def at(record: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def has(record: Column, path: str) -> Column:
    """Whether the record has the path, be its value null; a path through a list is that of any element."""
    outer, through, inner = path.partition("[].")
    if not through:
        return at(record, path).isNotNull()
    return F.exists(F.coalesce(at(record, outer, "array<variant>"), F.array().cast("array<variant>")), lambda x: at(x, inner).isNotNull())


def fingerprint(record: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the record's nested paths, of those that a layout speaks of."""
    known = sorted({p.rstrip("?") for layout in layouts for part in layout.parts for p in part.paths()})
    return F.xxhash64(F.concat_ws("\n", *[F.when(has(record, p), F.lit(p)) for p in known]))


def turns_of(record: Column, layout: Layout) -> Column:
    """Array of (role, text) of a record of the layout; a part none of whose texts is there is no turn."""

    def value(source: Column, path: str) -> Column:
        return F.lit(path[1:]) if path.startswith("=") else at(source, path.rstrip("?"), "string")

    def turn(source: Column, part: Part) -> Column:
        role = value(source, part.role)
        for old, new in layout.roles:
            role = F.when(role == old, F.lit(new)).otherwise(role)
        texts = [value(source, p) for p in part.texts]
        body = texts[0] if len(texts) == 1 else F.concat_ws("\n\n", *[F.when(t != "", t) for t in texts])
        there = F.lit(False)
        for p in part.texts:
            there = F.lit(True) if not p.endswith("?") else there | has(source, p.rstrip("?"))
        return F.when(there, F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(body, F.lit("")).alias("text")))

    def turns(part: Part) -> Column:
        if part.each is None:
            return F.array(turn(record, part))
        return F.transform(at(record, part.each, "array<variant>"), lambda x: turn(x, part))

    return F.filter(F.concat(*map(turns, layout.parts)), lambda x: x.isNotNull())


def canonical_turns(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, layout, place, role, text) from (conv_id, turn, record); place is from 0 in the record.

    A record without turns is one row whose place is null.
    """
    seen: dict[str, str] = {}
    for layout in layouts:
        for paths in layout.fingerprints():
            if seen.setdefault(paths, layout.name) != layout.name:
                raise ValueError(f"layouts {seen[paths]} and {layout.name} have the same paths")
    marked = records.select("conv_id", "turn", "record", fingerprint(F.col("record"), layouts).alias("mark"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        fits = F.col("mark").isin(*[F.xxhash64(F.lit(paths)) for paths in layout.fingerprints()])
        name, turns = F.when(fits, F.lit(layout.name)).otherwise(name), F.when(fits, turns_of(F.col("record"), layout)).otherwise(turns)
    found = marked.select("conv_id", "turn", name.alias("layout"), F.posexplode_outer(turns).alias("place", "found"))
    return found.select("conv_id", "turn", "layout", "place", "found.role", "found.text")


def escaped(text: Column) -> Column:
    """Text with one more backslash after the ``<`` of what is, or looks escaped like, a control string."""
    return F.regexp_replace(text, r"<(\\*)" + CONTROL, r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)" + CONTROL, "<$1$2")


def format_turns(turns: DataFrame, learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss) of every conversation of (conv_id, turn, place, role, text).

    ``loss`` is the mask: bounds, in bytes of UTF-8, of the texts of the ``learned`` roles.
    Offsets are running sums over single turns, so the work is linear in a conversation's length.
    """
    plain = turns.select("conv_id", "turn", "place", escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role").isin(*learned), F.lit(False)).alias("learned"))
    head = F.concat(F.lit(TURN), F.col("role"), F.lit(TEXT))
    whole = F.when(F.col("place").isNotNull(), F.concat(head, F.col("body"), F.lit(END + "\n"))).otherwise(F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "place", "role", "body")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = plain.withColumn("whole", whole).select("conv_id", "whole", "learned", F.row_number().over(order).alias("nth"), F.sum(F.octet_length("whole").cast("long")).over(upto).alias("upto"), F.octet_length("body").alias("size"))
    end = F.col("upto") - len(END + "\n")
    span = F.when(F.col("learned"), F.struct((end - F.col("size")).cast("int").alias("start"), end.cast("int").alias("end")))
    pieces = F.sort_array(F.collect_list(F.struct("nth", "whole", span.alias("span"))))
    rows = placed.groupBy("conv_id").agg(pieces.alias("pieces"))
    loss = F.filter(F.transform("pieces", lambda p: p["span"]), lambda s: s.isNotNull())
    return rows.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["whole"]), "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, END + "\n"), lambda p: p != "")
    halves = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), TEXT))
    return F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """Array of the texts under the mask."""
    once = F.array(formatted.cast("binary"))  # bound to a name, so that it is not cast again for each span
    found = F.transform(once, lambda b: F.transform(loss, lambda s: unescaped(F.decode(F.substring(b, s["start"] + 1, s["end"] - s["start"]), "utf-8"))))
    return found[0]


def chat_format(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, formatted, loss) of every conversation of (conv_id, turn, record)."""
    return format_turns(canonical_turns(records, layouts))


def records_of(rows: DataFrame, *fields: str) -> DataFrame:
    """(conv_id, turn, record) of typed rows (conv_id, turn, fields)."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.to_variant_object(F.struct(*fields)).alias("record"))


def records_of_json(rows: DataFrame, column: str = "record") -> DataFrame:
    """(conv_id, turn, record) of rows whose record is JSON text; text that is no JSON fits no layout."""
    return rows.select("conv_id", "turn", F.try_parse_json(column).alias("record"))
