"""Transcript functions: normalisation and edit distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column, strip: bool = False) -> Column:
    """Lower case; white space to spaces; runs of spaces to one; punctuation out. In this order."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"\s", " "), " +", " ")
    out = F.regexp_replace(out, r"\p{P}", "")
    return F.trim(out) if strip else out


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def char_edits(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis).cast("long")


#: The first character that stands for a word, and how many there are before the surrogates.
_FIRST = 0x4E00
_LOW = 0xD800 - _FIRST


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance of two word arrays, with native functions.

    Each distinct word of the pair becomes one character from U+4E00 on, beyond U+D7FF one from
    U+10000 on, and the character distance of the two strings is the word distance. A pair of more
    distinct words than there are such characters (1,083,904) raises an error.
    """
    names = F.array_distinct(F.concat(reference, hypothesis))

    def written(words: Column, known: Column) -> Column:
        at = lambda w: F.array_position(known, w).cast("long")
        code = lambda k: F.lpad(F.hex(k + F.when(k <= _LOW, _FIRST - 1).otherwise(0x10000 - _LOW - 1)), 8, "0")
        return F.decode(F.unhex(F.array_join(F.transform(F.transform(words, at), code), "")), "UTF-32")

    def distance(known: Column) -> Column:
        edits = F.levenshtein(F.coalesce(written(reference, known), F.lit("")), F.coalesce(written(hypothesis, known), F.lit("")))
        return F.when(F.size(known) > _LOW + 0x100000, F.raise_error(F.lit("too many distinct words in a pair")).cast("int")).otherwise(edits)

    pair = F.transform(F.array(names), distance)
    return pair[0].cast("long")
