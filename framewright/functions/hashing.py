"""Seeded, engine-independent orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_of(text: Column) -> Column:
    """SHA-256 of a name modulo 2**32: its last eight hex digits."""
    return F.conv(F.right(F.sha2(text.cast("binary"), 256), F.lit(8)), 16, 10).cast("long")


def shuffled(seed: str, key: Column) -> Column:
    """Sort key of a seeded random order; the same in any engine with MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
