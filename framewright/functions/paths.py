"""Path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """A path's components; arrays sort by component, so ``a/x`` comes before ``a-b/x``."""
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def parent_name(path: Column) -> Column:
    return F.try_element_at(parts(path), F.lit(-2))


def stem(path: Column) -> Column:
    """Last component without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def relative_to(path: Column, root: str) -> Column:
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30))
