"""Id-array helpers (the custom array aggregate and its normaliser)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_ids(arr) -> Column:
    """Sorted distinct ids inside one row."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.sort_array(F.array_distinct(a))


def array_union_agg(arr) -> Column:
    """Aggregate: concatenate arrays of a group, then sorted distinct; empty group -> []."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.coalesce(normalise_ids(F.flatten(F.collect_set(a))), F.array().cast("array<bigint>"))


def ids_text(arr) -> Column:
    """Comma-joined text form used in reports and comparisons."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
