"""Pivot of name and value rows into columns, one row for each partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.plans.spec import SpecError

#: Different names that a spread may find.
MOST_COLUMNS = 10_000


def spread_names(rows: DataFrame, name: Column, part: Column, order: Column, everywhere: bool) -> list[str]:
    """Names in order of first appearance, of all partitions or of the first."""
    rows = rows.select(name.alias("name"), part.alias("part"), order.alias("ord"))
    if not everywhere:
        first = rows.agg(F.min_by("part", "ord").alias("first"))
        # One row is joined.
        rows = rows.join(F.broadcast(first), F.col("part").eqNullSafe(F.col("first")))
    found = rows.groupBy("name").agg(F.min("ord").alias("ord")).orderBy("ord").limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise SpecError(f"A pivot has more than {MOST_COLUMNS} columns")
    return [r["name"] for r in found]


def pivot(
    rows: DataFrame, name: Column, value: Column, part: Column, order: Column, names: list[str], others: list[str]
) -> DataFrame:
    """A row for each partition: v0.. (the last value of each name), the last row's ``others``, ``_part`` and ``_ord``."""
    last = [F.max_by(F.col(c), order).alias(c) for c in others]
    values = [
        F.coalesce(F.max_by(value, F.when(name == n, order)), F.lit("")).alias(f"v{k}") for k, n in enumerate(names)
    ]
    return rows.groupBy(part.alias("_part")).agg(*values, *last, F.min(order).alias("_ord"))
