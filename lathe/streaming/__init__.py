"""Queries over streams.

Queries without blocking parts (columns, filters, joins with a table) run on any stream as they are.  Groups run in
complete or update mode; sorted groups in complete mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lathe.plans.planner import Planner, has_aggregate
from lathe.plans.spec import SpecError, load, split_line

#: Directives that need all rows, or their order.
BOUNDED = ("first", "top")


def is_blocking(planner: Planner) -> bool:
    q = planner.query
    return bool(q.pivot or "sort" in q.directives or q.flag("distinct") or any(map(has_aggregate, q.every_expr())))


def stream_query(
    spark: SparkSession, text: str | list[str], source: DataFrame, tables: dict[str, DataFrame] | None = None
) -> tuple[DataFrame, str]:
    """The streaming DataFrame of a query over a streaming ``source``, and the output mode it needs."""
    planner = Planner(spark, load(split_line(text) if isinstance(text, str) else text), source, tables)
    q = planner.query
    if not source.isStreaming:
        raise SpecError("The source is no stream")
    for name in BOUNDED:
        if name in q.directives:
            raise SpecError(f"{name} needs an input that ends")
    if q.pivot or planner._needs_order():
        raise SpecError("Queries that depend on the order of rows need an input that ends")
    if "sort" in q.directives and not any(map(has_aggregate, q.every_expr())):
        raise SpecError("Only grouped results of a stream can be sorted")
    return planner.plan(), "complete" if is_blocking(planner) else "append"
