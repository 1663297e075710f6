"""Queries as text or step by step.

    query(spark, "in[lineitem] l_returnflag n:count[l_orderkey] where[l_discount<=0.05]", tables={"lineitem": df})

    Builder(spark, df).column("l_returnflag").column("count[l_orderkey]", "n").where("l_discount<=0.05").frame()
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lathe.plans.planner import run
from lathe.plans.spec import load, split_line
from lathe.sources.files import Source


def query(
    spark: SparkSession,
    text: str | list[str],
    source: Source | DataFrame | None = None,
    tables: dict[str, Source | DataFrame] | None = None,
    **options,
) -> DataFrame:
    """The result of a query: a line of arguments, or a list of them (which may then hold blanks)."""
    args = split_line(text) if isinstance(text, str) else text
    return run(spark, load(args), source, tables, **options)


class Builder:
    """The same queries, one part at a time."""

    def __init__(self, spark: SparkSession, source: Source | DataFrame | str, **options):
        self.spark, self.options = spark, options
        self.source = None if isinstance(source, str) else source
        self.args = [f"in[{source}]"] if isinstance(source, str) else []
        self.tables: dict[str, Source | DataFrame] = {}

    def column(self, expr: str, name: str | None = None) -> Builder:
        self.args.append(f"{{{name}}}:{expr}" if name else expr)
        return self

    def hidden(self, expr: str, name: str) -> Builder:
        return self.column(f"hidden[{expr}]", name)

    def where(self, expr: str) -> Builder:
        self.args.append(f"where[{expr}]")
        return self

    def join(self, source: Source | DataFrame | str, outer: bool = False, scope: str = "right") -> Builder:
        name = source if isinstance(source, str) else "joined"
        if not isinstance(source, str):
            self.tables[name] = source
        self.args.append(f"{scope}:join[{name}{',true' if outer else ''}]")
        return self

    def pivot(self, names: str, name_expr: str, value_expr: str, everywhere: bool = False) -> Builder:
        self.args.append(f"{names}:pivot[{name_expr},{value_expr}{',true' if everywhere else ''}]")
        return self

    def sort(self, *exprs: str) -> Builder:
        self.args.append(f"sort[{','.join(exprs)}]")
        return self

    def distinct(self) -> Builder:
        self.args.append("distinct[true]")
        return self

    def first(self, n: int) -> Builder:
        self.args.append(f"first[{n}]")
        return self

    def top(self, n: int) -> Builder:
        self.args.append(f"top[{n}]")
        return self

    def frame(self) -> DataFrame:
        return query(self.spark, self.args, self.source, self.tables, **self.options)
