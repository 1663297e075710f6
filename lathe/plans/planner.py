"""From a parsed query to a DataFrame.

The order is fixed: sources, pivot, join, ``first``, filters, row numbers, groups or distinct rows, sort, ``top``,
filters on groups, output columns.  Everything is a plain DataFrame operation, so Catalyst prunes columns, pushes filters
into scans and picks join strategies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.coerce import Val, convert, of_column, output
from lathe.functions.registry import FUNCTIONS
from lathe.operators.numbering import number_rows
from lathe.operators.pivots import pivot, spread_names
from lathe.plans.spec import Call, Expr, Lit, Ref, Spec, SpecError
from lathe.sources.files import Documents, Source, Tabular, open_source
from lathe.sources.tree import Wanted, echo, extract, unmatched_paths

DIRECTIVES = {
    "in": (1, 1), "join": (1, 2), "csvonly": (0, 1), "inheader": (0, 1), "joinheader": (0, 1), "outheader": (0, 1),
    "header": (0, 1), "case": (0, 1), "first": (1, 1), "top": (1, 1), "sort": (1, 99), "where": (1, 1),
    "distinct": (0, 1), "sync": (1, 1), "root": (1, 1), "help": (0, 0), "usage": (0, 0),
}
ONCE = {"in", "join", "first", "top", "sort", "distinct", "root"}
FACTS = {"path": 1, "depth": 1, "parent": 1, "nodename": 2, "nodenum": 2, "nodestart": 1, "nodeend": 1, "linenum": 1}
NUMERIC_FACTS = {"depth", "nodenum", "nodestart", "nodeend", "linenum"}
SCALARS = {"pivotpath": (1, 1), "rownum": (0, 0), "hidden": (1, 1), "pivot": (2, 3)}


def children(expr: Expr) -> tuple[Expr, ...]:
    return expr.args if isinstance(expr, Call) else ()


def walk(expr: Expr):
    yield expr
    for child in children(expr):
        yield from walk(child)


def is_aggregate(expr: Expr) -> bool:
    if not isinstance(expr, Call):
        return False
    if expr.op in ("min", "max"):
        return len(expr.args) == 1
    return expr.op in FUNCTIONS and FUNCTIONS[expr.op].aggregate


def has_aggregate(expr: Expr) -> bool:
    return any(is_aggregate(e) for e in walk(expr))


@dataclass
class Query:
    """A checked query: directives apart from columns, aliases resolved."""

    specs: list[Spec]
    directives: dict[str, list[Call]] = field(default_factory=dict)
    columns: list[Spec] = field(default_factory=list)
    pivot: Spec | None = None
    case: bool = False
    scopes: list[str] = field(default_factory=lambda: ["left", "right"])

    def __post_init__(self) -> None:
        for spec in self.specs:
            self._add(spec)
        seen: set[str] = set()
        for spec in self.columns:
            for name in spec.names or (spec.text,):
                if name != "..." and name in seen:
                    raise SpecError(f"Duplicate column name: {name}" if spec.names else f"Duplicate column: {name}")
                seen.add(name)
        self.aliases = {self._key(s.names[0]): s for s in self.columns if len(s.names) == 1 and s is not self.pivot}
        self.resolved = {id(s): self._resolve(s.expr, (s,)) for s in self.columns}
        for name, calls in self.directives.items():
            if name in ("where", "sort"):
                calls[:] = [Call(c.op, tuple(self._resolve(a, ()) for a in c.args)) for c in calls]
        for spec in self.columns:
            self._check(self.resolved[id(spec)])
        for calls in self.directives.values():
            for call in calls:
                for arg in call.args:
                    self._check(arg)
        self._check_mixing()

    def _key(self, name: str) -> str:
        return name if self.case else name.lower()

    def _add(self, spec: Spec) -> None:
        expr = spec.expr
        self._arity(expr, top=True)
        if isinstance(expr, Call) and expr.op in DIRECTIVES:
            if expr.op in ONCE and expr.op in self.directives:
                raise SpecError(f"Expression can only be used once: {expr.op}")
            self.directives.setdefault(expr.op, []).append(expr)
            if spec.names and expr.op in ("in", "join"):
                self.scopes[expr.op == "join"] = spec.names[0]
            if expr.op == "case":
                self.case = self.flag("case")
            return
        if isinstance(expr, Call) and expr.op == "pivot":
            if not spec.names:
                raise SpecError("Pivot function requires column names, which can include spread (...)")
            if self.pivot:
                raise SpecError("Expression can only be used once: pivot")
            for what, arg in zip(("names", "values"), expr.args):
                if has_aggregate(arg):
                    raise SpecError(f"Pivot {what} argument must not contain aggregate functions")
                if any(isinstance(e, Ref) and e.scope == self.scopes[1] for e in walk(arg)):
                    raise SpecError(f"Pivot {what} argument must not contain joined paths")
            self.pivot = spec
        elif len(spec.names) > 1 or "..." in spec.names:
            if "..." in spec.names and len(spec.names) == 1:
                raise SpecError("Column name spread (...) only valid for pivot function")
            raise SpecError("Multiple column names only valid for pivot function")
        if isinstance(expr, Call) and expr.op == "hidden" and not spec.names:
            raise SpecError("A hidden column requires a name")
        self.columns.append(spec)

    def _arity(self, expr: Expr, top: bool = False) -> None:
        if not isinstance(expr, Call):
            return
        n, op = len(expr.args), expr.op
        if op in DIRECTIVES or op in ("hidden", "pivot"):
            if not top:
                raise SpecError(f"Top-level expression only: {op}")
            least, most = DIRECTIVES.get(op) or SCALARS[op]
        elif op in FACTS:
            least, most = 1, FACTS[op]
        elif op in SCALARS:
            least, most = SCALARS[op]
        elif op in ("min", "max"):
            least, most = 1, 2
        elif op in FUNCTIONS:
            least, most = FUNCTIONS[op].least, FUNCTIONS[op].most
        else:
            raise SpecError(f"Unrecognized function: {op}")
        if not least <= n <= most:
            raise SpecError(f"Wrong number of arguments for {op}")
        if op in FACTS or op == "pivotpath":
            if not isinstance(expr.args[0], Ref):
                raise SpecError("First argument must be a path reference")
        for child in expr.args:
            self._arity(child)

    def _resolve(self, expr: Expr, within: tuple[Spec, ...]) -> Expr:
        """References to named columns give way to their expressions."""
        if isinstance(expr, Ref) and not expr.scope and not expr.attr:
            spec = self.aliases.get(self._key(expr.name))
            if spec is None or (within and spec is within[-1]):
                return expr
            if spec in within:
                raise SpecError(f"Circular column reference: {within[1].title if len(within) > 1 else expr.name}")
            found = spec.expr
            if isinstance(found, Call) and found.op == "hidden":
                found = found.args[0]
            return self._resolve(found, (*within, spec))
        if isinstance(expr, Call):
            keep = expr.op in FACTS or expr.op == "pivotpath"
            return Call(expr.op, expr.args if keep else tuple(self._resolve(a, within) for a in expr.args))
        return expr

    def _check(self, expr: Expr) -> None:
        if is_aggregate(expr) and any(has_aggregate(a) for a in children(expr)):
            raise SpecError("Aggregate functions cannot be composed")
        if isinstance(expr, Ref) and expr.scope:
            known = [s.lower() for s in self.scopes]
            if expr.scope.lower() not in known:
                raise SpecError(f"Unknown scope name: {expr.scope}")
            if expr.scope.lower() == known[1] and "join" not in self.directives:
                raise SpecError("Can't reference joined paths without a join directive")
        for child in children(expr):
            self._check(child)

    def _check_mixing(self) -> None:
        def raw(expr: Expr) -> bool:
            if is_aggregate(expr):
                return False
            if isinstance(expr, Ref) or (isinstance(expr, Call) and expr.op in FACTS):
                return True
            return any(raw(c) for c in children(expr))

        for spec in self.columns:
            expr = self.resolved[id(spec)]
            if has_aggregate(expr) and raw(expr):
                raise SpecError("Columns can't be functions of both aggregates and non-aggregates")

    def flag(self, name: str, default: bool = False) -> bool:
        calls = self.directives.get(name)
        if not calls:
            return default
        return bool(calls[-1].args[0].value) if calls[-1].args else True

    def number(self, name: str) -> int | None:
        calls = self.directives.get(name)
        if not calls:
            return None
        value = calls[-1].args[0]
        if isinstance(value, Call) and value.op == "neg":
            return 0
        if not isinstance(value, Lit):
            raise SpecError(f"{name} requires a number")
        return max(0, int(float(value.value)))

    def every_expr(self) -> list[Expr]:
        found = [self.resolved[id(s)] for s in self.columns]
        return found + [a for n in ("where", "sort") for c in self.directives.get(n, []) for a in c.args]


class Side:
    """One bound source: its DataFrame, with columns under a prefix, and the values of references and facts."""

    def __init__(self, source: Source, prefix: str, refs: list[Ref], facts: list[tuple], query: Query, ordered: bool):
        self.prefix, self.case = prefix, query.case
        self.where = "joined " if prefix == "r_" else ""
        self.vals: dict[object, Val] = {}
        self.part = F.lit(0)
        self.documents: tuple[Documents, Wanted] | None = None
        if isinstance(source, Documents):
            self._documents(source, refs, facts, query)
        else:
            self._table(source, refs, facts, ordered)

    def _documents(self, source: Documents, refs: list[Ref], facts: list[tuple], query: Query) -> None:
        paths = tuple(dict.fromkeys(r.parts for r in refs if not r.attr))
        asked = dict.fromkeys([("attr", r.parts, r.attr) for r in refs if r.attr] + facts)
        sync = tuple(c.args[0].parts for c in query.directives.get("sync", []))
        root = query.directives.get("root")
        wanted = Wanted(paths, tuple(asked), sync, int(root[0].args[0].value) if root else 0, query.case)
        self.documents = source, wanted
        rows = extract(source.docs, source.kind, wanted)
        self.df = rows.select(*(F.col(c).alias(self.prefix + c) for c in rows.columns))
        self.order, self.part = F.col(self.prefix + "ord"), F.col(self.prefix + "part")
        for k, parts in enumerate(paths):
            self.vals[parts, None] = Val(F.col(f"{self.prefix}p{k}"), "any")
        for k, (fact, parts, argument) in enumerate(asked):
            col = F.col(f"{self.prefix}f{k}")
            if fact == "attr":
                self.vals[parts, argument] = Val(col, "any")
            else:
                number = fact in NUMERIC_FACTS
                self.vals[fact, parts, argument] = Val(F.coalesce(col.try_cast("long"), F.lit(0)) if number else col, "int" if number else "str")

    def _table(self, source: Tabular, refs: list[Ref], facts: list[tuple], ordered: bool) -> None:
        df = source.df
        columns = []
        for k, ref in enumerate(refs):
            # The column as it is: conversions come after, where filters can be rewritten for the scan.
            name, (col, kind) = f"{self.prefix}c{k}", self._find(df, ref)
            columns.append(col.alias(name))
            self.vals[ref.parts, ref.attr] = of_column(F.col(name), kind)
        for fact, parts, argument in facts:
            self.vals[fact, parts, argument] = self._fact(df, fact, parts, argument)
        if ordered:
            by = [F.col(f"`{c}`") for c in source.order] or [F.monotonically_increasing_id()]
            columns.append((by[0] if len(by) == 1 else F.struct(*by)).alias(self.prefix + "ord"))
        self.df = df.select(*columns) if columns else df.select(F.lit(1).alias(self.prefix + "one"))
        self.order = F.col(self.prefix + "ord")

    def _find(self, df: DataFrame, ref: Ref) -> tuple[Column, T.DataType]:
        if ref.attr:
            return F.lit(""), T.StringType()
        parts = [p for p in ref.parts if p != "*"]
        same = (lambda a, b: a == b) if self.case else (lambda a, b: a.lower() == b.lower())
        for skip in range(len(parts)):  # outer names such as row may stand before a column
            whole = ".".join(parts[skip:])
            kind, name = df.schema, None
            for f in kind.fields:
                if same(f.name, whole):
                    return F.col(f"`{f.name}`"), f.dataType
            col = None
            for part in parts[skip:]:
                f = next((f for f in getattr(kind, "fields", []) if same(f.name, part)), None)
                if f is None:
                    break
                name = f"`{f.name}`" if name is None else f"{name}.`{f.name}`"
                kind, col = f.dataType, F.col(name)
            else:
                return col, kind
        raise SpecError(f"Path not matched in {self.where}input: {ref.name}")

    def _fact(self, df: DataFrame, fact: str, parts: tuple, argument: str) -> Val:
        self._find(df, Ref(parts))
        if fact == "nodename":
            names = [parts[-1], "row", "csv"]
            return Val(F.lit(names[int(argument or 0)] if (argument or "0").isdigit() and int(argument or 0) < 3 else ""), "str")
        if fact == "path":
            return Val(F.lit("csv.row"), "str")
        if fact == "depth":
            return Val(F.lit(2).cast("long"), "int")
        raise SpecError(f"{fact} requires a hierarchical input")


Resolver = Callable[[str], Source | DataFrame | None]


class Planner:
    """Plans one query over named sources."""

    def __init__(
        self,
        spark: SparkSession,
        specs: list[Spec],
        source: Source | DataFrame | None = None,
        tables: dict[str, Source | DataFrame] | None = None,
        partition: list[str] | None = None,
        keep_order: bool = False,
        records: bool = True,
    ):
        self.spark, self.query, self.records = spark, Query(specs), records
        self.source, self.tables = source, {} if tables is None else tables
        self.partition, self.keep_order = partition or [], keep_order
        self.pivot_names: list[str] = []
        self.sides: list[Side] = []
        self.pivot_check: tuple | None = None

    # -- sources

    def _open(self, call: Call | None, header: str) -> Source:
        found = self.source if call is None else self.tables.get(call.args[0].value)
        if found is None:
            if call is None:
                raise SpecError("No input")
            q = self.query
            found = open_source(
                self.spark, call.args[0].value, q.flag(header, True), q.flag("csvonly"), records=self.records
            )
        return found if isinstance(found, (Tabular, Documents)) else Tabular(found)

    def _side_of(self, ref: Ref) -> int:
        return int(bool(ref.scope) and ref.scope.lower() == self.query.scopes[1].lower())

    def _is_pivot_name(self, ref: Ref) -> bool:
        names = self.query.pivot.names if self.query.pivot else ()
        same = (lambda a, b: a == b) if self.query.case else (lambda a, b: a.lower() == b.lower())
        return not ref.scope and not ref.attr and any(same(ref.name, n) for n in [*names, *self.pivot_names])

    def _collect(self) -> tuple[list[list[Ref]], list[list[tuple]]]:
        refs, facts = ([], []), ([], [])

        def visit(expr: Expr) -> None:
            if isinstance(expr, Ref):
                if not self._is_pivot_name(expr):
                    refs[self._side_of(expr)].append(replace(expr, scope=None))
            elif isinstance(expr, Call) and (expr.op in FACTS or expr.op == "pivotpath"):
                facts[self._side_of(expr.args[0])].append(self._fact_key(expr))
            else:
                for child in children(expr):
                    visit(child)

        for expr in self.query.every_expr():
            visit(expr)
        for name in self.partition:
            refs[0].append(Ref((name,)))
        return [list(dict.fromkeys(r)) for r in refs], [list(dict.fromkeys(f)) for f in facts]

    @staticmethod
    def _fact_key(expr: Call) -> tuple:
        argument = ""
        if len(expr.args) > 1:
            second = expr.args[1]
            if isinstance(second, Lit):
                argument = str(int(second.value)) if second.kind in ("real", "bool") else str(second.value)
            elif isinstance(second, Ref):
                argument = second.name
        op = {"pivotpath": "path", "parent": "nodename"}.get(expr.op, expr.op)
        return op, expr.args[0].parts, "1" if expr.op == "parent" else argument

    def check_paths(self) -> None:
        """After ``plan``: an error if a path matches nothing in its documents (a pass over them)."""
        for side in self.sides:
            if side.documents:
                source, wanted = side.documents
                for parts in unmatched_paths(source.docs, source.kind, wanted):
                    raise SpecError(f"Path not matched in {side.where}input: {'.'.join(parts)}")
        if self.pivot_check:
            rows, name, part, order, named = self.pivot_check
            found = set(spread_names(rows, name, part, order, True))
            if missing := [n for n in named if n not in found]:
                raise SpecError(f"Pivot columns not found in input: {', '.join(missing)}")

    # -- expressions

    def lower(self, expr: Expr) -> Val:
        if isinstance(expr, Lit):
            return Val(F.lit(expr.value), expr.kind, literal=expr.value)
        if isinstance(expr, Ref):
            if self._is_pivot_name(expr):
                return self.pivoted[expr.name if self.query.case else expr.name.lower()]
            side = self.sides[self._side_of(expr)]
            return side.vals[expr.parts, expr.attr]
        if expr.op in FACTS:
            return self.sides[self._side_of(expr.args[0])].vals[self._fact_key(expr)]
        if expr.op == "pivotpath":
            return Val(F.col("_pivotpath"), "str")
        if expr.op == "rownum":
            return Val(F.col("_rownum"), "int")
        if expr.op == "hidden":
            return self.lower(expr.args[0])
        args = [self.lower(a) for a in expr.args]
        name = f"{expr.op}/1" if expr.op in ("min", "max") and len(args) == 1 else expr.op
        if name == "any" and self.ordered:
            return FUNCTIONS[name].build(*args, order=self.order)
        if name == "neg" and args[0].type == "any":
            args[0] = Val(convert(args[0], "real"), "real")
        return FUNCTIONS[name].build(*args)

    def _needs_order(self) -> bool:
        q = self.query
        if self.keep_order or q.pivot or "first" in q.directives:
            return True
        calls = [e for x in q.every_expr() for e in walk(x) if isinstance(e, Call)]
        if any(c.op in ("rownum", "any") for c in calls):
            return True
        if "sort" not in q.directives or not (q.flag("distinct") or any(map(has_aggregate, q.every_expr()))):
            return False
        shown = [q.resolved[id(s)] for s in q.columns]
        return any(e not in shown and not has_aggregate(e) for e, _ in self._sort_keys())

    # -- the plan

    def plan(self) -> DataFrame:
        q = self.query
        joined = q.directives.get("join")
        if "top" in q.directives and not q.columns and not self.source and "in" not in q.directives:
            raise SpecError("No input")
        self.ordered = self._needs_order()
        left = self._open((q.directives.get("in") or [None])[0], "inheader")
        refs, facts = self._collect()
        if not q.columns and not joined and not {"sort", "distinct"} & set(q.directives):
            return self._echo(left)
        if joined and not (refs[1] or facts[1]):
            raise SpecError("A join requires at least one joined path reference")
        if joined and not (refs[0] or facts[0]):
            raise SpecError("Joins require least one input path reference")
        if not any(refs) and not any(facts):
            for name, shown in (("sort", "Sorts require"), ("distinct", "Use of distinct requires")):
                if name in q.directives:
                    raise SpecError(f"{shown} least one input path reference")
        self.sides = [Side(left, "l_", refs[0], facts[0], q, self.ordered or bool(q.pivot))]
        df, self.order = self.sides[0].df, self.sides[0].order
        wheres = [c.args[0] for c in q.directives.get("where", [])]
        if q.pivot:
            df, wheres = self._pivot(df, wheres)
        if joined:
            right = self._open(joined[0], "joinheader")
            self.sides.append(Side(right, "r_", refs[1], facts[1], q, self.ordered))
            df, wheres = self._join(df, self.sides[1].df, wheres)
            if self.ordered:
                self.order = F.struct(self.order.alias("l"), F.col("r_ord").alias("r"))
        if (n := q.number("first")) is not None:
            df = df.orderBy(self.order).limit(n)
        groups = [w for w in wheres if has_aggregate(w)]
        for where in wheres:
            if not has_aggregate(where):
                df = df.filter(convert(self.lower(where), "bool"))
        calls = [e for x in q.every_expr() for e in walk(x) if isinstance(e, Call)]
        if any(c.op == "rownum" for c in calls):
            df = number_rows(df, [self.order], "_rownum")
        for c in calls:
            if c.op == "pivotpath":
                df = self._pivot_path(df, c)
                break
        return self._finish(df, groups)

    def _echo(self, source: Source) -> DataFrame:
        if isinstance(source, Documents):
            return echo(source.docs, source.kind)
        names = [c for c in source.df.columns if c != "_ord"]
        return source.df.select(F.to_xml(F.struct(*(F.col(f"`{c}`") for c in names)), {"rowTag": "row"}).alias("xml"))

    def _pivot(self, df: DataFrame, wheres: list[Expr]) -> tuple[DataFrame, list[Expr]]:
        """The pivoted rows, and the filters that still apply to them."""
        q, side = self.query, self.sides[0]
        call = q.pivot.expr
        resolved = q.resolved[id(q.pivot)]
        name, value = convert(self.lower(resolved.args[0]), "str"), convert(self.lower(resolved.args[1]), "str")
        keys = [side.vals[(n,), None].col for n in self.partition]
        part = F.struct(*keys) if keys else side.part
        plain = "first" not in q.directives and "join" not in q.directives
        if keys and plain:
            # A filter on what all of a partition's rows share may come before the pivot, and reach the scan.
            early = [w for w in wheres if self._of_partition(w)]
            wheres = [w for w in wheres if w not in early]
            for where in early:
                df = df.filter(convert(self.lower(where), "bool"))
        everywhere = len(call.args) > 2 and bool(call.args[2].value)
        named = [n for n in q.pivot.names if n != "..."]
        others = [c for c in df.columns if c not in (side.prefix + "ord", side.prefix + "part")]
        self.pivot_check = (df, name, part, side.order, named)
        found = []
        if "..." in q.pivot.names:
            rows = df
            tests = [w for w in wheres if not has_aggregate(w) and not self._late(w)]
            if tests and plain:
                # Partitions that the filters reject bring no columns.
                first = pivot(df, name, value, part, side.order, named, others)
                self.pivoted = self._pivot_vals(named)
                for where in tests:
                    first = first.filter(convert(self.lower(where), "bool"))
                rows = df.join(first.select("_part"), part.eqNullSafe(F.col("_part")), "left_semi")
            found = spread_names(rows, name, part, side.order, everywhere)
            if everywhere and rows is df and (missing := [n for n in named if n not in found]):
                raise SpecError(f"Pivot columns not found in input: {', '.join(missing)}")
        self.pivot_names = []
        for n in q.pivot.names:
            self.pivot_names += [f for f in found if f not in named] if n == "..." else [n]
        out = pivot(df, name, value, part, side.order, self.pivot_names, others)
        self.order = F.col("_ord")
        self.pivoted = self._pivot_vals(self.pivot_names)
        return out, wheres

    def _pivot_vals(self, names: list[str]) -> dict[str, Val]:
        return {(n if self.query.case else n.lower()): Val(F.col(f"v{k}"), "any") for k, n in enumerate(names)}

    def _of_partition(self, expr: Expr) -> bool:
        """Whether an expression refers to columns of the partition alone."""
        inner = [e for e in walk(expr) if isinstance(e, Ref)]
        calls = [e for e in walk(expr) if isinstance(e, Call)]
        if not inner or has_aggregate(expr) or self._late(expr) or any(c.op in FACTS for c in calls):
            return False
        return all(not self._is_pivot_name(e) and not e.attr and e.parts in [(n,) for n in self.partition] for e in inner)

    def _join(self, left: DataFrame, right: DataFrame, wheres: list[Expr]) -> tuple[DataFrame, list[Expr]]:
        q = self.query
        outer = q.directives["join"][0].args[1:]
        outer = bool(outer and outer[0].value)
        equal, rest = [], []
        for where in wheres:
            is_key = isinstance(where, Call) and where.op == "eq" and not has_aggregate(where)
            sides = [self._used(a) for a in where.args] if is_key else []
            (equal if is_key and sorted(sides, key=sorted) in ([{0}, {1}], [{1}, {0}]) else rest).append(where)
        on = [self.lower(w).col for w in equal]
        if outer:
            marked = right.withColumn("r_here", F.lit(True))
            df = left.join(marked, self._all(on), "left") if on else left.join(marked, F.lit(True), "left")
            vals = self.sides[1].vals
            for key, val in list(vals.items()):
                if val.type in ("any", "str"):
                    vals[key] = Val(F.coalesce(val.col, F.lit("")), val.type, raw=val.raw)
            return df, rest
        if "first" not in q.directives:
            both = [w for w in rest if not has_aggregate(w) and self._used(w) == {0, 1} and not self._late(w)]
            on += [convert(self.lower(w), "bool") for w in both]
            rest = [w for w in rest if w not in both]
        return (left.join(right, self._all(on), "inner") if on else left.crossJoin(right)), rest

    @staticmethod
    def _late(expr: Expr) -> bool:
        return any(isinstance(e, Call) and e.op in ("rownum", "pivotpath") for e in walk(expr))

    @staticmethod
    def _all(conditions: list[Column]) -> Column:
        out = conditions[0]
        for c in conditions[1:]:
            out = out & c
        return out

    def _used(self, expr: Expr) -> set[int]:
        if isinstance(expr, Ref):
            return {self._side_of(expr)}
        if isinstance(expr, Call) and expr.op in FACTS:
            return {self._side_of(expr.args[0])}
        return {s for c in children(expr) for s in self._used(c)}

    def _pivot_path(self, df: DataFrame, call: Call) -> DataFrame:
        names = F.split(self.sides[0].vals[self._fact_key(call)].col, r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, k, F.size(names)), "."))
        return df.withColumn("_pivotpath", F.explode(suffixes))

    def _output(self) -> list[tuple[str, Expr | str]]:
        """Result columns: title and expression, or the pivot's column."""
        q, out = self.query, []
        used = {
            (e.name if q.case else e.name.lower())
            for s in q.columns
            if s is not q.pivot
            for e in walk(q.resolved[id(s)])
            if isinstance(e, Ref) and self._is_pivot_name(e)
        }
        for spec in q.columns:
            if spec is q.pivot:
                out += [(n, Ref((n,))) for n in self.pivot_names if (n if q.case else n.lower()) not in used]
            elif not (isinstance(spec.expr, Call) and spec.expr.op == "hidden"):
                out.append((spec.title, q.resolved[id(spec)]))
        return out

    def _sort_keys(self) -> list[tuple[Expr, bool]]:
        keys = []
        for expr in self.query.directives.get("sort", [Call("sort")])[0].args:
            down = isinstance(expr, Call) and expr.op == "neg"
            keys.append((expr.args[0] if down else expr, down))
        return keys

    def _key_value(self, expr: Expr, down: bool) -> Column:
        value = self.lower(expr)
        if down and value.type == "any":
            return convert(value, "real")
        if value.type == "datetime":
            return F.struct(value.col["ts"], ~value.col["dateonly"])
        return value.col

    def _finish(self, df: DataFrame, having: list[Expr]) -> DataFrame:
        q = self.query
        out = self._output()
        keys = self._sort_keys()
        grouped = any(has_aggregate(e) for _, e in out) or bool(having) or any(has_aggregate(e) for e, _ in keys)
        top = q.number("top")
        titles = [t for t, _ in out]
        if grouped or (q.flag("distinct") and (keys or self.keep_order)):
            df = self._group(df, out, keys, having)
            order = [(F.col(f"s{k}"), down) for k, (_, down) in enumerate(keys)]
            tail = F.col("o") if self.ordered else None
        else:
            cols = [output(self.lower(e)).alias(f"x{k}") for k, (_, e) in enumerate(out)]
            extra = [self._key_value(e, down).alias(f"s{k}") for k, (e, down) in enumerate(keys)]
            tail = None
            if self.keep_order and not q.flag("distinct"):
                extra.append(self.order.alias("o"))
                tail = F.col("o")
            df = df.select(*cols, *extra)
            if q.flag("distinct"):
                df = df.distinct()
            order = [(F.col(f"s{k}"), down) for k, (_, down) in enumerate(keys)]
        if order or (self.keep_order and tail is not None):
            by = [c.desc() if down else c.asc() for c, down in order]
            df = df.orderBy(*by, *([tail] if tail is not None and self.keep_order else []))
        if top is not None:
            df = df.limit(top)
        for k in range(len(having)):
            df = df.filter(F.col(f"h{k}"))
        return df.select(*(F.col(f"x{k}").alias(t) for k, t in enumerate(titles)))

    def _group(self, df: DataFrame, out: list, keys: list, having: list[Expr]) -> DataFrame:
        by = {k: output(self.lower(e)).alias(f"x{k}") for k, (_, e) in enumerate(out) if not has_aggregate(e)}
        aggs = [output(self.lower(e)).alias(f"x{k}") for k, (_, e) in enumerate(out) if has_aggregate(e)]
        plain = {repr(out[k][1]): k for k in by}
        for k, (expr, down) in enumerate(keys):
            value = self._key_value(expr, down)
            if not has_aggregate(expr):
                same = plain.get(repr(expr))
                if same is not None:
                    # A key's own value is the same in all its rows.
                    value = F.min(value)
                else:
                    value = F.min_by(value, self.order) if self.ordered else F.min(value)
            aggs.append(value.alias(f"s{k}"))
        aggs += [convert(self.lower(w), "bool").alias(f"h{k}") for k, w in enumerate(having)]
        if self.ordered:
            aggs.append(F.min(self.order).alias("o"))
        if by:
            return df.groupBy(*by.values()).agg(*aggs) if aggs else df.select(*by.values()).distinct()
        # No rows give no group.
        return df.agg(*aggs, F.count(F.lit(1)).alias("_n")).filter("_n > 0").drop("_n")


def run(
    spark: SparkSession,
    specs: list[Spec],
    source: Source | DataFrame | None = None,
    tables: dict[str, Source | DataFrame] | None = None,
    partition: list[str] | None = None,
    keep_order: bool = False,
    records: bool = True,
) -> DataFrame:
    """The DataFrame of a query.

    ``source`` is the input without ``in[..]``; ``tables`` are inputs that ``in[..]`` and ``join[..]`` name, before
    files; ``partition`` names the columns whose values a tabular pivot's rows share (documents have their own
    partitions); ``keep_order`` sorts the result as the input unless the query sorts it; ``records`` is that of
    ``open_source``.
    """
    return Planner(spark, specs, source, tables, partition, keep_order, records).plan()
