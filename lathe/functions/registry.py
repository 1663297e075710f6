"""Scalar and aggregate functions: arity, result type, and the column each one builds.

``register`` adds one of your own (from a built-in expression, ``F.udf`` or ``F.pandas_udf``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.functions.coerce import Val, common, convert, trimmed

NAN, INF = float("nan"), float("inf")


@dataclass(frozen=True)
class Function:
    least: int
    most: int
    build: Callable[..., Val]
    aggregate: bool = False


FUNCTIONS: dict[str, Function] = {}


def register(name: str, least: int, most: int | None = None, aggregate: bool = False):
    """Decorator: a function of values, under a name (in lower case)."""

    def add(build):
        FUNCTIONS[name.lower()] = Function(least, least if most is None else most, build, aggregate)
        return build

    return add


def real(v: Val) -> Column:
    return convert(v, "real")


def whole(v: Val) -> Column:
    return convert(v, "int")


def text(v: Val) -> Column:
    return convert(v, "str")


def truth(v: Val) -> Column:
    return convert(v, "bool")


# -- arithmetic


def _arithmetic(name: str, ints: Callable, reals: Callable) -> None:
    @register(name, 2)
    def build(a: Val, b: Val) -> Val:
        if a.type == b.type == "int":
            return Val(ints(a.col, b.col), "int")
        return Val(reals(real(a), real(b)), "real")


def ieee_divide(a: Column, b: Column) -> Column:
    """Division whose quotient by zero is nan."""
    return F.when(b == 0, F.lit(NAN)).otherwise(F.try_divide(a, b))


_arithmetic("add", F.try_add, lambda a, b: a + b)
_arithmetic("sub", F.try_subtract, lambda a, b: a - b)
_arithmetic("mul", F.try_multiply, lambda a, b: a * b)
_arithmetic("div", lambda a, b: F.when(b == 0, F.lit(0)).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0)))).cast("long"), ieee_divide)


@register("mod", 2)
def _mod(a: Val, b: Val) -> Val:
    return Val(F.coalesce(F.try_mod(whole(a), whole(b)), F.lit(-1)).cast("long"), "int")


@register("neg", 1)
def _neg(a: Val) -> Val:
    if a.type == "str":
        return a
    return Val(-a.col, "int") if a.type == "int" else Val(-real(a), "real")


@register("abs", 1)
def _abs(a: Val) -> Val:
    return Val(F.abs(a.col), "int") if a.type == "int" else Val(F.abs(real(a)), "real")


@register("floor", 1)
def _floor(a: Val) -> Val:
    return a if a.type == "int" else Val(F.floor(real(a)).cast("long"), "int")


@register("ceil", 1)
def _ceil(a: Val) -> Val:
    return a if a.type == "int" else Val(F.ceil(real(a)).cast("long"), "int")


@register("round", 1, 2)
def _round(a: Val, places: Val | None = None) -> Val:
    if places is None:
        return Val(F.round(real(a)), "real")
    scale = F.pow(F.lit(10.0), whole(places).cast("double"))
    scaled = real(a) * scale
    return Val(F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / scale, "real")


@register("sqrt", 1)
def _sqrt(a: Val) -> Val:
    return Val(F.sqrt(real(a)), "real")


@register("pow", 2)
def _pow(a: Val, b: Val) -> Val:
    return Val(F.pow(real(a), real(b)), "real")


def _ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.ln(x))


@register("log", 1, 2)
def _log(a: Val, base: Val | None = None) -> Val:
    value = _ln(real(a))
    return Val(value if base is None else ieee_divide(value, _ln(real(base))), "real")


@register("exp", 1)
def _exp(a: Val) -> Val:
    return Val(F.exp(real(a)), "real")


def _extreme(name: str, pick: Callable, aggregate: Callable) -> None:
    @register(name, 2)
    def two(a: Val, b: Val) -> Val:
        kind = common(a.type, b.type)
        return Val(pick(convert(a, kind), convert(b, kind)), kind)

    @register(f"{name}/1", 1, aggregate=True)
    def one(a: Val) -> Val:
        return Val(aggregate(a.col), "int") if a.type == "int" else Val(aggregate(real(a)), "real")


_extreme("min", F.least, F.min)
_extreme("max", F.greatest, F.max)

# -- comparison and logic


def _comparison(name: str, test: Callable, on_error: bool) -> None:
    @register(name, 2)
    def build(a: Val, b: Val) -> Val:
        kind = common(a.type, b.type)
        number = b.literal if isinstance(b.literal, float) and not math.isnan(b.literal) else None
        if a.type == "int" and number is not None and number == int(number) and abs(number) < 2**53:
            return Val(test(a.col, F.lit(int(number))), "bool")
        x, y = convert(a, kind), convert(b, kind)
        if kind == "real":
            if number is not None:
                # nan is Spark's largest number, so it compares as greater here too; scans can use this form.
                return Val(test(x, y), "bool")
            # A comparison with nan comes out as "greater".
            return Val(F.when(F.isnan(x) | F.isnan(y), F.lit(on_error)).otherwise(test(x, y)), "bool")
        if kind == "datetime":
            # One without a time of day comes first on its day; what is no datetime compares as greater.
            key = lambda d: F.struct(d["ts"], ~d["dateonly"])
            own = a.raw if a.type == "datetime" and a.raw is not None else x["ts"]
            nulls = own.isNull() | y["ts"].isNull()
            # In this form the optimiser keeps the test apart from the one on timestamps below.
            whole = F.coalesce(F.when(~nulls, test(key(x), key(y))), F.lit(on_error))
            # The timestamps alone say nearly as much, in a form that scans can use.
            wider = {"lt": "le", "gt": "ge"}.get(name, name)
            part = {"le": x["ts"] <= y["ts"], "ge": x["ts"] >= y["ts"], "eq": x["ts"] == y["ts"]}.get(wider)
            if part is None or b.type != "datetime":
                return Val(whole, "bool")
            return Val(whole & ((part | nulls) if on_error else (part & ~nulls)), "bool")
        if name == "eq" and kind == "str" and isinstance(b.literal, str) and b.literal and a.type == "any" and a.raw is not None:
            return Val(a.raw.eqNullSafe(F.lit(b.literal)), "bool")
        return Val(test(x, y), "bool")


_comparison("eq", lambda a, b: a == b, False)
_comparison("ne", lambda a, b: a != b, True)
_comparison("le", lambda a, b: a <= b, False)
_comparison("ge", lambda a, b: a >= b, True)
_comparison("lt", lambda a, b: a < b, False)
_comparison("gt", lambda a, b: a > b, True)


@register("and", 2)
def _and(a: Val, b: Val) -> Val:
    return Val(truth(a) & truth(b), "bool")


@register("or", 2)
def _or(a: Val, b: Val) -> Val:
    return Val(truth(a) | truth(b), "bool")


@register("xor", 2)
def _xor(a: Val, b: Val) -> Val:
    return Val(truth(a) != truth(b), "bool")


@register("not", 1)
def _not(a: Val) -> Val:
    return Val(~truth(a), "bool")


@register("if", 3)
def _if(test: Val, a: Val, b: Val) -> Val:
    kind = common(a.type, b.type)
    return Val(F.when(truth(test), convert(a, kind)).otherwise(convert(b, kind)), kind)


# -- text


@register("concat", 2)
def _concat(a: Val, b: Val) -> Val:
    return Val(F.concat(text(a), text(b)), "str")


@register("len", 1)
def _len(a: Val) -> Val:
    return Val(F.length(text(a)).cast("long"), "int")


@register("left", 2)
def _left(a: Val, n: Val) -> Val:
    return Val(F.left(text(a), F.greatest(whole(n), F.lit(0)).cast("int")), "str")


@register("right", 2)
def _right(a: Val, n: Val) -> Val:
    return Val(F.right(text(a), F.greatest(whole(n), F.lit(0)).cast("int")), "str")


@register("lower", 1)
def _lower(a: Val) -> Val:
    return Val(F.lower(text(a)), "str")


@register("upper", 1)
def _upper(a: Val) -> Val:
    return Val(F.upper(text(a)), "str")


@register("contains", 2)
def _contains(a: Val, b: Val) -> Val:
    return Val((text(b) != "") & F.contains(text(a), text(b)), "bool")


@register("find", 2)
def _find(a: Val, b: Val) -> Val:
    place = F.when(text(b) == "", F.lit(-1)).otherwise(F.position(text(b), text(a)) - 1)
    return Val(place.cast("long"), "int")


# -- types and dates


@register("type", 1)
def _type(a: Val) -> Val:
    return Val(F.lit("str" if a.type == "any" else a.type), "str")


for _kind in ("real", "int", "bool", "datetime"):
    register(_kind, 1)(lambda a, kind=_kind: Val(convert(a, kind), kind))


@register("str", 1, 2)
def _str(a: Val, places: Val | None = None) -> Val:
    if places is None or a.type != "real":
        return Val(text(a), "str")
    n = F.greatest(whole(places), F.lit(0)).cast("int")
    cases = F.lit(None).cast("string")
    for k in range(16, -1, -1):
        cases = F.when(n == k, trimmed(a.col, k)).otherwise(cases)
    return Val(F.coalesce(cases, trimmed(a.col, 16)), "str")


def _stamp(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros.cast("long")), "yyyy-MM-dd HH:mm:ss.SSS")


@register("formatsec", 1)
def _formatsec(a: Val) -> Val:
    return Val(_stamp(F.round(real(a) * 1_000_000)), "str")


@register("formatms", 1)
def _formatms(a: Val) -> Val:
    return Val(_stamp(F.round(real(a) * 1_000)), "str")


# -- aggregates; the planner gives ``any`` the rows' order


@register("count", 1, aggregate=True)
def _count(a: Val) -> Val:
    return Val(F.count(F.lit(1)), "int")


@register("sum", 1, aggregate=True)
def _sum(a: Val) -> Val:
    return Val(F.sum(a.col), "int") if a.type == "int" else Val(F.sum(real(a)), "real")


@register("avg", 1, aggregate=True)
def _avg(a: Val) -> Val:
    return Val(F.avg(real(a)), "real")


@register("var", 1, aggregate=True)
def _var(a: Val) -> Val:
    return Val(F.coalesce(F.var_samp(real(a)), F.lit(0.0)), "real")


@register("stdev", 1, aggregate=True)
def _stdev(a: Val) -> Val:
    return Val(F.coalesce(F.stddev_samp(real(a)), F.lit(0.0)), "real")


@register("cov", 2, aggregate=True)
def _cov(a: Val, b: Val) -> Val:
    return Val(F.covar_pop(real(a), real(b)), "real")


@register("corr", 2, aggregate=True)
def _corr(a: Val, b: Val) -> Val:
    x, y = F.stddev_pop(real(a)), F.stddev_pop(real(b))
    safe = F.when((x == 0) | (y == 0), F.lit(math.nan)).otherwise(F.try_divide(F.covar_pop(real(a), real(b)), x * y))
    return Val(safe, "real")


@register("any", 1, aggregate=True)
def _any(a: Val, order: Column | None = None) -> Val:
    col = F.when(a.col != "", a.col) if a.type in ("str", "any") else a.col
    if order is None:
        found = F.first(col, ignorenulls=True)
    else:
        found = F.min_by(col, F.when(col.isNotNull(), order))
    return Val(F.coalesce(found, F.lit("")) if a.type in ("str", "any") else found, "str" if a.type == "any" else a.type)
