"""The language's functions, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import QueryError
from tarn.functions import values as V
from tarn.functions.values import Val


@dataclass(frozen=True)
class Function:
    """least and most: numbers of arguments; build makes the result of the arguments' Vals."""

    least: int
    most: int
    build: Callable[..., Val]


def _double(c: Column) -> Val:
    return Val(c, "double", T.DoubleType())


def _bool(c: Column) -> Val:
    return Val(c, "bool", T.BooleanType())


def _divide(a: Column, b: Column) -> Column:
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when((a > 0) == ~b.cast("string").startswith("-"), float("inf")).otherwise(float("-inf"))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def _arithmetic(of: Callable[[Column, Column], Column]) -> Function:
    return Function(2, 2, lambda a, b: _double(of(V.number(a), V.number(b))))


def _same(a: Val, b: Val) -> tuple[Column, Column] | None:
    """The two sides in one of Spark's own types, if their kinds allow."""
    numbers = ("int", "double")
    if a.kind in numbers and b.kind in numbers:
        for x, y in ((a, b), (b, a)):  # a whole constant goes to the column's type, so that the scan can filter
            if x.kind == "int" and isinstance(y.literal, float) and y.literal.is_integer() and abs(y.literal) < 2**53:
                whole = F.lit(int(y.literal)).cast(x.dtype) if abs(y.literal) < 2**31 or isinstance(x.dtype, T.LongType) else F.lit(int(y.literal))
                return (a.col, whole) if x is a else (whole, b.col)
        return (a.col, b.col) if a.kind == b.kind else (V.number(a), V.number(b))
    if a.kind == b.kind and a.kind in ("string", "bool"):
        return a.col, b.col
    if a.kind == b.kind == "other" and a.dtype == b.dtype:
        return a.col, b.col
    return None


def _comparison(of: Callable[[Column, Column], Column]) -> Function:
    def build(a: Val, b: Val) -> Val:
        if "null" in (a.kind, b.kind):
            return _bool(V.null("boolean"))
        same = _same(a, b)
        if same:
            return _bool(of(*same))
        by_text = of(V.spelling(a), V.spelling(b))
        if "variant" not in (a.kind, b.kind) or not {a.kind, b.kind} <= {"variant", "int", "double"}:
            return _bool(by_text)
        numeric = [V.kind_of(x.col).isin("int", "double") for x in (a, b) if x.kind == "variant"]
        both = numeric[0] if len(numeric) == 1 else numeric[0] & numeric[1]
        return _bool(F.when(both, of(V.number(a), V.number(b))).otherwise(by_text))

    return Function(2, 2, build)


def _strict(of: Callable[[Column, Column], Column]) -> Function:
    def build(a: Val, b: Val) -> Val:
        p, q = V.boolean(a), V.boolean(b)
        return _bool(F.when(p.isNull() | q.isNull(), None).otherwise(of(p, q)))

    return Function(2, 2, build)


def _coalesce(*args: Val) -> Val:
    args = tuple(a for a in args if a.kind != "null")
    if not args:
        return V.constant(None)
    if len({a.kind for a in args}) > 1 or args[0].kind in ("struct", "array", "map", "other") and len({a.dtype for a in args}) > 1:
        args = tuple(map(V.lifted, args))
    col = F.coalesce(*(a.col for a in args)) if len(args) > 1 else args[0].col
    return V.typed(col, args[0].dtype if args[0].kind != "int" else T.LongType()) if args[0].kind != "int" else Val(col.cast("long"), "int", T.LongType())


SCALARS: dict[str, Function] = {
    "add": _arithmetic(lambda a, b: a + b),
    "minus": _arithmetic(lambda a, b: a - b),
    "multiply": _arithmetic(lambda a, b: a * b),
    "divide": _arithmetic(_divide),
    "equal": _comparison(lambda a, b: a == b),
    "not_equal": _comparison(lambda a, b: a != b),
    "gt": _comparison(lambda a, b: a > b),
    "gte": _comparison(lambda a, b: a >= b),
    "lt": _comparison(lambda a, b: a < b),
    "lte": _comparison(lambda a, b: a <= b),
    "idx": Function(2, 2, V.idx),
    "is_null": Function(1, 1, lambda a: _bool(a.col.isNull())),
    "is_not_null": Function(1, 1, lambda a: _bool(a.col.isNotNull())),
    "number": Function(1, 1, lambda a: _double(V.number(a))),
    "and": _strict(lambda a, b: a & b),
    "or": _strict(lambda a, b: a | b),
    "coalesce": Function(0, 1000, _coalesce),
}


def _extreme(whole: Callable[[Column], Column], by: Callable[[Column, Column], Column]) -> Callable[[Val], Val]:
    def build(a: Val) -> Val:
        if a.kind == "null":
            return a
        col = by(a.col, V.sort_key(a)) if V.loose(a.dtype) else whole(a.col)
        return Val(col, a.kind, a.dtype)

    return build


def _max_row(key: Val, value: Val) -> Val:
    if "null" in (key.kind, value.kind):
        return V.constant(None)
    return Val(F.max_by(value.col, V.sort_key(key)), value.kind, value.dtype)


AGGREGATES: dict[str, Function] = {
    "count": Function(0, 1, lambda a=None: Val(F.count(F.lit(1) if a is None else a.col), "int", T.LongType())),
    "sum": Function(1, 1, lambda a: _double(F.coalesce(F.sum(V.number(a)), F.lit(0.0)))),
    "max": Function(1, 1, _extreme(F.max, F.max_by)),
    "min": Function(1, 1, _extreme(F.min, F.min_by)),
    "max_row": Function(2, 2, _max_row),
}


def find(name: str, n_args: int) -> Function:
    f = SCALARS.get(name) or AGGREGATES.get(name)
    if f is None:
        raise QueryError(f"no function is called {name}")
    if not f.least <= n_args <= f.most:
        raise QueryError(f"{name} doesn't take {n_args} arguments")
    return f


def register(name: str, function: Function, aggregate: bool = False) -> None:
    """Adds a function of the caller's own."""
    (AGGREGATES if aggregate else SCALARS)[name.lower()] = function
