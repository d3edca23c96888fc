"""Selects as DataFrame operations: source, filter, group or project, sort, limit."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import QueryError
from tarn.functions import values as V
from tarn.functions.registry import AGGREGATES, SCALARS, find
from tarn.functions.values import Val
from tarn.operators.scope import Closed, Joined, Raw, Scope, Viewed
from tarn.plans.parser import unwrapped
from tarn.plans.tree import Call, Expr, Inline, Join, Lateral, Literal, Name, Scan, Select, Source, Table
from tarn.sources import csv, dir, json, paths
from tarn.streaming import dummy


@dataclass(frozen=True)
class Result:
    """A DataFrame of uniquely named columns and the query's outputs on it."""

    df: DataFrame
    outputs: list[tuple[str, Val]]


class Lowering:
    def __init__(self, spark: SparkSession, promote: bool = True):
        self.spark, self.promote, self._ids = spark, promote, count()

    def _new(self) -> str:
        return f"c{next(self._ids)}"

    # expressions

    def value(self, e: Expr, scope: Scope) -> Val:
        """Of a row-level expression."""
        if isinstance(e, Literal):
            return V.constant(e.value)
        if isinstance(e, Name):
            return scope.find(None, e.name)
        if (field := self._qualified(e, scope)) is not None:
            return field
        if e.function in AGGREGATES and e.function not in SCALARS:
            raise QueryError(f"{e.function} is only allowed in a select list, and not within another aggregate")
        return find(e.function, len(e.args)).build(*(self.value(a, scope) for a in e.args))

    @staticmethod
    def _qualified(e: Expr, scope: Scope) -> Val | None:
        """The field that ``alias.name`` is, if the alias is a table's."""
        if isinstance(e, Call) and e.function == "idx":
            base, key = e.args
            if isinstance(base, Name) and isinstance(key, Literal) and isinstance(key.value, str) and base.name in scope.aliases():
                return scope.find(base.name, key.value)
        return None

    def truth(self, e: Expr, scope: Scope) -> Column:
        """A condition for a filter or join: true just where e is, in a form that can be pushed down."""
        if isinstance(e, Call) and e.function == "and" and len(e.args) == 2:
            return self.truth(e.args[0], scope) & self.truth(e.args[1], scope)
        if isinstance(e, Call) and e.function == "or" and len(e.args) == 2:
            either = self.truth(e.args[0], scope) | self.truth(e.args[1], scope)
            return reduce(lambda a, b: a & b, [self._known(a, scope) for a in e.args], either)
        return V.boolean(self.value(e, scope))

    def _known(self, e: Expr, scope: Scope) -> Column:
        """Whether e has a truth value: for comparisons of columns, whether those are not null."""
        if isinstance(e, Call) and len(e.args) == 2:
            if e.function in ("and", "or"):
                return self._known(e.args[0], scope) & self._known(e.args[1], scope)
            if e.function in ("equal", "not_equal", "gt", "gte", "lt", "lte"):
                sides = [self.value(a, scope) for a in e.args]
                plain = ("int", "double", "string", "bool")
                if all(v.kind in plain for v in sides):
                    return reduce(lambda a, b: a & b, [v.col.isNotNull() for v in sides if v.literal is None], F.lit(True))
        return V.boolean(self.value(e, scope)).isNotNull()

    def _has_aggregate(self, e: Expr) -> bool:
        return isinstance(e, Call) and (e.function in AGGREGATES and e.function not in SCALARS or any(map(self._has_aggregate, e.args)))

    # sources

    def table(self, table: Table, alias: str | None, limited: int = 0) -> tuple[DataFrame, Scope]:
        path = paths.Path.of(table.path)
        if table.kind == "json" and path.scheme == "dummy":
            if not limited:
                raise QueryError(f"{table.path} has no end: only a limit, and nothing that needs all rows, can stand above it")
            return self._typed(dummy(self.spark), alias)
        if table.kind == "json":
            return self._json(path, alias, limited)
        if table.kind == "csv":
            if path.scheme in ("kafka", "dummy"):
                raise QueryError("csv can't be read from events")
            m = self._new()
            df = csv.read(self.spark, path).select(F.col("m").alias(m))
            cell = lambda name: Val(F.col(m), "map", T.MapType(T.StringType(), T.StringType())) if name == "__all__" else Val(F.try_element_at(F.col(m), F.lit(name)), "string", T.StringType())
            return df, Raw(alias, cell)
        if table.kind == "dir":
            return self._typed(dir.read(self.spark, path), alias)
        if path.scheme == "files" and not paths.exists(self.spark, path):
            return self._typed(self.spark.createDataFrame([], "nothing string"), alias)
        above = [t.getPath().toString() for t in paths.tops(self.spark, path)] if path.scheme == "files" else [path.url]
        return self._typed(self.spark.read.parquet(*above), alias)

    def _typed(self, df: DataFrame, alias: str | None) -> tuple[DataFrame, Scope]:
        names = {f.name: self._new() for f in df.schema.fields}
        fields = {f.name.lower(): (names[f.name], f.dataType) for f in df.schema.fields}
        out = df.select(*(F.col(f"`{n}`").alias(u) for n, u in names.items()))

        def value(name: str) -> Val:
            if name == "__all__":
                kind = T.StructType([T.StructField(n, t) for n, (_, t) in fields.items()])
                return Val(F.struct(*(F.col(u).alias(n) for n, (u, _) in fields.items())), "struct", kind)
            return V.typed(F.col(fields[name][0]), fields[name][1]) if name in fields else V.constant(None)

        return out, Raw(alias, value)

    def _json(self, path: paths.Path, alias: str | None, preview: int) -> tuple[DataFrame, Scope]:
        got = json.read(self.spark, path, self.promote, preview)
        t, v = self._new(), self._new()
        df = got.df.select(F.col("t").alias(t), F.col("v").alias(v))
        root = Val(F.col(v), "variant", T.VariantType(), None, (F.col(t), "$"))
        spelled: dict[str, list[str]] = {}
        for name in got.types:
            spelled.setdefault(name.lower(), []).append(name)

        def value(name: str) -> Val:
            if name == "__all__":
                if not got.types or any(n != n.lower() for n in got.types):
                    return self._whole(root)
                kind = T.StructType([T.StructField(n, T.VariantType() if isinstance(x, T.NullType) else x) for n, x in got.types.items()])
                return Val(V.get(root.col, "$", _ddl(kind)), "struct", kind, None, root.path)
            own = spelled.get(name, [])
            if got.types and not own:
                return V.constant(None)
            at = V.json_path(own[0]) if len(own) == 1 else None
            if at is None:
                return V.idx(root, V.constant(name))
            dtype = got.types[own[0]]
            if isinstance(dtype, T.VariantType):
                return Val(V.present(V.get(root.col, at, "variant")), "variant", dtype, None, (F.col(t), at))
            if isinstance(dtype, T.NullType):
                return V.constant(None)
            return V.typed(V.get(root.col, at, dtype.simpleString() if not isinstance(dtype, (T.StructType, T.ArrayType)) else _ddl(dtype)), dtype, (F.col(t), at) if isinstance(dtype, (T.StructType, T.ArrayType)) else None)

        return df, Raw(alias, value)

    @staticmethod
    def _whole(root: Val) -> Val:
        """The record with its keys in lower case; printed from its text where they are so there."""
        low = F.forall(F.json_object_keys(root.path[0]), lambda k: k == F.lower(k))
        keyed = F.transform_keys(V.get(root.col, "$", "map<string,variant>"), lambda k, _: F.lower(k))
        made = V.lifted(Val(keyed, "map", T.MapType(T.StringType(), T.VariantType()))).col
        return Val(F.when(low, root.col).otherwise(made), "variant", T.VariantType(), None, (F.when(low, root.path[0]), "$"))

    def source(self, s: Source, limited: int = 0) -> tuple[DataFrame, Scope]:
        if isinstance(s, Scan):
            return self.table(s.table, s.alias, limited)
        if isinstance(s, Inline):
            got = self.select(s.select, limited)
            return got.df, Closed(s.alias, got.outputs)
        if isinstance(s, Lateral):
            df, scope = self.source(s.source, limited)
            many, element = V.listed(self.value(unwrapped(s.expr), scope))
            u = self._new()
            return df.select("*", F.explode(many).alias(u)), Viewed(scope, s.name, V.typed(F.col(u), element))
        (left, a), (right, b) = self.source(s.left), self.source(s.right)
        scope = Joined(a, b)
        return left.join(right, self.truth(unwrapped(s.on), scope), "inner"), scope

    # selects

    def select(self, s: Select, limited: int = 0) -> Result:
        """limited: of how many rows, if not of all, whoever asks makes use."""
        outputs = [(o.name, unwrapped(o.expr)) for o in s.outputs]
        grouped = bool(s.group_by) or any(self._has_aggregate(e) for _, e in outputs)
        wanted = min([n for n in (limited or None, None if s.limit is None else max(1, s.limit)) if n is not None], default=0)
        df, scope = self.source(s.source, 0 if grouped or s.order_by or s.where is not None else wanted)
        if s.where is not None:
            df = df.where(self.truth(unwrapped(s.where), scope))
        if grouped:
            df, values = self._group(df, scope, [unwrapped(e) for e in s.group_by], [e for _, e in outputs])
        else:
            values = [self.value(e, scope) for _, e in outputs]
        df, values = self._project(df, values)
        named = [(n, v) for (n, _), v in zip(outputs, values, strict=True)]
        if s.order_by:
            own = Closed(None, named)
            df = df.orderBy(*((c.asc_nulls_first() if o.ascending else c.desc_nulls_last()) for o in s.order_by for c in [V.sort_key(self.value(unwrapped(o.expr), own))]))
        if s.limit is not None:
            df = df.limit(s.limit)
        return Result(df, named)

    def _project(self, df: DataFrame, values: list[Val]) -> tuple[DataFrame, list[Val]]:
        """Each value as a column of its own; texts that lists and objects are printed from come along."""
        cols, out, texts = [], [], {}
        for v in values:
            u = self._new()
            cols.append(v.col.alias(u))
            path = v.path
            if path is not None:
                key = str(path[0])
                if key not in texts:
                    texts[key] = self._new()
                    cols.append(path[0].alias(texts[key]))
                path = F.col(texts[key]), path[1]
            out.append(replace(v, col=F.col(u), path=path))
        return df.select(*cols), out

    def _group(self, df: DataFrame, scope: Scope, keys: list[Expr], outputs: list[Expr]) -> tuple[DataFrame, list[Val]]:
        by, aggregates, known = [], [], {}
        for e in keys:
            if self._has_aggregate(e):
                raise QueryError("a group key can't be an aggregate")
            v, u = self.value(e, scope), self._new()
            by.append(V.group_key(v).alias(u))
            if V.loose(v.dtype):
                u = self._aggregate(aggregates, F.any_value(v.col))
            known[e] = replace(v, col=F.col(u), literal=None, path=None)

        def of(e: Expr) -> Val:
            if e in known:
                return known[e]
            if isinstance(e, Literal):
                return V.constant(e.value)
            bare = isinstance(e, Name) or self._qualified(e, scope) is not None
            if bare:
                v = self.value(e, scope)
                return replace(v, col=F.col(self._aggregate(aggregates, F.last(v.col))), literal=None, path=None)
            f = find(e.function, len(e.args))
            if e.function in AGGREGATES and e.function not in SCALARS:
                v = f.build(*(self.value(a, scope) for a in e.args))
                return replace(v, col=F.col(self._aggregate(aggregates, v.col)), literal=None, path=None)
            return f.build(*map(of, e.args))

        values = [of(e) for e in outputs]
        aggregates = aggregates or [F.count(F.lit(1)).alias(self._new())]
        return df.groupBy(*by).agg(*aggregates), values

    def _aggregate(self, held: list[Column], c: Column) -> str:
        u = self._new()
        held.append(c.alias(u))
        return u


def _ddl(dtype: T.DataType) -> str:
    """A type as VARIANT functions take it, with quoted names."""
    if isinstance(dtype, T.StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{_ddl(f.dataType)}" for f in dtype.fields) + ">"
    if isinstance(dtype, T.ArrayType):
        return f"array<{_ddl(dtype.elementType)}>"
    return "variant" if isinstance(dtype, T.NullType) else dtype.simpleString()
