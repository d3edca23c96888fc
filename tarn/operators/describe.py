"""DESCRIBE: the kinds of values that the first records of a table have."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import PythonException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarn.errors import QueryError
from tarn.plans.tree import Table
from tarn.sources import csv, dir, paths
from tarn.sources import json as json_source

RECORDS = 2000


@dataclass
class Seen:
    """The kinds met at one place. Whole numbers beyond 32 bits count as floats."""

    kinds: set[str] = field(default_factory=set)
    element: Seen | None = None
    members: dict[str, Seen] = field(default_factory=dict)

    def add(self, value: object) -> None:
        if isinstance(value, bool):
            self.kinds.add("Boolean")
        elif isinstance(value, int) and -(2**31) <= value < 2**31:
            self.kinds.add("Int")
        elif isinstance(value, (int, float)):
            self.kinds.add("Float")
        elif isinstance(value, str):
            self.kinds.add("String")
        elif isinstance(value, list):
            self.kinds.add("Array")
            self.element = self.element or Seen()
            for v in value:
                self.element.add(v)
        elif isinstance(value, dict):
            self.kinds.add("Struct")
            for k, v in value.items():
                self.members.setdefault(k, Seen()).add(v)

    @property
    def ordered(self) -> list[str]:
        """Floats take in whole numbers."""
        order = ("Float", "Int", "String", "Boolean", "Array", "Struct")
        return [k for k in order if k in self.kinds and not (k == "Int" and "Float" in self.kinds)]

    def short(self) -> str:
        full = {"Array": lambda: f"Array<{self.element.short()}>", "Struct": lambda: "Struct<{" + ", ".join(f"{k}={v.short()}" for k, v in self.members.items()) + "}>"}
        return " OR ".join(full[k]() if k in full else k for k in self.ordered)

    def long(self, indent: str) -> str:
        """As in a table definition. A float alone is printed NULL, and beside others it doesn't make a union."""
        counted = [k for k in self.ordered if k != "Float"]
        if not counted:
            return f"{indent}NULL"
        union = len(counted) > 1
        inner = indent + "  " * union
        names = {"Float": "FLOAT", "Int": "INTEGER", "String": "STRING", "Boolean": "BOOLEAN"}
        parts = []
        for k in self.ordered:
            if k == "Array":
                parts.append(f"{inner}ARRAY<{self.element.long(inner).lstrip()}>")
            elif k == "Struct":
                rows = ",\n".join(f"{inner}  {n}: {v.long(inner + '  ').lstrip()}" for n, v in self.members.items())
                parts.append(f"{inner}STRUCT<\n{rows}\n{inner}>" if rows else f"{inner}STRUCT<>")
            else:
                parts.append(inner + names[k])
        return f"{indent}UNION<\n" + ",\n".join(parts) + f"\n{indent}>" if union else parts[0]


def _plain(value: object) -> object:
    """A Spark value as JSON has it."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def _texts(got: json_source.Records) -> list[str]:
    return [r.t for r in got.df.select("t").limit(RECORDS).collect()]


def records(spark: SparkSession, table: Table) -> list[dict]:
    """The first records, keys in lower case."""
    path = paths.Path.of(table.path)
    if table.kind == "json":
        if path.scheme == "dummy":
            return [{"foo": 4, "bar": i % 10} for i in range(RECORDS)]
        try:
            texts = _texts(json_source.read(spark, path, preview=RECORDS))
        except PythonException:  # an object over several lines where the preview didn't look
            if path.scheme not in ("files", "web"):
                raise
            texts = _texts(json_source.whole(spark, path))
        return [{k.lower(): v for k, v in json.loads(t).items()} for t in texts]
    if table.kind == "csv":
        if path.scheme not in ("files", "web"):
            raise QueryError("csv can't be read from events")
        return [dict(r.e) for r in csv.read(spark, path).select(F.map_entries("m").alias("e")).limit(RECORDS).collect()]
    if table.kind == "parquet" and path.scheme == "files" and not paths.exists(spark, path):
        return []
    df = dir.read(spark, path) if table.kind == "dir" else spark.read.parquet(*(t.getPath().toString() for t in paths.tops(spark, path)))
    rows = [_plain(r) for r in df.limit(RECORDS).collect()]
    if table.kind == "dir":  # sizes are of the wide kind
        return [{k: float(v) if k == "size" and v is not None else v for k, v in r.items()} for r in rows]
    return [{k.lower(): v for k, v in r.items()} for r in rows]


def describe(spark: SparkSession, table: Table, as_table: bool) -> list[tuple]:
    seen: dict[str, Seen] = {}
    for r in records(spark, table):
        for k, v in r.items():
            seen.setdefault(k, Seen()).add(v)
    names = sorted(seen) if table.kind == "json" else list(seen)
    if not as_table:
        return [(n, seen[n].short()) for n in names]
    body = ",\n".join(f"  {n} {seen[n].long('  ').lstrip()}" for n in names)
    return [(line,) for line in f"CREATE TABLE '{table.path}' (\n{body}\n)".split("\n")]
