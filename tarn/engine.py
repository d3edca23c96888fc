"""The engine: query text in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import values as V
from tarn.operators.describe import describe
from tarn.operators.lower import Lowering, Result
from tarn.operators.sinks import insert
from tarn.plans.parser import parse
from tarn.plans.tree import Describe, Explain, Insert

# Settings that records of loose types need: equal keys, the last counts.
SETTINGS = {"spark.sql.variant.allowDuplicateKeys": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


class Engine:
    """promote: look for fields of one type in JSON, at the price of a pass over it. single_file: INSERT makes one file of up to a GB."""

    def __init__(self, spark: SparkSession, promote: bool = True, single_file: bool = True):
        self.spark, self.promote, self.single_file = spark, promote, single_file
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)

    def _result(self, text: str) -> Result | DataFrame:
        s = parse(text)
        lowering = Lowering(self.spark, self.promote)
        if isinstance(s, Describe):
            rows = describe(self.spark, s.table, s.as_table)
            return self.spark.createDataFrame(rows, "table string" if s.as_table else "column_name string, column_type string")
        if isinstance(s, Explain):
            plan = self._named(lowering.select(s.select))._jdf.queryExecution().toString()
            return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string")
        if isinstance(s, Insert):
            return self.spark.createDataFrame([(insert(self.spark, s.table, lowering.select(s.select), self.single_file),)], "result string")
        return lowering.select(s)

    @staticmethod
    def _named(r: Result) -> DataFrame:
        return r.df.select(*(v.col for _, v in r.outputs)).toDF(*(n for n, _ in r.outputs))

    def sql(self, text: str) -> DataFrame:
        """The rows of a statement, with values in Spark's types (VARIANT where a column has several)."""
        got = self._result(text)
        return got if isinstance(got, DataFrame) else self._named(got)

    def text(self, text: str) -> DataFrame:
        """The rows of a statement as they are printed: strings, numbers as doubles, lists and objects as JSON."""
        got = self._result(text)
        if isinstance(got, DataFrame):
            return got
        return got.df.select(*(V.text(v).cast("string") for _, v in got.outputs)).toDF(*(n for n, _ in got.outputs))

    def json(self, text: str) -> DataFrame:
        """Column ``value``: each row as a JSON array."""
        got = self._result(text)
        vals = [V.typed(F.col(f"`{f.name}`"), f.dataType) for f in got.schema.fields] if isinstance(got, DataFrame) else [v for _, v in got.outputs]
        df = got if isinstance(got, DataFrame) else got.df
        cells = [F.coalesce(V._json(v) if v.kind in ("array", "struct", "map", "variant") else F.regexp_replace(F.to_json(F.array(v.col.cast("string") if v.kind in ("other", "null") else v.col)), r"^\[|\]$", ""), F.lit("null")) for v in vals]
        return df.select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("value"))
