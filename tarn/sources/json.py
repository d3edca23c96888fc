"""JSON: a stream of objects in any layout, read as VARIANT records beside their text.

Files of one object a line are read by lines, which Spark splits and parses in
the JVM. Which files are is proven, not assumed: one pass looks for lines that
are no single object, and finds the fields' types in passing. Any other file
(arrays, arrays among objects, objects over several lines or side by side) is cut
into the same kind of records by a decoder that skips white space, commas and
brackets between objects; it reads a file of up to ``LARGE`` bytes as a whole, and
larger ones in chunks (``chunks``), by many tasks. The pass doesn't hold lines of
``LONG`` bytes or more: a file that has one, as its size tells, is cut like the odd
ones. What the pass finds is kept for as long as the files have the same names, sizes and times, so further queries
of the same table make none.

Previews (a limit without filter, order or groups; describe) make no pass. They
judge by as many lines as they can need.

Fields that have one type all through become native columns; others stay VARIANT.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import QueryError
from tarn.sources import chunks, paths
from tarn.sources.paths import Path

#: Two objects or arrays side by side; within one JSON value this only occurs in strings, which are blanked before a line is judged by it.
_SIDE_BY_SIDE, _STRING = r"[}\]]\s*[{\[]", r'"(?:[^"\\]++|\\.)*+"'
PEEK = 1000
#: Odd files of more bytes are cut in chunks; of compressed ones, less by PACKED.
LARGE, PACKED = 16 << 20, 20
#: The pass over files that aren't compressed holds no line of so many bytes.
LONG = 16 << 20
_BETWEEN = re.compile(r"[\s,\[\]]*")


def objects(text: str) -> Iterator[str]:
    """The texts of the objects in a stream, as they are written."""
    text = text.replace("\0", "")
    decoder, at = json.JSONDecoder(), 0
    while True:
        at = _BETWEEN.match(text, at).end()
        if at == len(text):
            return
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError as e:
            raise QueryError(f"not JSON at character {at}: {e}") from None
        if isinstance(value, dict):
            yield text[at:end]
        at = end


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text in batch["value"]:
            out = []
            for o in objects(text or ""):
                out.append(o)
                if len(out) == 10_000:
                    yield pd.DataFrame({"t": out})
                    out = []
            yield pd.DataFrame({"t": pd.Series(out, dtype=str)})


@dataclass(frozen=True)
class Records:
    """df: columns t (an object's text) and v (the VARIANT of it). types: those known, by field as written."""

    df: DataFrame
    types: dict[str, T.DataType] = field(default_factory=dict)


def _known(schema: str | None) -> dict[str, T.DataType]:
    """The fields of schema_of_variant_agg's answer."""
    if not schema:
        return {}
    try:
        got = _Schema(schema).read()
    except (ValueError, IndexError):
        return {}
    return {f.name: f.dataType for f in got.fields} if isinstance(got, T.StructType) else {}


class _Schema:
    """A reader of the types as Spark prints them for VARIANT."""

    _WORD = re.compile(r"[A-Z_]+(\(\d+,\s*-?\d+\))?")
    _FIELD = re.compile(r"(`(?:[^`]|``)*`|[^:`]+): ")

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def read(self) -> T.DataType:
        if self.text.startswith("OBJECT<", self.at):
            self.at += 7
            fields = []
            while self.text[self.at] != ">":
                m = self._FIELD.match(self.text, self.at)
                name = m[1][1:-1].replace("``", "`") if m[1][0] == "`" else m[1]
                self.at = m.end()
                fields.append(T.StructField(name, self.read()))
                if self.text.startswith(", ", self.at):
                    self.at += 2
            self.at += 1
            if len({f.name.lower() for f in fields}) < len(fields) or not fields:
                return T.VariantType()
            return T.StructType(fields)
        if self.text.startswith("ARRAY<", self.at):
            self.at += 6
            element = self.read()
            self.at += 1
            return T.ArrayType(T.VariantType() if isinstance(element, T.NullType) else element)
        m = self._WORD.match(self.text, self.at)
        self.at = m.end()
        word = m[0].split("(")[0]
        known = {"BIGINT": T.LongType(), "DECIMAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "VOID": T.NullType()}
        return known.get(word, T.VariantType())


def _odd(t: Column, parsed: Column) -> Column:
    """Whether a line is anything but one whole object."""
    blank = F.regexp_replace(t, _STRING, F.lit('""'))
    beside = F.when(t.rlike(_SIDE_BY_SIDE), blank.rlike(_SIDE_BY_SIDE)).otherwise(False)
    return parsed.isNull() | ~t.startswith("{") | ~t.endswith("}") | beside


#: What passes found: (path, files as they were, types wanted) -> (URLs of odd files, the fields' types in each other file).
_found: dict[tuple, tuple[list[str], list[dict[str, T.DataType]]]] = {}
KEPT = 64


def _proven(spark: SparkSession, path: Path, promote: bool, files: list[paths.File]) -> tuple[list[str], list[dict[str, T.DataType]]]:
    key = (path.url, promote, hash(tuple((f.url, f.modified, f.size) for f in files)))
    if key not in _found:
        long = {paths.same(f.url): f for f in files if f.size >= LONG and not _packed(f)}
        value, own = F.col("value"), [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")]
        if not long:
            rows = paths.lines(spark, path).select("value", *own)
        else:
            rows, packed = paths.lines(spark, path, [f.url for f in files if not _packed(f)], LONG).select("value", *own), [f.url for f in files if _packed(f)]
            if packed:
                rows = rows.union(paths.lines(spark, path, packed).select("value", *own))
        tried = rows.select("file", "size", (F.octet_length(value) + 1).cast("long").alias("bytes"), F.trim(F.translate(value, "\0\r", "")).alias("t")).withColumn("v", F.when(F.col("t") != "", F.try_parse_json("t")))
        schema = F.schema_of_variant_agg("v") if promote else F.lit(None).cast("string")
        each = tried.groupBy("file").agg(F.count_if((F.col("t") != "") & _odd(F.col("t"), F.col("v"))).alias("n"), schema.alias("s"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
        # a row for each different schema; files that are plain aren't named, unless they may have long lines
        seen = F.when((F.col("n") == 0) & (F.col("size") >= LONG), F.struct("file", "bytes"))
        got = each.groupBy(F.expr("if(n = 0, s, null)").alias("s")).agg(F.expr("collect_list(if(n > 0, file, null))").alias("odd"), F.collect_list(seen).alias("seen")).collect()
        odd = [f for r in got for f in r.odd]
        # a line that was passed over leaves at least LONG bytes of the size; ends of lines of two bytes may too, if there are very many
        held, known = {paths.same(x.file): x.bytes for r in got for x in r.seen}, {paths.same(f) for f in odd}
        odd += [f.url for u, f in long.items() if u not in known and f.size - held.get(u, 0) > LONG // 2]
        while len(_found) >= KEPT:
            del _found[next(iter(_found))]
        _found[key] = (odd, [_known(r.s) for r in got if r.s])
    return _found[key]


def _packed(file: paths.File) -> bool:
    return bool(re.search(paths.PACKED, file.url))


def _merged(each: list[dict[str, T.DataType]]) -> dict[str, T.DataType]:
    """The fields' types over all; nothing if names differ by case only."""
    out: dict[str, T.DataType] = {}
    for known in each:
        for name, kind in known.items():
            out[name] = _one(out[name], kind) if name in out else kind
    return out if len({n.lower() for n in out}) == len(out) else {}


def _one(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both, VARIANT if none does. Whole numbers and decimals in one field are decimals, as within a file."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_one(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = _merged([{f.name: f.dataType for f in x.fields} for x in (a, b)])
        return T.StructType([T.StructField(n, k) for n, k in fields.items()]) if fields else T.VariantType()
    return T.VariantType()


def read(spark: SparkSession, path: Path, promote: bool = True, preview: int = 0) -> Records:
    """The records of a JSON table; with ``promote`` fields of one type are known as such. ``preview``: only so many are wanted."""
    if path.scheme == "kafka":
        return _parsed(paths.kafka(spark, path).select(F.translate("value", "\0", "").alias("t")), promote and not preview)
    if path.scheme == "web":
        path = paths.fetched(spark, path.url)
    if path.scheme != "files" or not paths.exists(spark, path):
        return _parsed(paths.whole_texts(spark, path).mapInPandas(_cut, "t string"), False)
    trimmed = F.trim(F.translate("value", "\0\r", "")).alias("t")
    rows = paths.lines(spark, path).select(trimmed, F.col("_metadata.file_path").alias("file")).where("t <> ''")
    if preview:
        if rows.limit(max(PEEK, 2 * preview)).where(_odd(F.col("t"), F.try_parse_json("t"))).isEmpty():
            return _parsed(rows.select(F.col("t").alias("value")).mapInPandas(_cut, "t string"), False)  # line by line
        return whole(spark, path)
    files = [f for f in paths.listing(spark, path) if not f.below.endswith(".crc")]
    odd, types = _proven(spark, path, promote, files)
    plain = rows.select("t", F.parse_json("t").alias("v"))
    if not odd:
        return Records(plain, _merged(types) if promote else {})
    urls = {paths.same(f.url): f.url for f in files}
    odd = [urls[paths.same(o)] for o in odd]
    found = set(odd)
    cut = _cut_files(spark, path, [f for f in files if f.url in found])
    rest = sorted(set(urls.values()) - set(odd))
    if not rest:
        return _parsed(cut, promote)
    cut = _parsed(cut, promote)
    plain = paths.lines(spark, path, rest).select(trimmed).where("t <> ''").select("t", F.parse_json("t").alias("v"))
    return Records(plain.union(cut.df), _merged([*types, cut.types]) if promote else {})


def whole(spark: SparkSession, path: Path) -> Records:
    """The records of a table whose files are all cut by the decoder, without types."""
    if path.scheme == "web":
        path = paths.fetched(spark, path.url)
    if path.scheme != "files":
        return _parsed(paths.whole_texts(spark, path).mapInPandas(_cut, "t string"), False)
    return _parsed(_cut_files(spark, path, [f for f in paths.listing(spark, path) if not f.below.endswith(".crc")]), False)


def _cut_files(spark: SparkSession, path: Path, files: list[paths.File]) -> DataFrame:
    """Column ``t``: the objects in the files, those of large ones cut in chunks."""
    chunks.bounded(spark)
    large, small = [], []
    for f in files:
        (large if f.size > (LARGE // PACKED if _packed(f) else LARGE) else small).append(f)
    small = [f.url for f in small]
    if not large:
        return paths.whole_texts(spark, path, small).mapInPandas(_cut, "t string")
    cut = chunks.records(spark, large, objects)
    return cut.union(paths.whole_texts(spark, path, small).mapInPandas(_cut, "t string")) if small else cut


def _parsed(rows: DataFrame, promote: bool) -> Records:
    df = rows.select("t", F.parse_json("t").alias("v"))
    return Records(df, _known(df.agg(F.schema_of_variant_agg("v")).first()[0]) if promote else {})
