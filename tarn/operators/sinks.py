"""INSERT: a select's rows as one JSON or CSV file, in place of what is there.

Spark writes parts in parallel to a folder beside the target. Up to ``most`` bytes
those are then put together in order, as bytes, and the file takes the target's
place; beyond that (or with ``single_file=False``) the folder itself does, each CSV
part with a header, and reads as a table like any folder. What was there is moved
aside first and comes back if the change of places fails. A folder is only replaced
if it holds nothing but such parts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from tarn.errors import QueryError
from tarn.functions import values as V
from tarn.operators.lower import Result
from tarn.plans.tree import Table
from tarn.sources import csv, paths


#: Beyond so many bytes a result stays a folder of parts.
MOST = 1 << 30


def insert(spark: SparkSession, table: Table, result: Result, single_file: bool = True, most: int = MOST) -> str:
    """Writes the rows; returns the message."""
    path = paths.Path.of(table.path)
    if table.kind not in ("json", "csv") or path.scheme != "files":
        raise QueryError(f"{table.kind} {table.path} can't be written to")
    fs, target = paths._hadoop(spark, path.url)
    if not _replaceable(fs, target):
        raise QueryError(f"{table.path} is a folder with other files in it")
    header = ""
    if table.kind == "json":
        own = dict(result.outputs)  # of equal names the last counts
        line = F.to_json(F.struct(*(F.lit(None).cast("string").alias(n) if v.kind == "null" else v.col.alias(n) for n, v in own.items())), {"ignoreNullFields": "false"})
    else:
        header = csv.line([n for n, _ in result.outputs])
        line = F.concat_ws(",", *(_cell(V.text(v)) for _, v in result.outputs))
    parent, name = target.getParent(), target.getName()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    beside = lambda: hadoop(*([parent] if parent is not None else []), f".{name}.{uuid.uuid4().hex}")
    folder, seen = beside(), Observation()
    rows = result.df.select(line.alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    if header:
        rows = rows.mapInArrow(lambda it: _headed(it, header), "value string")
    try:
        rows.write.text(folder.toString())
        parts = sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        new = folder
        if single_file and sum(size for _, size in parts) <= most:
            new = hadoop(folder, "_whole")
            _join(spark, fs, [hadoop(p) for p, _ in parts], new, (header + "\n").encode() if header else b"")
        _take_place(fs, new, target, beside())
    finally:
        fs.delete(folder, True)
    return f'{seen.get["n"]} rows written to "{table.path}"'


def _headed(batches, header: str):
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])


def _replaceable(fs, target) -> bool:
    """Nothing, a file, or a folder of parts of ours."""
    if not fs.exists(target) or fs.getFileStatus(target).isFile():
        return True
    names = [s.getPath().getName() for s in fs.listStatus(target) if not s.getPath().getName().endswith(".crc")]
    return "_SUCCESS" in names and all(n == "_SUCCESS" or n.startswith("part-") for n in names)


def _join(spark: SparkSession, fs, parts: list, whole, header: bytes) -> None:
    """The parts one after another; the header, which each begins with, once."""
    copy, out = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes, fs.create(whole, True)
    try:
        out.write(bytearray(header))
        for part in parts:
            data = fs.open(part)
            try:
                data.seek(len(header))
                copy(data, out, 1 << 16, False)
            finally:
                data.close()
    finally:
        out.close()


def _take_place(fs, new, target, aside) -> None:
    there = fs.exists(target)
    if there and not fs.rename(target, aside):
        raise QueryError(f"{target} can't be replaced")
    if not fs.rename(new, target):
        if there:
            fs.rename(aside, target)
        raise QueryError(f"{target} can't be written")
    if there:
        fs.delete(aside, True)


def _cell(text):
    """A CSV cell as sources.csv reads it."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    quoted = F.concat(F.lit('"'), F.replace(escaped, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(text.isNull(), F.lit(r"\\N")).when(text.rlike(r'[",\r\n]|^\s|\s$|^$'), quoted).otherwise(escaped)
