"""Large JSON files that aren't an object a line, cut by many tasks with bounded memory.

Spark's text reader splits a file at opening braces, wherever these stand, so no
reader holds more than lies between two of them. The pieces are put together to
chunks of some ``CHUNK`` bytes and kept in the shared folder, each with what it does
to the count of open braces and to being within a string, for both ways in which it
may begin. Sums over a file's chunks, in order, then tell how each does begin: the
cut is exact, not guessed. What lies whole within a chunk is cut there; the parts of
a value that goes over several chunks are brought together first. So the largest
thing that a task holds is a chunk or a single record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.errors import QueryError
from tarn.sources import paths

CHUNK = 512 << 10
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
_ESCAPED = re.compile(rb"\\.", re.S)
_QUOTE, _OPEN, _SHUT = b'"{}'
#: Where no mark leaves everything shut.
_NEVER = 1 << 62
_KIND = "file long, start long, number long, size long, bytes long, text binary, quotes long, step0 long, least0 long, step1 long, least1 long"

Objects = Callable[[str], Iterator[str]]


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES from now on, unless the session's are smaller: texts may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D+$", "", spark.conf.get(key))) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes and braces; whether each leaves a string open if the text begins outside of one; steps of the braces.

    Texts begin with an opening brace or their file, so none begins within an escape.
    """
    if b"\\" in text:
        text = _ESCAPED.sub(b"  ", text)
    a = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((a == _QUOTE) | (a == _OPEN) | (a == _SHUT))
    kind = a[at]
    return at, np.cumsum(kind == _QUOTE) & 1, (kind == _OPEN).astype(np.int64) - (kind == _SHUT)


def _effects(text: bytes) -> list[int]:
    """The columns from ``quotes`` on."""
    at, quoted, step = _marks(text)
    out = [int(quoted[-1]) if len(at) else 0]
    for begins in (0, 1):
        outside = quoted == begins
        depth = np.cumsum(np.where(outside, step, 0))
        out += [int(depth[-1]) if len(at) else 0, int(depth[outside].min()) if outside.any() else _NEVER]
    return out


def _chunk(run: tuple[int, int, int], number: int, text: bytes) -> pa.RecordBatch:
    length, text = len(text), text.replace(b"\0", b"")
    row = [run[0], run[1], number, run[2], length, text, *_effects(text)]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row], [c.split()[0] for c in _KIND.split(", ")])


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Chunks of the pieces between opening braces. A run is what lies in one split of a file."""
    run, number, held = None, 0, b""
    for batch in batches:
        files, starts, sizes = (batch.column(i).to_numpy() for i in range(3))
        many = np.cumsum(pc.binary_length(batch.column(3)).to_numpy().astype(np.int64) + 1) // most
        cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0) | (np.diff(many) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(files)], strict=True):
            if a == b:
                continue
            own = (int(files[a]), int(starts[a]), int(sizes[a]))
            text = b"{".join(batch.column(3).slice(a, b - a).to_pylist())
            if own != run:
                if held:
                    yield _chunk(run, number, held)
                run, number, held = own, 0, text if own[1] == 0 else b"{" + text
            else:
                held += b"{" + text
            if len(held) >= most:
                yield _chunk(run, number, held)
                number, held = number + 1, b""
    if held:
        yield _chunk(run, number, held)


def _parts(text: bytes, quoted: int, depth: int) -> tuple[bytes, bytes, bytes]:
    """The end of a value that began before, what is whole, and the beginning of one that goes on."""
    at, inside, step = _marks(text)
    inside = inside ^ quoted
    level = depth + np.cumsum(np.where(inside == 0, step, 0))
    shut, begun = np.flatnonzero((inside == 0) & (level <= 0)), quoted == 1 or depth > 0
    if begun and not len(shut):
        return text, b"", b""
    first = int(at[shut[0]]) + 1 if begun else 0
    after = int(shut[-1]) + 1 if len(shut) else 0
    last = int(at[after]) if after < len(at) else len(text)
    return text[:first], text[first:last], text[last:]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, tuple[bytes, bytes, bytes]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["lost"]:
                raise QueryError("not JSON: a file ends with an opening brace")
            yield row, _parts(row["text"], row["quoted"], row["depth"])


def _whole(batches: Iterator[pa.RecordBatch], objects: Objects) -> Iterator[pa.RecordBatch]:
    for _, (_, body, _) in _each(batches):
        yield pa.RecordBatch.from_arrays([pa.array(list(objects(body.decode("utf-8", "replace"))), pa.string())], ["t"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, (head, _, tail) in _each(batches):
        for key, text in ((row["begun"], head), (row["n"], tail)):
            if text:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (row["file"], key, row["n"], text.decode("utf-8", "replace"))], ["file", "key", "n", "text"])


def _joined(batches: Iterator[pa.RecordBatch], objects: Objects) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(list(objects(text.as_py())), pa.string())], ["t"])


def _states(kept: DataFrame) -> DataFrame:
    """How each chunk begins and ends; ``begun``: the chunk in which the value that it begins within began."""
    order = Window.partitionBy("file").orderBy("start", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lost = (F.col("size") - F.sum("bytes").over(Window.partitionBy("file"))).isin(1, 4)  # a reader passes over a mark of UTF-8, three bytes, at the beginning
    s = kept.drop("text").withColumn("n", F.row_number().over(order).cast("long"))
    s = s.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    own = lambda c: F.when(F.col("quoted") == 0, F.col(c + "0")).otherwise(F.col(c + "1"))
    s = s.withColumn("step", own("step")).withColumn("least", own("least")).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    shut = ((F.col("quoted") == 0) & (F.col("depth") <= 0)) | (F.col("depth") + F.col("least") <= 0)
    s = s.withColumn("begun", F.last(F.when(shut, F.col("n")), ignorenulls=True).over(before))
    over = (F.col("quoted") == 1) | (F.col("depth") > 0) | ((F.col("quoted") + F.col("quotes")) % 2 == 1) | (F.col("depth") + F.col("step") > 0)
    return s.select("file", "start", "number", "n", "quoted", "depth", "begun", over.alias("over"), ((F.col("size") >= 0) & lost).alias("lost"))


def _there(spark: SparkSession, folder: str) -> bool:
    fs, own = paths._hadoop(spark, folder)
    return fs.exists(own)


#: Copies of chunks: files as they were -> folder.
_kept: dict[tuple, str] = {}


def _copy(spark: SparkSession, files: list[paths.File], most: int) -> DataFrame:
    """The chunks of the files, in the shared folder; made once while names, sizes and times stay the same."""
    key = (spark.sparkContext.applicationId, most, *sorted((f.url, f.modified, f.size) for f in files))
    if key not in _kept or not _there(spark, _kept[key]):
        read = paths.between(spark, [f.url for f in files], "{")
        size = F.when(F.col("_metadata.file_name").rlike(paths.PACKED), -1).otherwise(F.col("_metadata.file_size"))
        rows = read.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), size.alias("size"), F.col("value").cast("binary").alias("value"))
        folder = paths.shared(spark, "chunks")
        rows.mapInArrow(lambda it: _chunks(it, most), _KIND).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)
        _kept[key] = folder
    return spark.read.schema(_KIND).parquet(_kept[key])


def records(spark: SparkSession, files: list[paths.File], objects: Objects, most: int = CHUNK) -> DataFrame:
    """Column ``t``: the texts of the objects in the files."""
    bounded(spark)
    kept = _copy(spark, files, most)
    known = kept.select("file", "start", "number", "text").join(F.broadcast(_states(kept)), ["file", "start", "number"]).drop("start", "number")
    whole = known.mapInArrow(lambda it: _whole(it, objects), "t string")
    ends = known.where("over").mapInArrow(_ends, "file long, key long, n long, text string").groupBy("file", "key")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "")
    return whole.union(ends.agg(text.alias("value")).select("value").mapInArrow(lambda it: _joined(it, objects), "t string"))
