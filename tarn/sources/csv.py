"""CSV: a header in each file, ``\\`` as escape, ``\\N`` as null, all values strings.

Each file's columns go by its own header, whatever their order. Quoted values may
hold line breaks, so a file of up to ``LARGE`` bytes is read as a whole by one task.
Larger files are looked through first: those in which no line ends inside a value
(which line breaks in quotes or after an escape would do) are split among tasks and
read by lines, the others still as a whole.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources import paths
from tarn.sources.paths import Path

NULL = r"\N"
#: An unescaped null token that fills a cell: the escape would otherwise be taken off.
_BARE = re.compile(r"(^|,)\\N(?=,|\r?$)", re.M)


def parse(text: str) -> Iterator[dict[str, str | None]]:
    """The records of one file, keys in lower case."""
    prepared = _BARE.sub(lambda m: m[1] + r"\\N", _BARE.sub(lambda m: m[1] + r"\\N", text))
    rows = csv.reader(io.StringIO(prepared, newline=""), escapechar="\\")
    header = [h.lower() for h in next(rows, [])]
    for row in rows:
        if row:
            yield {h: None if x == NULL else x for h, x in zip(header, row, strict=False)}


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text in batch["value"]:
            out = []
            for r in parse(text or ""):
                out.append(r)
                if len(out) == 10_000:
                    yield _frame(out)
                    out = []
            yield _frame(out)


def _frame(records: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({"k": [list(r) for r in records], "v": [list(r.values()) for r in records]}, dtype=object)


LARGE = 64 << 20


def _header(spark: SparkSession, file: paths.File) -> str:
    """The first line of a file."""
    fs, own = paths._hadoop(spark, file.url)
    data = fs.open(own)
    try:
        return (data.readLine() or "").encode("latin-1").decode("utf-8", "replace")  # a character a byte
    finally:
        data.close()


def _open_lines(spark: SparkSession, path: Path, urls: list[str]) -> set[str]:
    """Of the files those with a line that ends inside a value."""
    bare = F.regexp_replace("value", r"\\[\s\S]", "")
    inside = (F.length(F.regexp_replace(bare, '[^"]', "")) % 2 == 1) | bare.endswith("\\")
    got = paths.lines(spark, path, urls).select(F.col("_metadata.file_path").alias("file"), "value").where(inside).select("file").distinct().collect()
    return {r.file for r in got}


def _split_lines(batches: Iterator[pd.DataFrame], headers: dict[str, str]) -> Iterator[pd.DataFrame]:
    begun = set()
    for batch in batches:
        for (file, start), own in batch.groupby(["file", "start"], sort=False):
            lines = own["value"].tolist()
            if start == 0 and file not in begun:
                begun.add(file)
                lines = lines[1:]  # the header itself
            yield _frame(list(parse("\n".join([headers[paths.same(file)], *lines]))))


def read(spark: SparkSession, path: Path, large: int | None = None) -> DataFrame:
    """Column ``m``: a map of each record's values."""
    if path.scheme == "web":
        path = paths.fetched(spark, path.url)
    kind = "k array<string>, v array<string>"
    files = [f for f in paths.listing(spark, path) if not f.below.endswith(".crc")] if path.scheme == "files" else []
    big = {paths.same(f.url): f for f in files if f.size > (LARGE if large is None else large) and not re.search(r"\.(gz|gzip)$", f.url)}
    rows = None
    if big:
        for url in _open_lines(spark, path, [f.url for f in big.values()]):
            big.pop(paths.same(url), None)
    if big:
        texts = paths.lines(spark, path, [f.url for f in big.values()]).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        headers = {u: _header(spark, f) for u, f in big.items()}
        rows = texts.mapInPandas(lambda it: _split_lines(it, headers), kind)
        rest = [f.url for f in files if paths.same(f.url) not in big]
        if rest:
            rows = rows.union(paths.whole_texts(spark, path, rest).mapInPandas(_records, kind))
    else:
        rows = paths.whole_texts(spark, path).mapInPandas(_records, kind)
    return rows.select(F.map_from_arrays("k", "v").alias("m"))


def _cell(x: str | None) -> str:
    if x is None:
        return r"\\N"
    x = x.replace("\\", "\\\\")
    return '"' + x.replace('"', '\\"') + '"' if re.search(r'[",\r\n]|^\s|\s$|^$', x) else x


def line(cells: list[str | None]) -> str:
    """A line that ``parse`` reads back."""
    return ",".join(map(_cell, cells))
