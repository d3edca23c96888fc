"""Paths: schemes, what is there, and files of what is behind web addresses.

An s3 path is a prefix of keys: where neither a file nor a folder has that very name,
all that begin with it are meant.
"""

from __future__ import annotations

import json
import re
import tempfile
import urllib.parse
import urllib.request
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.errors import QueryError

# The schemes of the language, and those of Hadoop file systems that work as files do.
FILES, WEB, EVENTS = ("file", "s3", "s3a", "hdfs", "viewfs", "abfs", "abfss", "gs"), ("http", "https"), ("kafka", "dummy")
USER_AGENT = "tarn/1.0"
#: Names of compressed files, whose sizes aren't those of their texts.
PACKED = r"\.(gz|bz2|zst|zstd|lz4|snappy|deflate)$"


@dataclass(frozen=True)
class Path:
    """scheme: files, web, kafka or dummy. spelled: as in the query. url: as Spark reads it."""

    scheme: str
    spelled: str
    url: str

    @classmethod
    def of(cls, text: str) -> Path:
        m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?=/)", text)
        scheme = m[1].lower() if m else None
        if scheme is None:
            return cls("files", text, text)
        if scheme in FILES:
            return cls("files", text, re.sub(r"^[sS]3:", "s3a:", text))
        if scheme in WEB:
            return cls("web", text, text)
        if scheme in EVENTS:
            return cls(scheme, text, text)
        raise QueryError(f"no file system for {scheme}:")


def _hadoop(spark: SparkSession, url: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shared(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only a local master without that setting has a temporary folder instead."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise QueryError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.gettempdir()
    path = f"{top.rstrip('/')}/tarn-{uuid.uuid4().hex}/{name}"
    fs, own = _hadoop(spark, path)
    fs.deleteOnExit(own.getParent())
    return path


def tops(spark: SparkSession, path: Path, prefix: bool | None = None) -> list:
    """The files and folders that the path means: itself, or (s3, ``prefix``) all whose names begin with it."""
    fs, top = _hadoop(spark, path.url)
    if fs.exists(top):
        return [fs.getFileStatus(top)]
    if prefix if prefix is not None else re.match(r"s3a?:", path.url):
        escaped = re.sub(r"([\\*?\[\]{}])", r"\\\1", path.url)
        return list(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(escaped + "*")) or [])
    return []


@dataclass(frozen=True)
class File:
    """below: what the path doesn't spell of the file's own; empty for the path itself."""

    below: str
    url: str
    modified: int
    size: int
    owner: str


def listing(spark: SparkSession, path: Path, prefix: bool | None = None) -> list[File]:
    """Each file, all levels, sorted; nothing if nothing is there."""
    fs, top = _hadoop(spark, path.url)
    out = []
    for status in tops(spark, path, prefix):
        base = len(fs.makeQualified(top).toUri().getPath().rstrip("/"))
        if status.isFile():
            found = [status]
        else:
            files, found = fs.listFiles(status.getPath(), True), []
            while files.hasNext():
                found.append(files.next())
        for f in found:
            below = f.getPath().toUri().getPath()[base:]
            out.append(File(below, f.getPath().toString(), f.getModificationTime(), f.getLen(), f.getOwner()))
    return sorted(out, key=lambda f: f.below)


def same(url: str) -> str:
    """A URL in one of the spellings that Hadoop and Spark have for it."""
    return urllib.parse.unquote(re.sub(r"^([a-z0-9]+):/+", r"\1:/", url))


def exists(spark: SparkSession, path: Path) -> bool:
    return bool(tops(spark, path))


def fetched(spark: SparkSession, url: str) -> Path:
    """A file, in the shared folder, of what a web address answers. Copied piece by piece."""

    name = urllib.parse.urlsplit(url).path.rpartition("/")[2] or "answer"
    path = shared(spark, re.sub(r"[^A-Za-z0-9.-]|^[.-]", "x", name))
    fs, own = _hadoop(spark, path)
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": USER_AGENT}), timeout=60) as answer:
        out = fs.create(own, True)
        try:
            while part := answer.read(1 << 20):
                out.write(bytearray(part))
        finally:
            out.close()
    return Path("files", url, path)


def _reader(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", True).option("ignoreMissingFiles", True)


def whole_texts(spark: SparkSession, path: Path, only: list[str] | None = None) -> DataFrame:
    """Column ``value``: the text of each file (of those whose URLs are in ``only``). Empty if nothing is there."""
    if path.scheme != "files":
        raise QueryError(f"{path.spelled} can't be read as files")
    files = _hidden_too(spark, path) if only is None else only
    if not files:
        return spark.createDataFrame([], "value string")
    return _reader(spark).text(files, wholetext=True).select("value")


def lines(spark: SparkSession, path: Path, only: list[str] | None = None, longest: int | None = None) -> DataFrame:
    """Column ``value``: the lines of all files, split within large ones; ``_metadata`` says which file. Lines of ``longest`` bytes or more are passed over."""
    files = _hidden_too(spark, path) if only is None else only
    return (_reader(spark).option("mapreduce.input.linerecordreader.line.maxlength", longest) if longest else _reader(spark)).text(files)


def between(spark: SparkSession, files: list[str], mark: str) -> DataFrame:
    """Column ``value``: what lies between the marks in the files, split within large ones; ``_metadata`` as for lines."""
    return _reader(spark).option("lineSep", mark).text(files)


def _hidden_too(spark: SparkSession, path: Path):
    """The path, or all files below if some have names that Spark passes over."""
    above = tops(spark, path)
    if not above:
        return []
    files = listing(spark, path)
    if any(re.search(r"(^|/)[_.]", f.below) and not f.below.endswith(".crc") for f in files):
        return [f.url for f in files if not f.below.endswith(".crc")]
    return [t.getPath().toString() for t in above]


def kafka_options(spelled: str) -> dict[str, str]:
    """The connector's options for kafka://host[:port]/topic[:partition]: all that is there now, from the beginning."""
    m = re.fullmatch(r"kafka://([^/:]+)(?::(\d+))?/([^/:]+)(?::(\d+))?", spelled)
    if not m:
        raise QueryError(f"{spelled} is not kafka://host[:port]/topic[:partition]")
    host, port, topic, partition = m.groups()
    options = {"kafka.bootstrap.servers": f"{host}:{port or 9092}"}
    if partition is None:
        return options | {"subscribe": topic, "startingOffsets": "earliest", "endingOffsets": "latest"}
    first, last = -2, -1  # the connector's numbers for these
    offsets = lambda n: json.dumps({topic: {partition: n}})
    return options | {"assign": json.dumps({topic: [int(partition)]}), "startingOffsets": offsets(first), "endingOffsets": offsets(last)}


def kafka(spark: SparkSession, path: Path) -> DataFrame:
    """Column ``value``: the messages that a topic holds now. Needs Spark's Kafka connector."""
    read = spark.read.format("kafka").options(**kafka_options(path.spelled))
    return read.load().where("value is not null").select(F.col("value").cast("string").alias("value"))
