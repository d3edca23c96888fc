"""Directory listings as tables: one row for each file."""

from __future__ import annotations

import datetime as dt
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession

from tarn.errors import QueryError
from tarn.sources import paths
from tarn.sources.paths import Path

_FILE = "path string, name string, parent string, extension string, last_modified string, size long"
_OBJECT = "path string, bucket string, key string, owner string, storage_class string, last_modified string, size long"


def read(spark: SparkSession, path: Path) -> DataFrame:
    """Files: path, name, parent, extension, last_modified, size; s3 has bucket and key instead of the names."""
    if path.scheme == "web":
        return spark.createDataFrame([(path.spelled,)], "path string")
    if path.scheme == "kafka":
        topic, _, partition = path.spelled.rpartition("/")[2].partition(":")
        return spark.createDataFrame([(path.spelled, topic, partition or None)], "path string, topic string, partition string")
    if path.scheme != "files":
        raise QueryError(f"{path.spelled} can't be listed")
    s3 = re.match(r"s3a?://([^/]+)/?", path.spelled)
    rows = []
    for f in paths.listing(spark, path):
        full = path.spelled.rstrip("/") + f.below if f.below else path.spelled
        when = dt.datetime.fromtimestamp(f.modified / 1000, dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        if s3:  # the connector says whose a key is, but not its storage class
            rows.append((full, s3[1], full[s3.end() :], f.owner or None, None, when, f.size))
        else:
            parent, name = posixpath.split(full)
            rows.append((full, name, parent, name.rpartition(".")[2] if "." in name else "", when, f.size))
    return spark.createDataFrame(rows, _OBJECT if s3 else _FILE)
