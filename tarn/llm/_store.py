"""Intermediate tables that survive the loss of executors."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch, which both sides of a Python worker hold several of.
BATCH_BYTES = 4 << 20


#: Size of a broadcast's blocks. Each stage's code is one or more broadcasts, and the driver takes a block's buffer for
#: each: of Spark's 4 MB, G1 counts every one as a humongous object, collects for it and lets the heap grow.
BROADCAST_BLOCK = "256k"


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES from now on, unless the session's are smaller: rows may be long. Small broadcast blocks, unless their size is set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D+$", "", spark.conf.get(key))) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    spark.sparkContext._jsc.sc().conf().setIfMissing("spark.broadcast.blockSize", BROADCAST_BLOCK)


def folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Only a local master, as in tests, gets one made where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = sc.getConf().get("spark.checkpoint.dir")
        if own is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="tarn-checkpoint-")
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


#: Runtime setting, read when a DataFrame is made: the end of its execution deletes its shuffles' files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it from there.

    Its shuffles are deleted as soon as the copy is written. Where the cluster doesn't say
    otherwise, Spark deletes the copy when no DataFrame refers to it any more.
    """
    spark = df.sparkSession
    bounded(spark)
    folder(spark)
    conf = spark.sparkContext._jsc.sc().conf()
    conf.setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    _tidy(spark)
    return out


#: Seconds between two calls for the driver's garbage, and when the last was.
TIDY_SECONDS = 10
_tidied = [0.0]


def _tidy(spark: SparkSession) -> None:
    """Spark deletes copies, and other shuffles than those of cut, once the driver's collector has found them unused, which a heap with room may put off for long."""
    if time.monotonic() - _tidied[0] > TIDY_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _tidied[0] = time.monotonic()


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the application ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as compressed Parquet to the shared folder, and read from there."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark, sf_dir: str, *columns: str, table: str = "documents") -> DataFrame:
    """The named columns of a table of the data directory."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
