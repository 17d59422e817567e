"""Tables in the shared folder: the only way these operators cut lineage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets one of its own; on a cluster
    that is an error, as executors don't share local folders."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="traceloom-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/traceloom/{spark.sparkContext.applicationId}"


#: While a table is written, its shuffle files go as soon as it ends, since nothing reads them again, and Arrow
#: batches are small, as the rows hold whole texts.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def table(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a reader of it, so that a lost
    executor costs a reread and never a recomputation of what came before."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable) -> Callable:
    """run over a partition's batches, after which the worker, which lives on, gives the memory it no longer uses back."""

    def done(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return done


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has written. Results that aren't written yet need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(rows: float, each: float, least: int = 1) -> int:
    """How many groups hold `rows` at about `each` a group."""
    return int(max(least, -(-rows // each)))
