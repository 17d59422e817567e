"""Demultiplexing of reads that keep arriving as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.demux import demultiplex, outcome, payload

SCHEMA = "read_id string, s string, qual string"


def arriving(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Reads (read_id, s, qual) of the Parquet files that come into a folder, `files` of them a batch at most."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def sorted_out(reads: DataFrame, primers: DataFrame) -> DataFrame:
    """read_id, status, exp, payload, payload_qual: each read is decided by itself, so batches and lost tasks change nothing."""
    found = payload(demultiplex(reads, primers), qual="qual")
    return found.withColumn("status", outcome()).select("read_id", "status", "exp", "payload", "payload_qual")


def follow(spark: SparkSession, folder: str, primers: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write what becomes of arriving reads as Parquet, a folder for each experiment (none: not found). A restart goes on from the
    checkpoint and writes no read twice."""
    rows = sorted_out(arriving(spark, folder), primers).withColumn("exp", F.col("exp").cast("int"))
    writer = rows.writeStream.format("parquet").partitionBy("exp").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(target)
