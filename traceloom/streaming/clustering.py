"""Clustering of reads that keep arriving: assignments of each batch, and running cluster sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "cluster_id long, read_no int, s string"


def arriving(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Reads (cluster_id, read_no, s) of the Parquet files that come into a folder, `files` of them a batch at most."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def by_prefix(reads: DataFrame, truths: DataFrame, k: int) -> DataFrame:
    """cluster_id, read_no, gt_id: reads that begin with a ground truth's k-prefix. Reads may be a stream, truths are a table."""
    prefixes = truths.select("gt_id", F.substring("gt", 1, k).alias("prefix"))
    return reads.withColumn("prefix", F.substring("s", 1, k)).join(prefixes, "prefix").select("cluster_id", "read_no", "gt_id")


def follow(reads: DataFrame, decide: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write decide(batch) for each batch of arriving reads to its own folder under target. decide may be any operator that decides a
    read by itself (joins with tables, searches, demultiplexing). A batch that is run again after a loss
    overwrites its folder, so every read is written once."""

    def write(batch: DataFrame, no: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{target}/batch={no}")

    writer = reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def follow_sizes(assigned: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep counts of the reads of each gt_id as state; a batch writes the counts that it changed to its own folder."""

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={no}")

    sizes = assigned.groupBy("gt_id").agg(F.count("*").alias("n"))
    writer = sizes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sizes(spark: SparkSession, target: str) -> DataFrame:
    """gt_id, n: the latest count of each, which is the greatest, as counts only grow."""
    return spark.read.parquet(target).groupBy("gt_id").agg(F.max("n").alias("n"))
