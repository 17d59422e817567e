"""Batches of rows of like length, laid out so that later jobs read them without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import rank_within


def length_batches(df: DataFrame, length: str, key: str, rows: int = 512) -> DataFrame:
    """df with `place`, the rank (from 0) by length and then key, and `batch`, place div rows: a batch holds rows of like length, so
    little of it is padding. key: a long that no two rows of a length share.

    Places are ranks within the length, taken in blocks of keys, plus the counts of shorter rows; only these counts, one for each
    length, meet in one place. Rows of a null length come first; an empty table gives an empty result."""
    counts = df.groupBy(F.col(length).alias("_length")).agg(F.count("*").alias("_rows"))
    shorter = F.sum("_rows").over(Window.orderBy(F.asc_nulls_first("_length")).rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.coalesce("_length", F.lit(-1)).alias("_length"), F.coalesce(shorter, F.lit(0)).alias("_shorter"))
    ranked = rank_within(df.withColumn("_length", F.coalesce(length, F.lit(-1))), ["_length"], key, "_rank")
    placed = ranked.join(before, "_length").withColumn("place", F.col("_shorter") + F.col("_rank") - 1)
    return placed.withColumn("batch", F.expr(f"place div {rows}")).drop("_length", "_shorter", "_rank")


def write_batches(df: DataFrame, path: str, buckets: int) -> DataFrame:
    """df (batch, place, ...) written as a table in `buckets` buckets of batches, one file each, in order of place. What comes back reads it:
    grouping by batch, or joining with another table of as many buckets by batch, needs no exchange."""
    name = f"traceloom_batches_{uuid.uuid4().hex}"
    df.repartition(buckets, "batch").write.bucketBy(buckets, "batch").sortBy("batch", "place").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
