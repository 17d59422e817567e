"""Ranks within few, large groups: no group is sorted by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, group: list[str], value: str, out: str = "k", width: int = 4096) -> DataFrame:
    """df with the rank (from 1) of each row in its group by ascending value, a long that no two rows of a group share.

    Rows are ranked within blocks of `width` values, and the counts of the blocks before are added: what meets in one
    window is a block's rows or a group's blocks."""
    blocked = df.withColumn("_block", F.floor(F.col(value) / width))
    counts = blocked.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*group, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(value))
    return blocked.withColumn("_own", own).join(counts, [*group, "_block"]).withColumn(out, F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")
