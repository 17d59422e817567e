"""Contaminated clusters: grids of conditions, and foreign reads put in the place of a cluster's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import seeded
from .selection import starts


def condition_grid(clusters: DataFrame, heads: dict[int, str], seed: str = "c") -> DataFrame:
    """A row for each cluster and condition, with `hit` where the cluster is contaminated in it: the two-digit
    head of its hash is below the condition's. The conditions are a parameter table of a few rows."""
    rates = clusters.sparkSession.createDataFrame(list(heads.items()), "pct int, head string")
    grid = clusters.crossJoin(F.broadcast(rates))
    return grid.withColumn("hit", F.substring(seeded(seed, F.col("pct"), F.col("cluster_id")), 1, 2) < F.col("head")).drop("head")


def substitute(reads: DataFrame, seed: str, head: str) -> DataFrame:
    """reads with `donor`: where the read's hash is below `head`, a read of another cluster, any with one chance, else null.

    All reads are numbered, a cluster's in a row. A hashed number below that of the reads outside the cluster, moved past
    the cluster's own, is the donor's: an equi-join on numbers that hashes spread evenly. A read lacks a donor only
    where there is no other cluster."""
    clusters = starts(reads.groupBy("cluster_id").agg(F.count("*").alias("_n")), "cluster_id", "_n", "_start")
    total = reads.agg(F.count("*").alias("_total"))  # one row
    at = F.col("_start") + F.row_number().over(Window.partitionBy("cluster_id").orderBy("read_no")) - 1
    numbered = reads.join(clusters, "cluster_id").withColumn("_at", at)
    place = F.conv(F.substring(seeded("donor", F.col("cluster_id"), F.col("read_no")), 1, 15), 16, 10).cast("long") % F.col("_others")
    swap = (F.substring(seeded(seed, F.col("cluster_id"), F.col("read_no")), 1, 2) < head) & (F.col("_others") > 0)
    asking = numbered.crossJoin(F.broadcast(total)).withColumn("_others", F.col("_total") - F.col("_n")).withColumn("_place", F.when(swap, place))
    asking = asking.withColumn("_from", F.col("_place") + F.when(F.col("_place") >= F.col("_start"), F.col("_n")).otherwise(0))
    donors = numbered.select(F.col("_at").alias("_from"), F.col("read").alias("donor"))
    # Reads that ask for none have no number to join by, and needn't be shuffled to one place.
    kept = asking.where("_from is null").select(*reads.columns, F.lit(None).cast("string").alias("donor"))
    return asking.where("_from is not null").join(donors, "_from").select(*reads.columns, "donor").unionByName(kept)
