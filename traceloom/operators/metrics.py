"""Reconstruction metrics and error statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import hamming
from .errors import edit_distance


def scored(pred: DataFrame) -> DataFrame:
    """n, gt, consensus with ham, lev, their shares of the length, and success. A missing consensus fails with shares of 1."""
    size = F.length("gt")
    ham, lev = hamming(F.col("gt"), F.col("consensus")), F.col("_lev")
    return edit_distance(pred, "gt", "consensus", "_lev").select(*pred.columns, F.coalesce(ham / size, F.lit(1.0)).alias("ham"), F.coalesce(lev / size, F.lit(1.0)).alias("lev"), F.coalesce(ham == 0, F.lit(False)).alias("success"))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def by_size(s: DataFrame) -> DataFrame:
    """Count, success rate and distances by cluster size n, and over all (n null)."""
    share = F.avg(F.col("success").cast("int").cast("double"))
    out = [F.count("*").alias("clusters"), r6(share).alias("success_rate"), r6(1 - share).alias("failure_rate")]
    for c in ("ham", "lev"):
        out += [r6(F.avg(c)).alias(f"{c}_mean"), r6(F.stddev_pop(c)).alias(f"{c}_std"), r6(F.min(c)).alias(f"{c}_min"), r6(F.max(c)).alias(f"{c}_max")]
    return s.rollup("n").agg(*out)
