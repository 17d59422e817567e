"""Sub-clusters of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import fraction, seeded


def sub_clusters(clusters: DataFrame, most: int = 10, seed: str = "sub") -> DataFrame:
    """cluster_id, piece, reads, gt. Reads are shuffled; a cluster of up to `most` reads stays whole; a larger one is
    cut into consecutive pieces of 2 to min(most, left) reads, and one read left over is dropped. The cuts are a
    fold over the array, so no cluster leaves its row."""
    order = F.array_sort(F.transform("reads", lambda r, i: F.struct(seeded(seed, F.col("cluster_id"), i).alias("k"), r.alias("r"))))
    shuffled = clusters.withColumn("reads", F.transform(order, lambda x: x["r"]))
    n = F.size("reads")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,len:int>>").alias("cuts"))

    def step(s, i):
        left = n - s["at"]
        upto = F.least(F.lit(most), left)
        size = F.when(n <= most, n).otherwise(F.least(upto, (2 + F.floor(fraction(seed, F.col("cluster_id"), F.lit("c"), i) * (upto - 1))).cast("int"))).cast("int")
        go = (left >= 2) | ((n <= most) & (s["at"] == 0))
        return F.struct(F.when(go, s["at"] + size).otherwise(s["at"]).cast("int").alias("at"), F.when(go, F.concat(s["cuts"], F.array(F.struct(s["at"].cast("int").alias("at"), size.alias("len"))))).otherwise(s["cuts"]).alias("cuts"))

    cuts = F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), start, step, lambda s: s["cuts"])
    pieces = shuffled.select("cluster_id", "gt", "reads", F.posexplode(cuts).alias("piece", "cut"))
    return pieces.select("cluster_id", "piece", F.slice("reads", F.col("cut.at") + 1, F.col("cut.len")).alias("reads"), "gt")
