"""How attention spreads over the reads of an example, token by token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .consensus import Derived, _begins, _keys, _streamed, whole_clusters


def token_concentration(weights: DataFrame, threshold: float = 0.9) -> DataFrame:
    """weights: example, token, read_no, weight (the sum over a read's symbols). For each token: reads, how many of the heaviest reads
    give `threshold` of all weight, the largest share and the entropy of shares. A token without weight has shares of 0."""
    by = Window.partitionBy("example", "token")
    total = F.sum("weight").over(by)
    shares = weights.withColumn("share", F.when(total > 0, F.col("weight") / total).otherwise(0.0))
    reached = F.sum("share").over(by.orderBy(F.desc("share"), "read_no").rowsBetween(Window.unboundedPreceding, -1))
    # A read counts while those before it don't reach the threshold.
    used = shares.withColumn("used", (F.coalesce(reached, F.lit(0.0)) < threshold).cast("int"))
    entropy = F.sum(F.when(F.col("share") > 0, -F.col("share") * F.log(F.col("share") + 1e-10)).otherwise(0.0))
    return used.groupBy("example", "token").agg(F.count("*").alias("reads"), F.sum("used").alias("reads_90"), F.max("share").alias("concentration"), entropy.alias("entropy"))


def example_concentration(weights: DataFrame, threshold: float = 0.9) -> DataFrame:
    """example, reads, tokens and the means over its tokens of `token_concentration`; normalized: reads needed over reads there are;
    consistency: 1 less the mean over reads of their share's spread (population) across tokens."""
    tokens = token_concentration(weights, threshold)
    means = tokens.groupBy("example").agg(F.max("reads").alias("reads"), F.count("*").alias("tokens"), F.avg("reads_90").alias("reads_90"), F.avg("concentration").alias("concentration"), F.avg("entropy").alias("entropy"))
    total = F.sum("weight").over(Window.partitionBy("example", "token"))
    spread = weights.withColumn("share", F.when(total > 0, F.col("weight") / total).otherwise(0.0)).groupBy("example", "read_no").agg(F.stddev_pop("share").alias("s"))
    steady = spread.groupBy("example").agg((1 - F.avg("s")).alias("consistency"))
    return means.join(steady, "example").withColumn("normalized", F.col("reads_90") / F.col("reads"))


def cluster_concentration(reads: Derived, threshold: float = 0.9, key: str = "cluster_id") -> DataFrame:
    """`example_concentration` of reads (key, read_no, weights: an array of one weight a token) whose clusters are the examples. Clusters stream
    by, so that no weight of a token becomes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of in whole_clusters(batches):
            begins = _begins(of)
            n, rows = np.diff(begins), of.num_rows
            weight = of.column(2).combine_chunks().flatten().to_numpy().reshape(rows, -1)
            cluster, tokens = np.repeat(np.arange(len(n)), n), weight.shape[1]
            total = np.add.reduceat(weight, begins[:-1], axis=0)[cluster]
            share = np.where(total > 0, weight / np.where(total > 0, total, 1), 0)
            # Each token's shares from the greatest down; a read counts while those before it don't reach the threshold.
            order = np.stack([np.lexsort((np.arange(rows), -share[:, t], cluster)) for t in range(tokens)], axis=1)
            down, reached, used = np.take_along_axis(share, order, axis=0), np.zeros((len(n), tokens)), np.zeros((len(n), tokens))
            for k in range(int(n.max())):
                c = np.flatnonzero(n > k)
                used[c] += reached[c] < threshold
                reached[c] += down[begins[c] + k]
            entropy = np.add.reduceat(np.where(share > 0, -share * np.log(share + 1e-10), 0), begins[:-1], axis=0)
            top = np.maximum.reduceat(share, begins[:-1], axis=0)
            steady = 1 - np.add.reduceat(share.std(axis=1), begins[:-1]) / n
            needed = used.mean(axis=1)
            yield pa.RecordBatch.from_arrays([_keys(of, begins[:-1]), pa.array(n), pa.array(np.full(len(n), tokens)), *map(pa.array, (needed, top.mean(axis=1), entropy.mean(axis=1), steady, needed / n))], [key, "reads", "tokens", "reads_90", "concentration", "entropy", "consistency", "normalized"])

    def plain(r: DataFrame) -> DataFrame:
        each = r.select(F.col(key).alias("example"), "read_no", F.posexplode("weights").alias("token", "weight"))
        return example_concentration(each, threshold).select(F.col("example").alias(key), "reads", "tokens", "reads_90", "concentration", "entropy", "consistency", "normalized")

    return _streamed(reads, key, run, "reads long, tokens long, reads_90 double, concentration double, entropy double, consistency double, normalized double", plain)
