"""Arriving reads are sorted out as those of a table, in several batches and after a restart."""

from pyspark.sql import functions as F

from traceloom.operators.joins import primers
from traceloom.plans import demux
from traceloom.streaming.arrivals import follow, sorted_out

SF = "/root/testdata/sf0.001"


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    reads = demux._reads(spark, SF).select(F.concat_ws("_", "cluster_id", "read_no").alias("read_id"), "s", "qual").where("hash(read_id) % 10 = 0")
    paths = [f"file://{tmp_path}/{x}" for x in ("in", "out", "check")]
    halves = [reads.where(f"abs(hash(read_id)) % 20 {op} 10") for op in ("<", ">=")]
    for half in halves:
        half.repartition(3).write.mode("append").parquet(paths[0])
        follow(spark, paths[0], primers(spark), paths[1], paths[2]).awaitTermination()
    got = spark.read.parquet(paths[1]).select("read_id", "status", F.col("exp").cast("long"), "payload", "payload_qual")
    want = sorted_out(reads, primers(spark))
    assert got.count() == want.count() > 300
    assert got.exceptAll(want).count() == 0 and {r[0] for r in got.select("status").distinct().collect()} >= {"mapped"}


def test_clusters_of_arriving_reads_are_those_of_a_table(spark, tmp_path):
    from traceloom.operators.joins import approximate_hits, best_match, index_clusters
    from traceloom.plans.clustering import _marked
    from traceloom.sources.fixture import ground_truth
    from traceloom.streaming import clustering as C

    reads = _marked(spark, SF).select(F.col("cluster_id").cast("long"), F.col("read_no").cast("int"), "s")
    truths = ground_truth(spark, SF)
    valid = spark.range(0, 16384, 2).withColumnRenamed("id", "v")
    path = lambda x: f"file://{tmp_path}/{x}"
    decisions = {
        "prefix": lambda r: C.by_prefix(r, truths, 20),
        "index": lambda r: index_clusters(r, valid, [(40, 56, 1)]).drop("start", "end", "most"),
        "near": lambda r: best_match(r, approximate_hits(r, truths, 30, 2)),
    }
    for half in (reads.where("cluster_id % 2 = 0"), reads.where("cluster_id % 2 = 1")):
        half.repartition(3).write.mode("append").parquet(path("in"))
        for name, decide in decisions.items():  # started anew: each goes on from its checkpoint
            C.follow(C.arriving(spark, path("in"), files=2), decide, path(name), path(f"{name}_check")).awaitTermination()
        C.follow_sizes(C.by_prefix(C.arriving(spark, path("in"), files=2), truths, 20), path("sizes"), path("sizes_check")).awaitTermination()
    for name, decide in decisions.items():
        got, want = spark.read.parquet(path(name)).drop("batch"), decide(reads)
        assert got.columns == want.columns and got.count() == want.count() > 300
        assert got.exceptAll(want).count() == 0
    want = C.by_prefix(reads, truths, 20).groupBy("gt_id").agg(F.count("*").alias("n"))
    got = C.sizes(spark, path("sizes"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert spark.read.parquet(path("prefix")).select("batch").distinct().count() == 4
