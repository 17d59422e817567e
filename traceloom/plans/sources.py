"""Round trips of the text formats: tables are written by the sinks and read again by the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.errors import both_distances
from ..sources import scans
from ..sources.fixture import VIEWS, cluster_keys, clusters, ground_truth, reads
from ._register import query


def _folder(spark) -> str:
    return scans.shared_folder(spark, "formats")


@query("s1_s3_k1_cluster_files", f"{VIEWS}, g AS (SELECT gt_id, gt, row_number() OVER (ORDER BY gt_id) - 1 AS idx FROM gt) SELECT idx, any_value(g.gt) AS gt, count(cluster_id) AS n, coalesce(string_agg(read, '|' ORDER BY read_no), '') AS reads FROM g LEFT JOIN rd ON cluster_id = gt_id GROUP BY idx")
def s1(spark, sf):
    """Written in order of gt_id, empty clusters included; read with the place in the file as identity."""
    folder = _folder(spark)
    keys, texts, gt = cluster_keys(spark, sf)
    scans.write_clusters(keys, folder, texts, gt, keys.rdd.getNumPartitions())
    both = scans.with_ground_truth(scans.cluster_file(spark, f"{folder}/reads"), scans.lines(spark, f"{folder}/ground_truth", across=True))
    return both.select("idx", "gt", F.size("reads").cast("long").alias("n"), F.array_join("reads", "|").alias("reads"))


@query("s4_k3_fastq", f"{VIEWS} SELECT concat('r', cast(cluster_id AS varchar), '_', cast(read_no AS varchar)) AS read_id, read AS seq, repeat('I', length(read)) AS qual FROM rd")
def s4(spark, sf):
    path = _folder(spark)
    records = reads(spark, sf).select(F.concat(F.lit("r"), F.col("cluster_id").cast("string"), F.lit("_"), F.col("read_no").cast("string")).alias("read_id"), F.col("read").alias("seq"), F.repeat(F.lit("I"), F.length("read")).alias("qual"))
    scans.write_fastq(records, path, gzip=True)
    return scans.fastq(spark, path)


@query("s5_k4_fasta", f"{VIEWS} SELECT cast(gt_id AS varchar) AS id, gt AS seq FROM gt")
def s5(spark, sf):
    path = _folder(spark)
    scans.write_fasta(ground_truth(spark, sf).select(F.col("gt_id").cast("string").alias("id"), F.concat(F.substring("gt", 1, 60), F.lit("\n"), F.substring("gt", 61, 60)).alias("seq")), path)
    return scans.fasta(spark, path).select("id", "seq")


@query("k4_fasta_append", f"{VIEWS} SELECT cast(gt_id AS varchar) AS id, gt AS seq FROM gt UNION ALL SELECT concat('again_', cast(gt_id AS varchar)), reverse(gt) FROM gt WHERE gt_id % 3 = 0")
def k4(spark, sf):
    """Records added to a folder that has some already."""
    path = _folder(spark)
    g = ground_truth(spark, sf).select(F.col("gt_id").cast("string").alias("id"), F.col("gt").alias("seq"))
    scans.write_fasta(g, path)
    scans.write_fasta(g.where("id % 3 = 0").select(F.concat(F.lit("again_"), "id").alias("id"), F.reverse("seq").alias("seq")), path, append=True)
    return scans.fasta(spark, path).select("id", "seq")


@query("s6_k2_packed_examples", f"{VIEWS} SELECT rd.gt AS gt, string_agg(read, '|' ORDER BY read_no) AS reads FROM rd GROUP BY cluster_id, rd.gt")
def s6(spark, sf):
    from ..functions.sequence import pack

    path = _folder(spark)
    clusters(spark, sf).select(pack(F.col("reads"), F.col("gt"))).write.text(path)
    return scans.packed_examples(spark, path).select("gt", F.array_join("reads", "|").alias("reads"))


@query("s9_k8_prediction_tsv", f"{VIEWS}, t AS (SELECT cluster_id, count(*) AS n, string_agg(read, '|' ORDER BY read_no) AS traces FROM rd GROUP BY cluster_id) SELECT n AS cluster_size, gt AS ground_truth, read AS prediction, cast(list_sum(list_transform(range(1, length(gt) + 1), lambda i: (substr(gt, cast(i AS int), 1) <> substr(read, cast(i AS int), 1))::int)) AS bigint) AS ham_distance, levenshtein(gt, read) AS lev_distance, length(gt) AS sequence_length, traces AS noisy_traces FROM rd JOIN t USING (cluster_id)")
def s9(spark, sf):
    """Each line repeats the traces of its cluster, so the lines are written compressed: they take a thirtieth of the disk."""
    path = _folder(spark)
    r = reads(spark, sf)
    traces = clusters(spark, sf).select("cluster_id", F.size("reads").cast("long").alias("cluster_size"), F.array_join("reads", "|").alias("noisy_traces"))
    rows = both_distances(r.join(traces, "cluster_id").select("cluster_size", "gt", "read", "noisy_traces"), "gt", "read")
    rows = rows.select("cluster_size", F.col("gt").alias("ground_truth"), F.col("read").alias("prediction"), F.col("ham").alias("ham_distance"), F.col("lev").alias("lev_distance"), F.length("gt").alias("sequence_length"), "noisy_traces")
    rows.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    schema = "cluster_size long, ground_truth string, prediction string, ham_distance long, lev_distance long, sequence_length long, noisy_traces string"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


@query("s2_line_sequence", f"{VIEWS} SELECT row_number() OVER (ORDER BY gt_id) - 1 AS idx, gt AS value FROM gt")
def s2(spark, sf):
    """Lines with their places, from files written in order of gt_id."""
    path = _folder(spark)
    scans.in_order(ground_truth(spark, sf), "gt_id", "gt", path)
    return scans.lines(spark, path, across=True).select("idx", "value")


@query("k2_split_files", f"{VIEWS}, c AS (SELECT cluster_id, rd.gt AS gt, string_agg(read, '|' ORDER BY read_no) AS reads FROM rd GROUP BY cluster_id, rd.gt) SELECT CASE WHEN cluster_id % 10 = 0 THEN 'test' WHEN cluster_id % 10 = 1 THEN 'val' ELSE 'train' END AS split, gt, reads FROM c")
def k2(spark, sf):
    """Example files in a folder for each split, read back with the split."""
    from ..functions.sequence import pack

    path, m = _folder(spark), F.col("cluster_id") % 10
    split = F.when(m == 0, "test").when(m == 1, "val").otherwise("train")
    clusters(spark, sf).select(pack(F.col("reads"), F.col("gt")).alias("value"), split.alias("split")).write.partitionBy("split").text(path)
    return scans.packed_examples(spark, path, by="split").select("split", "gt", F.array_join("reads", "|").alias("reads"))
