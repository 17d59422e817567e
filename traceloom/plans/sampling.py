"""Splits, samples and shuffles ordered by md5 keys (P*), windows and top-k (W*, T*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sequence import seeded
from ..operators.errors import edit_distance
from ..operators.layout import length_batches, write_batches
from ..operators.metrics import r6
from ..operators.ranks import rank_within
from ..operators.selection import cut
from ..sources.fixture import VIEWS, clusters, ground_truth, reads, table
from ..sources.scans import kept, shared_folder
from ._register import query


def _sizes(spark, sf):
    return reads(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n"))


_SZ = f"{VIEWS}, sz AS (SELECT cluster_id, count(*) AS n FROM rd GROUP BY ALL)"


@query("p1_cluster_split", f"{_SZ}, r AS (SELECT cluster_id, row_number() OVER (ORDER BY md5(concat('split:', cast(cluster_id AS varchar)))) - 1 AS r, count(*) OVER () AS m FROM sz) SELECT cluster_id, CASE WHEN r < cast(floor(m * 0.8::double) AS bigint) THEN 'train' WHEN r < cast(floor(m * 0.8::double) AS bigint) + cast(floor(m * 0.1::double) AS bigint) THEN 'val' ELSE 'test' END AS split FROM r")
def p1(spark, sf):
    """80/10/10 of all clusters in order of their hashes, floors exact, the rest for testing. The two cut-offs are found in counts of
    hash prefixes, so there is no global rank and no single sort."""
    hashed = _sizes(spark, sf).select("cluster_id", seeded("split", F.col("cluster_id")).alias("h"))
    train = F.floor(F.col("n") * 0.8)
    return cut(hashed, "h", F.substring("h", 1, 3), {"train": train, "val": train + F.floor(F.col("n") * 0.1)}, "test", "split").select("cluster_id", "split")


@query("p3_equal_by_size", f"{_SZ}, r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY md5(concat('eq:', cast(cluster_id AS varchar))), cluster_id) AS k FROM sz) SELECT cluster_id, n FROM r WHERE k <= 50")
def p3(spark, sf):
    w = Window.partitionBy("n").orderBy(seeded("eq", F.col("cluster_id")), "cluster_id")
    return _sizes(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 50").drop("k")


@query("p5_simple_sample", f"{_SZ} SELECT cluster_id FROM sz ORDER BY md5(concat('s:', cast(cluster_id AS varchar))), cluster_id LIMIT 500")
def p5(spark, sf):
    return _sizes(spark, sf).orderBy(seeded("s", F.col("cluster_id")), "cluster_id").limit(500).select("cluster_id")


@query("p6_read_subsample", f"{VIEWS}, r AS (SELECT cluster_id, read_no, count(*) OVER (PARTITION BY cluster_id) AS n, 2 + cast(concat('0x', substr(md5(concat('k:', cast(cluster_id AS varchar))), 1, 4)) AS int) % 9 AS m, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(concat('r:', cast(cluster_id AS varchar), ':', cast(read_no AS varchar))), read_no) AS k FROM rd) SELECT cluster_id, read_no FROM r WHERE n <= 10 OR k <= m")
def p6(spark, sf):
    """Clusters of over ten reads keep a random 2 to 10 of them."""
    by = Window.partitionBy("cluster_id")
    k = F.row_number().over(by.orderBy(seeded("r", F.col("cluster_id"), F.col("read_no")), "read_no"))
    most = 2 + F.conv(F.substring(seeded("k", F.col("cluster_id")), 1, 4), 16, 10).cast("int") % 9
    return reads(spark, sf).withColumn("k", k).withColumn("n", F.count("*").over(by)).where((F.col("n") <= 10) | (F.col("k") <= most)).select("cluster_id", "read_no")


@query("p9_shuffle_reads", f"{VIEWS} SELECT cluster_id, string_agg(cast(read_no AS varchar), ',' ORDER BY md5(concat('sh:', cast(cluster_id AS varchar), ':', cast(read_no AS varchar)))) AS order_of_reads FROM rd GROUP BY cluster_id")
def p9(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct(seeded("sh", F.col("cluster_id"), F.col("read_no")).alias("k"), F.col("read_no").cast("string").alias("v"))))
    return reads(spark, sf).groupBy("cluster_id").agg(F.array_join(F.transform(rows, lambda x: x["v"]), ",").alias("order_of_reads"))


@query("p8_sub_clusters")
def p8(spark, sf):
    """Consecutive pieces of 2 to 10 reads of larger clusters; a single read left over is dropped."""
    from ..operators.subclusters import sub_clusters

    return sub_clusters(clusters(spark, sf), 4)


@query("a1_a2_w8_size_distribution", f"{VIEWS}, s AS (SELECT gt_id, count(cluster_id) AS n FROM gt LEFT JOIN rd ON cluster_id = gt_id GROUP BY ALL), d AS (SELECT n, count(*) AS clusters FROM s GROUP BY n) SELECT n, clusters, n * clusters AS reads, cast(sum(clusters) OVER (ORDER BY n) AS bigint) AS cumulative FROM d")
def a1(spark, sf):
    s = ground_truth(spark, sf).join(_sizes(spark, sf), F.col("gt_id") == F.col("cluster_id"), "left")
    d = s.groupBy(F.coalesce("n", F.lit(0)).alias("n")).agg(F.count("*").alias("clusters"))
    # A row for each size: few rows, so one ordered window.
    return d.select("n", "clusters", (F.col("n") * F.col("clusters")).alias("reads"), F.sum("clusters").over(Window.orderBy("n")).alias("cumulative"))


@query("a4_experiment_rollup", f"{VIEWS} SELECT supp % 13 AS exp, count(*) AS reads, count(DISTINCT cluster_id) AS clusters, round(avg(length(read)), 6) AS mean_length FROM rd GROUP BY ROLLUP (supp % 13)")
def a4(spark, sf):
    r = reads(spark, sf).select((F.col("supp") % 13).alias("exp"), "cluster_id", "read")
    return r.rollup("exp").agg(F.count("*").alias("reads"), F.count_distinct("cluster_id").alias("clusters"), r6(F.avg(F.length("read"))).alias("mean_length"))


@query("a7_filter_statistics", f"{VIEWS} SELECT count(*) AS total, count(*) FILTER (WHERE length(read) = 110) AS kept, count(*) FILTER (WHERE length(read) < 110) AS short, count(*) FILTER (WHERE length(read) > 110) AS long FROM rd")
def a7(spark, sf):
    n = F.length("read")
    return reads(spark, sf).agg(F.count("*").alias("total"), F.count_if(n == 110).alias("kept"), F.count_if(n < 110).alias("short"), F.count_if(n > 110).alias("long"))


@query("a38_trailing_runs", f"{VIEWS} SELECT length(read) - length(regexp_replace(read, 'C+$', '')) AS run, count(*) AS n FROM rd GROUP BY 1")
def a38(spark, sf):
    from ..functions.sequence import trailing_run

    return reads(spark, sf).groupBy(trailing_run(F.col("read")).cast("long").alias("run")).agg(F.count("*").alias("n"))


@query("a39_longest_line", "SELECT max(length(text)) AS longest FROM documents")
def a39(spark, sf):
    return table(spark, sf, "documents").agg(F.max(F.length("text")).cast("long").alias("longest"))


@query("t4_worst_share_by_size", f"{_SZ}, d AS (SELECT cluster_id, n, sum(levenshtein(read, rd.gt)) AS d FROM rd JOIN sz USING (cluster_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY d DESC, cluster_id) AS k, count(*) OVER (PARTITION BY n) AS m FROM d) SELECT cluster_id, n, cast(d AS bigint) AS d FROM r WHERE k <= greatest(1, ceil(0.05::double * m))")
def t4(spark, sf):
    """Distances are measured once and kept: counts, cut-offs and ranks each read them again."""
    each = edit_distance(reads(spark, sf).select("cluster_id", "read", "gt"), "read", "gt")
    d = kept(each.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("d").alias("d")))
    by = d.groupBy("n", "d").agg(F.count("*").alias("same"))  # few rows: distances of a size
    of = Window.partitionBy("n")
    above = F.coalesce(F.sum("same").over(of.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.select("n", "d", above.alias("above"), F.sum("same").over(of).alias("m"))
    share = F.greatest(F.lit(1), F.ceil(F.col("m") * F.lit(0.05)))
    ranked = rank_within(d.join(by, ["n", "d"]).where(F.col("above") < share), ["n", "d"], "cluster_id")
    return ranked.where(F.col("above") + F.col("k") <= share).select("cluster_id", "n", "d")


@query("t2_t3_top_k", f"{VIEWS} SELECT cluster_id, cast(sum(levenshtein(read, gt)) AS bigint) AS d FROM rd GROUP BY cluster_id ORDER BY d DESC, cluster_id LIMIT 10")
def t2(spark, sf):
    return reads(spark, sf).groupBy("cluster_id").agg(F.sum(F.levenshtein("read", "gt").cast("long")).alias("d")).orderBy(F.desc("d"), "cluster_id").limit(10)


@query("w9_length_buckets", f"{VIEWS} SELECT length(read) // 20 * 20 AS bucket, count(*) AS n FROM rd GROUP BY 1")
def w9(spark, sf):
    return reads(spark, sf).groupBy(F.expr("length(read) div 20 * 20").cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("w9_length_batches", f"{VIEWS}, o AS (SELECT length(read) AS n, (row_number() OVER (ORDER BY length(read)) - 1) // 512 AS batch FROM rd) SELECT batch, count(*) AS reads, min(n) AS shortest, max(n) AS longest, cast(sum(m - n) AS bigint) AS padding FROM (SELECT *, max(n) OVER (PARTITION BY batch) AS m FROM o) GROUP BY batch")
def w9_batches(spark, sf):
    """Reads in batches of like length, laid out by batch, and the padding that each batch needs, read back without a shuffle."""
    r = reads(spark, sf).select("cluster_id", "read_no", "read", F.length("read").alias("n"), (F.col("cluster_id") * 16 + F.col("read_no")).alias("key"))
    laid = write_batches(length_batches(r, "n", "key"), shared_folder(spark, "batches"), 8)
    return laid.groupBy("batch").agg(F.count("*").alias("reads"), F.min("n").alias("shortest"), F.max("n").alias("longest"), (F.max("n").cast("long") * F.count("*") - F.sum("n")).alias("padding"))


@query("w5_w11_share_until_90", f"{VIEWS}, s AS (SELECT cluster_id, read_no, length(read) + part % 50 AS w FROM rd), p AS (SELECT cluster_id, read_no, w / sum(w) OVER (PARTITION BY cluster_id) AS p FROM s), c AS (SELECT *, sum(p) OVER (PARTITION BY cluster_id ORDER BY p DESC, read_no ROWS UNBOUNDED PRECEDING) AS cum FROM p) SELECT cluster_id, count(*) FILTER (WHERE cum - p < 0.9 - 1e-9) AS needed, round(max(p), 6) AS top_share FROM c GROUP BY cluster_id")
def w5(spark, sf):
    s = reads(spark, sf).select("cluster_id", "read_no", (F.length("read") + F.col("part") % 50).alias("w"))
    p = s.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("cluster_id")))
    c = p.withColumn("cum", F.sum("p").over(Window.partitionBy("cluster_id").orderBy(F.desc("p"), "read_no").rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("cluster_id").agg(F.count_if(F.col("cum") - F.col("p") < 0.9 - 1e-9).alias("needed"), r6(F.max("p")).alias("top_share"))


@query("w4_homopolymers", f"{VIEWS}, b AS (SELECT gt_id, cast(i AS int) - 1 AS pos, substr(gt, cast(i AS int), 1) AS base FROM gt, range(1, 111) t(i)), g AS (SELECT *, pos - row_number() OVER (PARTITION BY gt_id, base ORDER BY pos) AS isle FROM b) SELECT gt_id, min(pos) AS start, max(pos) + 1 AS \"end\", base FROM g GROUP BY gt_id, base, isle HAVING count(*) >= 3")
def w4(spark, sf):
    from ..operators.errors import homopolymers

    return homopolymers(ground_truth(spark, sf), "gt_id", "gt")


@query("w13_latest_by_tag", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w13(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
