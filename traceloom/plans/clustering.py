"""Joins that cluster, demultiplex and compare reads (J*), and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import index_value
from ..operators.errors import edit_distance
from ..operators.joins import best_match, concatenated_pairs, index_clusters, index_sweep, prefix_hits, shortest_unique_prefix, within_distance
from ..operators.metrics import r6
from ..sources.fixture import VIEWS, clusters, ground_truth, reads
from ._register import query
from .noisy import NOISY, noisy_reads


@query("j1_prefix_clustering", f"{VIEWS} SELECT r.cluster_id, r.read_no, g.gt_id FROM rd r JOIN gt g ON substr(r.read, 1, 20) = substr(g.gt, 1, 20)")
def j1(spark, sf):
    g = ground_truth(spark, sf).select("gt_id", F.substring("gt", 1, 20).alias("prefix"))
    return reads(spark, sf).withColumn("prefix", F.substring("read", 1, 20)).join(g, "prefix").select("cluster_id", "read_no", "gt_id")


_SHIFTED = f"{VIEWS}, sh AS (SELECT cluster_id, read_no, part, supp, concat(substr('ACGTA', 1, cast(part % 6 AS int)), read) AS s FROM rd)"


def _shifted(spark, sf):
    return reads(spark, sf).select("cluster_id", "read_no", "part", "supp", F.concat(F.substring(F.lit("ACGTA"), F.lit(1), (F.col("part") % 6).cast("int")), "read").alias("s"))


_HITS = f"{_SHIFTED}, km AS (SELECT cluster_id, read_no, cast(p AS int) AS pos, substr(s, cast(p AS int) + 1, 20) AS k FROM sh, range(0, 97) t(p)), ht AS (SELECT cluster_id, read_no, gt_id, min(pos) AS pos FROM km JOIN gt ON k = substr(gt, 1, 20) GROUP BY ALL)"


@query("j2_substring_clustering", f"{_HITS} SELECT * FROM ht")
def j2(spark, sf):
    return prefix_hits(_shifted(spark, sf), ground_truth(spark, sf), 20).select("cluster_id", "read_no", "gt_id", "pos")


@query("j4_w1_best_match", f"{_HITS}, b AS (SELECT cluster_id, read_no, arg_min(gt_id, pos::bigint * 1000000000 + gt_id) AS gt_id, min(pos) AS pos, count(*) AS hits FROM ht GROUP BY ALL) SELECT s.cluster_id, s.read_no, b.gt_id, b.pos, CASE WHEN hits > 0 THEN 0 END AS edit_dist, coalesce(hits, 0) AS hits, CASE WHEN hits IS NULL THEN 'unmapped' WHEN hits = 1 THEN 'mapped' ELSE 'mapped_ambiguous' END AS status FROM sh s LEFT JOIN b USING (cluster_id, read_no)")
def j4(spark, sf):
    s = _shifted(spark, sf)
    return best_match(s, prefix_hits(s, ground_truth(spark, sf), 20))


@query("a3_clustering_statistics", f"{_HITS}, b AS (SELECT cluster_id, read_no, arg_min(gt_id, pos::bigint * 1000000000 + gt_id) AS gt_id, count(*) AS hits FROM ht GROUP BY ALL), z AS (SELECT g.gt_id, count(b.gt_id) AS n FROM gt g LEFT JOIN b ON b.gt_id = g.gt_id GROUP BY ALL) SELECT (SELECT count(*) FROM rd) AS reads, (SELECT count(*) FROM b) AS mapped, (SELECT count(*) FROM b WHERE hits > 1) AS ambiguous, count(*) AS truths, count(*) FILTER (WHERE n = 0) AS uncovered, round(avg(n), 6) AS mean_size, round(median(n), 6) AS median_size, round(stddev_pop(n), 6) AS std_size, min(n) AS min_size, max(n) AS max_size FROM z")
def a3(spark, sf):
    s, g = _shifted(spark, sf), ground_truth(spark, sf)
    m = best_match(s, prefix_hits(s, g, 20))
    per = g.join(m.groupBy("gt_id").agg(F.count("*").alias("n")), "gt_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = m.agg(F.count("*").alias("reads"), F.count_if(F.col("hits") > 0).alias("mapped"), F.count_if(F.col("hits") > 1).alias("ambiguous"))
    size = per.agg(F.count("*").alias("truths"), F.count_if(F.col("n") == 0).alias("uncovered"), r6(F.avg("n")).alias("mean_size"), r6(F.median("n")).alias("median_size"), r6(F.stddev_pop("n")).alias("std_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))
    return one.join(size)  # one row each


@query("a36_unique_prefix_length", f"{VIEWS}, l AS (SELECT cast(k AS int) AS k FROM range(1, 31) t(k)) SELECT min(k) AS length FROM (SELECT k, count(DISTINCT substr(gt, 1, k)) = count(*) AS u FROM gt, l GROUP BY k) WHERE u")
def a36(spark, sf):
    return shortest_unique_prefix(ground_truth(spark, sf), "gt")


@query("a13_u1_index_audit", f"{VIEWS}, v AS (SELECT (gt_id * 7 % 16384) AS i, count(*) AS n FROM gt GROUP BY ALL) SELECT (SELECT count(*) FROM v WHERE n > 1) AS duplicated, (SELECT count(*) FROM range(0, 16384) t(i) ANTI JOIN v USING (i)) AS missing, (SELECT count(*) FROM v WHERE i >= 16384) AS extra")
def a13(spark, sf):
    v = ground_truth(spark, sf).groupBy((F.col("gt_id") * 7 % 16384).alias("i")).agg(F.count("*").alias("n"))
    missing = spark.range(16384).withColumnRenamed("id", "i").join(v, "i", "left_anti")
    # Three counts, one row each.
    return v.agg(F.count_if(F.col("n") > 1).alias("duplicated"), F.count_if(F.col("i") >= 16384).alias("extra")).join(missing.agg(F.count("*").alias("missing"))).select("duplicated", "missing", "extra")


@query("j7_index_region", f"{VIEWS}, s AS (SELECT cluster_id, read_no, concat(substr(read, 1, 42), 'ACAAC', substr(read, 43, 7)) AS s FROM rd), wn AS (SELECT cluster_id, read_no, p, substr(s, cast(p AS int) + 1, 12) AS w FROM s, range(38, 45) t(p)), iv AS (SELECT cluster_id, read_no, p, cast({' + '.join(f'(strpos({chr(39)}ACGT{chr(39)}, substr(w, {i + 6}, 1)) - 1) * {4 ** (6 - i)}' for i in range(7))} AS bigint) AS v FROM wn WHERE starts_with(w, 'ACAAC') AND length(w) = 12) SELECT cluster_id, read_no, arg_min(v, p) AS v FROM iv WHERE v % 2 = 0 GROUP BY ALL")
def j7(spark, sf):
    s = reads(spark, sf).select("cluster_id", "read_no", F.concat(F.substring("read", 1, 42), F.lit("ACAAC"), F.substring("read", 43, 7)).alias("s"))
    w = s.select("cluster_id", "read_no", "s", F.explode(F.sequence(F.lit(38), F.lit(44))).alias("p")).withColumn("w", F.substring("s", F.col("p") + 1, F.lit(12)))
    hit = w.where(F.col("w").startswith("ACAAC") & (F.length("w") == 12)).withColumn("v", index_value(F.substring("w", 6, 7)))
    valid = spark.range(0, 16384, 2).withColumnRenamed("id", "v")
    return hit.join(F.broadcast(valid), "v", "left_semi").groupBy("cluster_id", "read_no").agg(F.min_by("v", "p").alias("v"))


@query("j9_j10_u1_uncovered", f"{VIEWS} SELECT gt_id FROM gt EXCEPT SELECT cluster_id FROM rd")
def j9(spark, sf):
    return ground_truth(spark, sf).select("gt_id").exceptAll(reads(spark, sf).select(F.col("cluster_id").alias("gt_id")).distinct())


@query("j9_truth_lookup", f"{VIEWS} SELECT cluster_id, read_no, gt.gt AS gt FROM rd JOIN gt ON gt_id = cluster_id WHERE gt_id % 89 <> 0")
def j9_lookup(spark, sf):
    """Reads with the ground truth of their cluster; clusters whose id has none are dropped."""
    known = ground_truth(spark, sf).where("gt_id % 89 <> 0").withColumnRenamed("gt_id", "cluster_id")
    return reads(spark, sf).select("cluster_id", "read_no").join(known, "cluster_id")


@query("j10_read_lookup", f"{VIEWS}, a AS (SELECT concat(cast(cluster_id AS varchar), '_', cast(read_no AS varchar)) AS read_id, supp % 97 AS gt_idx FROM rd), s AS (SELECT concat(cast(cluster_id AS varchar), '_', cast(read_no AS varchar)) AS read_id, read FROM rd WHERE length(read) = 110) SELECT read_id, gt_idx, read FROM a JOIN s USING (read_id)")
def j10(spark, sf):
    """Assignments joined by read id with the reads that passed the length filter."""
    r = reads(spark, sf).withColumn("read_id", F.concat_ws("_", F.col("cluster_id").cast("string"), F.col("read_no").cast("string")))
    assigned = r.select("read_id", (F.col("supp") % 97).alias("gt_idx"))
    return assigned.join(r.where(F.length("read") == 110).select("read_id", "read"), "read_id")


_SETTINGS = [(42 - i, 54 + i, most) for i in (0, 2, 6) for most in (0, 1, 2)]
_VALUE = " + ".join(f"(strpos('ACGT', substr(w, {i + 6}, 1)) - 1) * {4 ** (6 - i)}" for i in range(7))
_MARKED = f"""{NOISY}, s AS (SELECT cluster_id, read_no, concat(substr(read, 1, 42), 'ACAAC', substr(read, 43)) AS s FROM nr),
wn AS (SELECT cluster_id, read_no, p, substr(s, cast(p AS int) + 1, 12) AS w FROM s, range(36, 49) t(p) WHERE p + 12 <= length(s)),
iv AS (SELECT cluster_id, read_no, p, hamming(substr(w, 1, 5), 'ACAAC') AS off, cast({_VALUE} AS bigint) AS v FROM wn WHERE regexp_full_match(w, '[ACGT]*')),
g AS (SELECT * FROM (VALUES {', '.join(map(str, _SETTINGS))}) t(start, "end", most)),
h AS (SELECT start, "end", most, cluster_id, read_no, arg_min(v, p) AS v FROM iv, g WHERE v % 3 <> 0 AND p >= start AND p + 12 <= "end" AND off <= most GROUP BY ALL)"""


def _marked(spark, sf):
    return noisy_reads(spark, sf).select("cluster_id", "read_no", F.concat(F.substring("read", 1, 42), F.lit("ACAAC"), F.substring("read", 43, 200)).alias("s"))


@query("j8_window_sweep", f"""{_MARKED}, n AS (SELECT start, "end", most, count(DISTINCT v) AS clusters, count(*) AS found FROM h GROUP BY ALL), t AS (SELECT count(*) AS total FROM s) SELECT g.start, g."end", g.most, coalesce(clusters, 0) AS clusters, coalesce(found, 0) AS found, total - coalesce(found, 0) AS failed, round((total - coalesce(found, 0)) / total, 6) AS failed_share FROM g LEFT JOIN n ON g.start = n.start AND g."end" = n."end" AND g.most = n.most, t""")
def j8(spark, sf):
    """The index region decoded from wider and wider windows and with more differing symbols in its marker, in one job: clusters, reads
    found and reads that failed in each setting."""
    valid = spark.range(16384).where("id % 3 <> 0").withColumnRenamed("id", "v")
    return index_sweep(_marked(spark, sf), valid, _SETTINGS).select("start", "end", "most", "clusters", "found", "failed", r6(F.col("failed_share")).alias("failed_share"))


@query("j7_failed_reads", f"""{_MARKED} SELECT cluster_id, read_no FROM s ANTI JOIN (SELECT * FROM h WHERE start = 40 AND most = 1) h USING (cluster_id, read_no)""")
def j7_failed(spark, sf):
    """Reads that no window of the index region clusters."""
    s = _marked(spark, sf)
    valid = spark.range(16384).where("id % 3 <> 0").withColumnRenamed("id", "v")
    return s.select("cluster_id", "read_no").join(index_clusters(s, valid, [(40, 56, 1)]), ["cluster_id", "read_no"], "left_anti")


@query("j11_a12_misclustering_rate", f"{VIEWS} SELECT supp % 13 AS config, count(*) AS n, round(count(*) FILTER (WHERE levenshtein(read, gt) > 0) / count(*), 6) AS rate FROM rd GROUP BY 1")
def j11(spark, sf):
    return reads(spark, sf).groupBy((F.col("supp") % 13).alias("config")).agg(F.count("*").alias("n"), r6(F.count_if(F.col("read") != F.col("gt")) / F.count("*")).alias("rate"))


@query("j13_pairwise_distance", f"{VIEWS} SELECT a.cluster_id, a.read_no AS i, b.read_no AS j, levenshtein(a.read, b.read) AS d FROM rd a JOIN rd b ON a.cluster_id = b.cluster_id AND a.read_no < b.read_no")
def j13(spark, sf):
    r = reads(spark, sf).select("cluster_id", "read_no", "read")
    b = r.select("cluster_id", F.col("read_no").alias("j"), F.col("read").alias("b"))
    pairs = r.join(b, "cluster_id").where("read_no < j").select("cluster_id", F.col("read_no").alias("i"), "j", "read", "b")
    return edit_distance(pairs, "read", "b").select("cluster_id", "i", "j", F.col("d").cast("long").alias("d"))


_TEST = "SELECT DISTINCT concat(substr(gt, 1, 30), translate(substr(gt, 31, 8), 'ACGT', 'TGCA'), substr(gt, 39)) AS g FROM gt WHERE gt_id % 10 = 0"


@query("j12_leakage_anti_join", f"{VIEWS}, te AS ({_TEST}), s AS (SELECT DISTINCT read AS s FROM rd WHERE cluster_id % 3 <> 0), c AS (SELECT g, no, substr(g, cast(no * 7 AS int) + 1, 7) AS piece FROM te, range(0, 14) t(no)), a AS (SELECT s, no, substr(s, cast(p AS int) + 1, 7) AS piece FROM s, range(0, 105) t(p), range(0, 14) u(no) WHERE abs(p - no * 7) <= 13 AND p + 7 <= length(s)), n AS (SELECT DISTINCT s FROM (SELECT DISTINCT s, g FROM a JOIN c USING (no, piece)) WHERE levenshtein(s, g) BETWEEN 5 AND 13) SELECT cluster_id, read_no FROM rd WHERE cluster_id % 3 <> 0 AND read NOT IN (SELECT s FROM n)")
def j12(spark, sf):
    """Training reads without those at distance 5 to 13 of a test sequence; closer ones stay. Test sequences are ground truths with
    eight bases in a row complemented."""
    gt = F.concat(F.substring("gt", 1, 30), F.translate(F.substring("gt", 31, 8), "ACGT", "TGCA"), F.substring("gt", 39, 200))
    test = ground_truth(spark, sf).where("gt_id % 10 = 0").select(gt.alias("g"))
    train = reads(spark, sf).where("cluster_id % 3 <> 0").select("cluster_id", "read_no", F.col("read").alias("s"))
    return train.join(within_distance(train, test, 5, 13), "s", "left_anti").select("cluster_id", "read_no")


@query("j19_pair_concatenation", f"""{VIEWS}, c AS (SELECT cluster_id, gt, count(*) AS n, list(read ORDER BY read_no) AS rs FROM rd GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cluster_id) AS k FROM c)
SELECT a.cluster_id AS a, b.cluster_id AS b, a.n, array_to_string(list_transform(range(1, a.n + 1), lambda i: concat(a.rs[i], b.rs[i])), '|') || ':' || a.gt || b.gt AS example FROM r a JOIN r b ON a.n = b.n AND a.k % 2 = 1 AND b.k = a.k + 1""")
def j19(spark, sf):
    """Examples of two clusters each: reads and ground truths one after the other."""
    pairs = concatenated_pairs(clusters(spark, sf))
    return pairs.select("a", "b", F.col("n").cast("long").alias("n"), F.concat_ws(":", F.array_join("reads", "|"), "gt").alias("example"))


@query("j18_u5_dataset_comparison", f"{VIEWS}, l AS (SELECT gt_id, gt FROM gt), r AS (SELECT gt_id, CASE WHEN gt_id % 97 = 0 THEN reverse(gt) ELSE gt END AS gt FROM gt WHERE gt_id % 89 <> 0) SELECT count(l.gt_id) AS in_left, count(r.gt_id) AS in_right, count(*) FILTER (WHERE l.gt IS DISTINCT FROM r.gt) AS differing, min(coalesce(l.gt_id, r.gt_id)) FILTER (WHERE l.gt IS DISTINCT FROM r.gt) AS first_differing FROM l FULL JOIN r ON l.gt_id = r.gt_id")
def j18(spark, sf):
    left = ground_truth(spark, sf)
    right = left.where("gt_id % 89 <> 0").select(F.col("gt_id").alias("id"), F.when(F.col("gt_id") % 97 == 0, F.reverse("gt")).otherwise(F.col("gt")).alias("g"))
    both = left.join(right, left.gt_id == right.id, "full")
    other = ~F.col("gt").eqNullSafe(F.col("g"))
    return both.agg(F.count("gt_id").alias("in_left"), F.count("id").alias("in_right"), F.count_if(other).alias("differing"), F.min(F.when(other, F.coalesce("gt_id", "id"))).alias("first_differing"))


@query("u5_multiset_equality", f"{VIEWS}, l AS (SELECT read FROM rd), r AS (SELECT CASE WHEN part % 211 = 0 THEN reverse(read) ELSE read END AS read FROM rd) SELECT (SELECT count(*) FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)) AS only_left, (SELECT count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)) AS only_right")
def u5(spark, sf):
    """Reads that one data set holds oftener than the other, both ways; equal multisets give none."""
    r = reads(spark, sf)
    left, right = r.select("read"), r.select(F.when(F.col("part") % 211 == 0, F.reverse("read")).otherwise(F.col("read")).alias("read"))
    return left.exceptAll(right).agg(F.count("*").alias("only_left")).crossJoin(right.exceptAll(left).agg(F.count("*").alias("only_right")))
