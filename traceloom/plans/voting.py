"""Consensus (V*), reconstruction metrics and position metrics over the derived reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus as C
from ..operators import metrics as M
from ..operators.errors import both_distances, edit_distance
from ..sources.fixture import VIEWS, clusters, ground_truth, reads
from ._register import query

_POS = "pos AS (SELECT cluster_id, read_no, CAST(p AS int) AS pos, substr(read, CAST(p AS int), 1) AS base FROM rd, range(1, 112) t(p) WHERE p <= length(read)), cnt AS (SELECT cluster_id, pos, base, count(*) AS n, min(read_no) AS seen FROM pos GROUP BY ALL)"
_PLAIN = f"""{VIEWS}, {_POS}, short AS (SELECT cluster_id, min(length(read)) AS s FROM rd GROUP BY ALL),
win AS (SELECT c.cluster_id, pos, base, row_number() OVER (PARTITION BY c.cluster_id, pos ORDER BY n DESC, md5(concat(cast(c.cluster_id AS varchar), ':', cast(pos AS varchar), ':', base))) AS r FROM cnt c JOIN short USING (cluster_id) WHERE pos <= s),
con AS (SELECT cluster_id, string_agg(base, '' ORDER BY pos) AS consensus FROM win WHERE r = 1 GROUP BY ALL)"""


@query("v3_plain_vote", f"{_PLAIN} SELECT cluster_id, consensus FROM con")
def v3(spark, sf):
    return C.plain_vote(reads(spark, sf))


@query("v1_gap_weighted_vote", f"{VIEWS}, {_POS}, win AS (SELECT cluster_id, pos, base, row_number() OVER (PARTITION BY cluster_id, pos ORDER BY n DESC, strpos('ACGT-N', base)) AS r FROM cnt) SELECT cluster_id, string_agg(base, '' ORDER BY pos) AS consensus FROM win WHERE r = 1 GROUP BY ALL")
def v1(spark, sf):
    return C.gap_weighted_vote(reads(spark, sf))


@query("v2_first_seen_vote", f"{VIEWS}, {_POS}, pad AS (SELECT cluster_id, read_no, CAST(p AS int) AS pos, substr(rpad(substr(read, 1, 110), 110, '#'), CAST(p AS int), 1) AS base FROM rd, range(1, 111) t(p)), c2 AS (SELECT cluster_id, pos, base, count(*) AS n, min(read_no) AS seen FROM pad GROUP BY ALL), win AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, pos ORDER BY (base IN ('#', '-')), n DESC, seen) AS r FROM c2) SELECT cluster_id, string_agg(base, '' ORDER BY pos) AS consensus FROM win WHERE r = 1 GROUP BY ALL")
def v2(spark, sf):
    return C.first_seen_vote(reads(spark, sf), 110)


def _gap_ties(deletions: bool) -> str:
    chosen = "CASE WHEN top = 'D' THEN coalesce(best, translate(substr(md5(concat(cast(cluster_id AS varchar), ':', cast(pos AS varchar))), 1, 1), '0123456789abcdef', 'ACGTACGTACGTACGT')) ELSE top END" if deletions else "top"
    return f"""{VIEWS}, mk AS (SELECT cluster_id, read_no, CASE WHEN kind = 2 THEN concat(substr(read, 1, 20), 'D', substr(read, 21)) WHEN kind = 3 THEN concat(substr(read, 1, 50), '-', substr(read, 52)) ELSE read END AS read FROM rd),
ps AS (SELECT cluster_id, read_no, CAST(p AS int) AS pos, substr(rpad(substr(read, 1, 110), 110, '#'), CAST(p AS int), 1) AS base FROM mk, range(1, 111) t(p)), cn AS (SELECT cluster_id, pos, base, count(*) AS n, min(read_no) AS seen FROM ps GROUP BY ALL),
pk AS (SELECT cluster_id, pos, first(base ORDER BY n DESC, base = '-', seen) AS top, first(base ORDER BY n DESC, seen) FILTER (WHERE base IN ('A', 'C', 'G', 'T')) AS best FROM cn GROUP BY ALL)
SELECT cluster_id, string_agg({chosen}, '' ORDER BY pos) AS consensus FROM pk GROUP BY ALL"""


def _marked(spark, sf):
    marked = F.when(F.col("kind") == 2, F.concat(F.substring("read", 1, 20), F.lit("D"), F.substring("read", 21, 200))).when(F.col("kind") == 3, F.concat(F.substring("read", 1, 50), F.lit("-"), F.substring("read", 52, 200))).otherwise(F.col("read"))
    return reads(spark, sf).select("cluster_id", "read_no", marked.alias("read"))


@query("v4_gap_tie_vote", _gap_ties(False))
def v4(spark, sf):
    return C.gap_tie_vote(_marked(spark, sf), 110)


@query("v4_gap_tie_vote_deletions", _gap_ties(True))
def v4d(spark, sf):
    return C.gap_tie_vote(_marked(spark, sf), 110, deletions=True)


@query("v5_marked_vote", f"{VIEWS}, mk AS (SELECT cluster_id, read_no, CASE WHEN kind = 2 THEN concat(substr(read, 1, 20), 'D', substr(read, 21)) WHEN kind = 3 THEN concat(substr(read, 1, 50), 'I', substr(read, 52)) ELSE read END AS read FROM rd), ps AS (SELECT cluster_id, CAST(p AS int) AS pos, substr(read, CAST(p AS int), 1) AS base FROM mk, range(1, 112) t(p) WHERE p <= length(read)), cn AS (SELECT cluster_id, pos, base, count(*) AS n FROM ps GROUP BY ALL), pk AS (SELECT cluster_id, pos, bool_or(base = 'I') AS ins, bool_or(base = 'D') AS del, arg_min(base, -n * 100 + strpos('ACGT-DI', base)) AS top, arg_min(base, -n * 100 + strpos('ACGT-DI', base)) FILTER (WHERE base IN ('A', 'C', 'G', 'T')) AS best FROM cn GROUP BY ALL) SELECT cluster_id, string_agg(CASE WHEN ins THEN '-' WHEN del THEN coalesce(best, '-') ELSE top END, '' ORDER BY pos) AS consensus FROM pk GROUP BY ALL")
def v5(spark, sf):
    r = reads(spark, sf)
    marked = F.when(F.col("kind") == 2, F.concat(F.substring("read", 1, 20), F.lit("D"), F.substring("read", 21, 200))).when(F.col("kind") == 3, F.concat(F.substring("read", 1, 50), F.lit("I"), F.substring("read", 52, 200))).otherwise(F.col("read"))
    return C.marked_vote(r.select("cluster_id", "read_no", marked.alias("read")))


@query("v6_weighted_vote", f"{VIEWS}, {_POS}, w AS (SELECT p.cluster_id, pos, base, sum(1 + part % 3) AS n FROM pos p JOIN rd USING (cluster_id, read_no) GROUP BY ALL), win AS (SELECT cluster_id, pos, base, row_number() OVER (PARTITION BY cluster_id, pos ORDER BY n DESC, strpos('ACGT-N', base)) AS r FROM w) SELECT cluster_id, string_agg(base, '' ORDER BY pos) AS consensus FROM win WHERE r = 1 GROUP BY ALL")
def v6(spark, sf):
    return C.gap_weighted_vote(reads(spark, sf).withColumn("weight", 1 + F.col("part") % 3), weight="weight")


@query("v6_position_weights", f"{VIEWS}, {_POS}, w AS (SELECT p.cluster_id, pos, base, sum((1 + part % 3) * (1 + (pos * 7 + part) % 5)) AS n FROM pos p JOIN rd USING (cluster_id, read_no) GROUP BY ALL), win AS (SELECT cluster_id, pos, base, row_number() OVER (PARTITION BY cluster_id, pos ORDER BY n DESC, strpos('ACGT-N', base)) AS r FROM w) SELECT cluster_id, string_agg(base, '' ORDER BY pos) AS consensus FROM win WHERE r = 1 GROUP BY ALL")
def v6_positions(spark, sf):
    """Each read has a weight, and each of its positions one of its own (an array beside the read)."""
    own = F.transform(F.sequence(F.lit(1), F.length("read")), lambda p: 1 + (p * 7 + F.col("part")) % 5)
    return C.position_weighted_vote(reads(spark, sf).withColumn("weight", 1 + F.col("part") % 3).withColumn("weights", own))


@query("v8_medoid", f"{VIEWS}, d AS (SELECT a.cluster_id, a.read_no AS i, a.read AS a, sum(levenshtein(a.read, b.read)) AS t FROM rd a JOIN rd b USING (cluster_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY t, abs(length(a) - 110), i) AS k FROM d) SELECT cluster_id, a AS consensus FROM r WHERE k = 1")
def v8(spark, sf):
    return C.medoid(reads(spark, sf), 110)


@query("v9_half_vote", f"{VIEWS}, h AS (SELECT cluster_id, substr(read, 1, 55) AS x, count(*) AS n FROM rd GROUP BY ALL), t AS (SELECT cluster_id, substr(read, 56, 110) AS x, count(*) AS n FROM rd GROUP BY ALL), h1 AS (SELECT cluster_id, x, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, x) AS r FROM h), t1 AS (SELECT cluster_id, x, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, x) AS r FROM t) SELECT h1.cluster_id, concat(h1.x, t1.x) AS consensus FROM h1 JOIN t1 USING (cluster_id) WHERE h1.r = 1 AND t1.r = 1")
def v9(spark, sf):
    return C.half_vote(reads(spark, sf), 110)


@query("v10_exact_vote", f"{VIEWS}, e AS (SELECT cluster_id, read, count(*) AS n FROM rd WHERE length(read) = 110 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, read) AS k FROM e) SELECT cluster_id, read AS consensus FROM r WHERE k = 1")
def v10(spark, sf):
    return C.exact_vote(reads(spark, sf), 110)


_HAM = "(SELECT count(*) FROM range(1, length(gt) + 1) t(i) WHERE substr(gt, CAST(i AS int), 1) <> substr(consensus, CAST(i AS int), 1))"
_SCORED = f"""{_PLAIN}, h AS (SELECT c.cluster_id, count(*) AS miss FROM (SELECT cluster_id, gt_id, gt, consensus, CAST(unnest(range(1, 111)) AS int) AS i FROM con JOIN gt ON gt_id = cluster_id) c WHERE substr(gt, i, 1) <> substr(consensus, i, 1) GROUP BY ALL),
sz AS (SELECT cluster_id, count(*) AS n FROM rd GROUP BY ALL),
sc AS (SELECT cluster_id, n, gt, consensus, coalesce(miss, 0) / 110.0::double AS ham, levenshtein(gt, consensus) / 110.0::double AS lev, (coalesce(miss, 0) = 0) AS success FROM con JOIN gt ON gt_id = cluster_id JOIN sz USING (cluster_id) LEFT JOIN h USING (cluster_id))"""


def _scored(spark, sf):
    r = reads(spark, sf)
    sizes = r.groupBy("cluster_id").agg(F.count("*").alias("n"))
    pred = C.consensus(r, "plain").join(sizes, "cluster_id").join(ground_truth(spark, sf).withColumnRenamed("gt_id", "cluster_id"), "cluster_id")
    return M.scored(pred)


@query("a8_reconstruction_metrics", f"""{_SCORED} SELECT n, count(*) AS clusters, round(avg(success::int), 6) AS success_rate, round(1 - avg(success::int), 6) AS failure_rate,
 round(avg(ham), 6) AS ham_mean, round(stddev_pop(ham), 6) AS ham_std, round(min(ham), 6) AS ham_min, round(max(ham), 6) AS ham_max,
 round(avg(lev), 6) AS lev_mean, round(stddev_pop(lev), 6) AS lev_std, round(min(lev), 6) AS lev_min, round(max(lev), 6) AS lev_max FROM sc GROUP BY ROLLUP (n)""")
def a8(spark, sf):
    return M.by_size(_scored(spark, sf))


@query("a9_base_accuracy", f"{_SCORED} SELECT n, round(1 - sum(ham * 110) / sum(110), 6) AS base_accuracy FROM sc GROUP BY ROLLUP (n)")
def a9(spark, sf):
    s = _scored(spark, sf)
    return s.rollup("n").agg(M.r6(1 - F.sum(F.col("ham") * F.length("gt")) / F.sum(F.length("gt"))).alias("base_accuracy"))


@query("a11_noisy_read_baseline", f"{VIEWS}, c AS (SELECT cluster_id, count(*) AS n, avg(levenshtein(read, gt)) AS a, min(levenshtein(read, gt)) AS b FROM rd GROUP BY ALL) SELECT n, count(*) AS clusters, round(avg(a), 6) AS mean_distance, round(avg(b), 6) AS best_distance FROM c GROUP BY ROLLUP (n)")
def a11(spark, sf):
    lev = F.levenshtein("read", "gt")
    c = reads(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg(lev).alias("a"), F.min(lev).alias("b"))
    return c.rollup("n").agg(F.count("*").alias("clusters"), M.r6(F.avg("a")).alias("mean_distance"), M.r6(F.avg("b")).alias("best_distance"))


_FREQ = f"{VIEWS}, {_POS}, f AS (SELECT cluster_id, pos, sum(n) AS depth, sum(CASE base WHEN 'A' THEN n ELSE 0 END) AS a, sum(CASE base WHEN 'C' THEN n ELSE 0 END) AS c, sum(CASE base WHEN 'G' THEN n ELSE 0 END) AS g, sum(CASE base WHEN 'T' THEN n ELSE 0 END) AS t FROM cnt GROUP BY ALL)"


def _frequencies(spark, sf):
    return C.base_counts(reads(spark, sf))


@query("a14_base_frequencies", f"{_FREQ} SELECT cluster_id, pos, cast(depth AS bigint) AS depth, cast(a AS bigint) AS a, cast(c AS bigint) AS c, cast(g AS bigint) AS g, cast(t AS bigint) AS t FROM f")
def a14(spark, sf):
    return _frequencies(spark, sf)


@query("a15_majority_frequency", f"{_FREQ} SELECT cluster_id, pos, round(greatest(a, c, g, t) / depth, 6) AS majority FROM f")
def a15(spark, sf):
    return _frequencies(spark, sf).select("cluster_id", "pos", M.r6(F.greatest("a", "c", "g", "t") / F.col("depth")).alias("majority"))


_METRIC = f"{VIEWS}, {_POS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, pos ORDER BY n DESC, base) AS k FROM cnt), sz AS (SELECT cluster_id, count(*) AS reads FROM rd GROUP BY ALL), m AS (SELECT cluster_id, pos, max(base) FILTER (WHERE k = 1) AS base, max(n) FILTER (WHERE k = 1) - coalesce(max(n) FILTER (WHERE k = 2), 0) AS margin, max(n) FILTER (WHERE k = 1) AS first FROM r GROUP BY ALL), pm AS (SELECT cluster_id, pos, base, margin, first / reads AS agreement, reads, (base = substr(gt, pos, 1)) AS correct FROM m JOIN sz USING (cluster_id) JOIN gt ON gt_id = cluster_id)"


def _metrics(spark, sf):
    return C.position_metrics(reads(spark, sf), ground_truth(spark, sf).withColumnRenamed("gt_id", "cluster_id"))


@query("a17_w3_position_metrics", f"{_METRIC} SELECT cluster_id, pos, base, margin, round(agreement, 6) AS agreement, reads, correct FROM pm")
def a17(spark, sf):
    return _metrics(spark, sf).withColumn("agreement", M.r6(F.col("agreement")))


@query("a18_vote_confidence", f"{_METRIC} SELECT reads, count(*) AS positions, round(avg(margin) FILTER (WHERE correct), 6) AS margin_correct, round(avg(margin) FILTER (WHERE NOT correct), 6) AS margin_wrong, round(avg(agreement), 6) AS agreement FROM pm GROUP BY reads")
def a18(spark, sf):
    m = _metrics(spark, sf)
    return m.groupBy("reads").agg(F.count("*").alias("positions"), M.r6(F.avg(F.when(F.col("correct"), F.col("margin")))).alias("margin_correct"), M.r6(F.avg(F.when(~F.col("correct"), F.col("margin")))).alias("margin_wrong"), M.r6(F.avg("agreement")).alias("agreement"))


@query("a19_by_vote_margin", f"{_METRIC} SELECT margin, count(*) AS positions, round(avg(agreement), 6) AS mean_agreement, round(stddev_samp(agreement), 6) AS std_agreement FROM pm GROUP BY margin")
def a19(spark, sf):
    return _metrics(spark, sf).groupBy("margin").agg(F.count("*").alias("positions"), M.r6(F.avg("agreement")).alias("mean_agreement"), M.r6(F.stddev_samp("agreement")).alias("std_agreement"))


@query("a20_confidence_extremes", f"{_METRIC}, s AS (SELECT reads, round(avg(agreement), 6) AS a FROM pm GROUP BY reads) SELECT arg_max(reads, a * 1000000 - reads / 100.0) AS most_confident, arg_min(reads, a * 1000000 + reads / 100.0) AS least_confident FROM s")
def a20(spark, sf):
    s = _metrics(spark, sf).groupBy("reads").agg(M.r6(F.avg("agreement")).alias("a"))
    return s.agg(F.max_by("reads", F.col("a") * 1000000 - F.col("reads") / 100.0).alias("most_confident"), F.min_by("reads", F.col("a") * 1000000 + F.col("reads") / 100.0).alias("least_confident"))


@query("a21_entropy_by_size", f"{_FREQ}, e AS (SELECT cluster_id, avg(-(CASE WHEN a > 0 THEN a / depth * ln(a / depth) ELSE 0 END + CASE WHEN c > 0 THEN c / depth * ln(c / depth) ELSE 0 END + CASE WHEN g > 0 THEN g / depth * ln(g / depth) ELSE 0 END + CASE WHEN t > 0 THEN t / depth * ln(t / depth) ELSE 0 END)) AS h, max(depth) AS n FROM f GROUP BY cluster_id) SELECT n::bigint AS n, round(avg(h), 6) AS mean_entropy, round(stddev_pop(h), 6) AS std_entropy FROM e GROUP BY ROLLUP (n)")
def a21(spark, sf):
    part = lambda b: F.when(F.col(b) > 0, F.col(b) / F.col("depth") * F.log(F.col(b) / F.col("depth"))).otherwise(0.0)
    e = _frequencies(spark, sf).groupBy("cluster_id").agg(F.avg(-(part("a") + part("c") + part("g") + part("t"))).alias("h"), F.max("depth").alias("n"))
    return e.rollup("n").agg(M.r6(F.avg("h")).alias("mean_entropy"), M.r6(F.stddev_pop("h")).alias("std_entropy"))


@query("a42_cluster_quality", f"{VIEWS} SELECT cluster_id, count(*) FILTER (WHERE read = gt) AS exact, count(*) FILTER (WHERE substr(read, 1, 55) = substr(gt, 1, 55)) AS first_half, count(*) FILTER (WHERE substr(read, 56) = substr(gt, 56)) AS second_half, min(levenshtein(read, gt)) AS least, max(levenshtein(read, gt)) AS most, cast(sum(levenshtein(read, gt)) AS bigint) AS total, count(*) FILTER (WHERE length(read) = 110) AS right_length FROM rd GROUP BY cluster_id")
def a42(spark, sf):
    d = edit_distance(reads(spark, sf).select("cluster_id", "read", "gt"), "read", "gt").withColumn("d", F.col("d").cast("long"))
    return d.groupBy("cluster_id").agg(F.count_if(F.col("read") == F.col("gt")).alias("exact"), F.count_if(F.substring("read", 1, 55) == F.substring("gt", 1, 55)).alias("first_half"), F.count_if(F.substring("read", 56, 200) == F.substring("gt", 56, 200)).alias("second_half"), F.min("d").alias("least"), F.max("d").alias("most"), F.sum("d").alias("total"), F.count_if(F.length("read") == 110).alias("right_length"))


@query("m1_m2_distances", f"{VIEWS}, h AS (SELECT cluster_id, read_no, count(*) AS miss FROM (SELECT cluster_id, read_no, gt, read, CAST(unnest(range(1, 111)) AS int) AS i FROM rd) WHERE substr(gt, i, 1) <> substr(read, i, 1) GROUP BY ALL) SELECT cluster_id, read_no, levenshtein(gt, read) AS lev, coalesce(miss, 0) AS ham, round(levenshtein(gt, read) / 110.0::double, 6) AS lev_share FROM rd LEFT JOIN h USING (cluster_id, read_no)")
def m1(spark, sf):
    d = both_distances(reads(spark, sf).select("cluster_id", "read_no", "gt", "read"), "gt", "read")
    return d.select("cluster_id", "read_no", "lev", "ham", M.r6(F.col("lev") / F.length("gt")).alias("lev_share"))


@query("a41_cluster_assembly", f"{VIEWS} SELECT cluster_id, count(*) AS n, string_agg(read, '|' ORDER BY read_no) AS reads FROM rd GROUP BY cluster_id HAVING count(*) >= 2")
def a41(spark, sf):
    return clusters(spark, sf).where(F.size("reads") >= 2).select("cluster_id", F.size("reads").cast("long").alias("n"), F.array_join("reads", "|").alias("reads"))


@query("v11_lookahead_vote")
def v11(spark, sf):
    """Consensus by pointers that look two symbols ahead (tested against a plain loop)."""
    return C.lookahead_vote(reads(spark, sf), 110)


def _first_of_several(rs: list[str], length: int) -> str:
    if len(rs) < 2:
        raise ValueError("one read alone")
    return rs[0][:length]


@query("x1_x3_x4_methods", f"""{VIEWS}, sz AS (SELECT cluster_id, any_value(gt) AS gt, count(*) AS n FROM rd GROUP BY cluster_id),
e AS (SELECT cluster_id, arg_min(read, concat(lpad(cast(1000000 - n AS varchar), 9, '0'), read)) AS c FROM (SELECT cluster_id, read, count(*) AS n FROM rd WHERE length(read) = 110 GROUP BY ALL) GROUP BY ALL),
f AS (SELECT cluster_id, substr(arg_min(read, read_no), 1, 110) AS c FROM rd GROUP BY cluster_id HAVING count(*) > 1),
u AS (SELECT 'exact' AS method, sz.gt, c, CASE WHEN c IS NULL THEN 'no consensus' END AS error FROM sz LEFT JOIN e USING (cluster_id) UNION ALL SELECT 'first_of_several', sz.gt, c, CASE WHEN c IS NULL THEN 'ValueError: one read alone' END FROM sz LEFT JOIN f USING (cluster_id))
SELECT method, error, count(*) AS clusters, round(avg(coalesce(levenshtein(c, gt) / length(gt), 1)), 6) AS lev_mean FROM u GROUP BY ALL""")
def x1(spark, sf):
    """A method of the registry and a user's function, by what became of the clusters: a failed one counts with a
    distance of 1."""
    r = reads(spark, sf)
    truths = ground_truth(spark, sf).withColumnRenamed("gt_id", "cluster_id")
    methods = {"exact": "exact", "first_of_several": C.plug_in(_first_of_several)}
    both = [C.consensus(r, m).join(truths, "cluster_id").withColumn("method", F.lit(name)) for name, m in methods.items()]
    all_ = both[0].unionByName(both[1])
    lev = F.coalesce(F.col("d") / F.length("gt"), F.lit(1.0))
    return edit_distance(all_, "consensus", "gt").groupBy("method", "error").agg(F.count("*").alias("clusters"), M.r6(F.avg(lev)).alias("lev_mean"))
