"""Demultiplexing of reads that carry primers (J5, J6, F11, F20, A6, K3) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..operators import demux as D
from ..operators.joins import primers
from ..operators.metrics import r6
from ..sources import scans
from ..sources.fixture import VIEWS, ground_truth, reads
from ._register import query
from .sources import _folder

_HEX = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_RAW = f"""{VIEWS}, pr AS (SELECT cast(e AS bigint) AS exp, substr(translate(md5(concat('f', cast(e AS varchar))), {_HEX}), 1, 12) AS f, substr(translate(md5(concat('r', cast(e AS varchar))), {_HEX}), 1, 12) AS r FROM range(0, 13) t(e)),
w AS (SELECT cluster_id, read_no, part, supp, concat(substr(translate(md5(concat('j', cast(part AS varchar))), {_HEX}), 1, cast(part % 7 AS int)), f, CASE WHEN part % 50 = 0 THEN substr(read, 1, 50) ELSE read END, r, substr(translate(md5(concat('k', cast(supp AS varchar))), {_HEX}), 1, cast(supp % 5 AS int))) AS s FROM rd JOIN pr ON exp = supp % 13),
o AS (SELECT cluster_id, read_no, CASE WHEN part % 2 = 1 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS s, substr(repeat(md5(concat('q', cast(part AS varchar))), 6), 1, length(s)) AS qual FROM w)"""
_SQL = f"""{_RAW}, c AS (SELECT cluster_id, read_no, 0 AS rc, s FROM o UNION ALL SELECT cluster_id, read_no, 1, reverse(translate(s, 'ACGT', 'TGCA')) FROM o),
fw AS (SELECT cluster_id, read_no, rc, exp, min(levenshtein(substr(s, cast(p AS int) + 1, 12), f) * 1000 + p) AS x FROM c, pr, range(0, 100) t(p) WHERE p <= length(s) // 2 - 11 GROUP BY ALL),
rv AS (SELECT cluster_id, read_no, rc, exp, min(levenshtein(substr(s, cast(p + length(s) // 2 AS int) + 1, 12), r) * 1000 + p + length(s) // 2) AS y FROM c, pr, range(0, 100) t(p) WHERE p <= length(s) - 12 - length(s) // 2 GROUP BY ALL),
al AS (SELECT *, (x // 1000 + y // 1000) * 10000 + rc * 1000 + exp AS k FROM fw JOIN rv USING (cluster_id, read_no, rc, exp) WHERE y % 1000 > x % 1000 + 12),
dm AS (SELECT cluster_id, read_no, arg_min(exp, k) AS exp, arg_min(rc, k) AS rc, arg_min(x % 1000, k) AS fwd_pos, arg_min(y % 1000, k) AS rev_pos, arg_min(x // 1000, k) AS fwd_dist, arg_min(y // 1000, k) AS rev_dist FROM al GROUP BY ALL)"""
_OUT = f"""{_SQL}, t AS (SELECT cluster_id, read_no, s, exp, rc, fwd_pos, rev_pos, fwd_dist, rev_dist, CASE WHEN rc = 1 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS u, CASE WHEN rc = 1 THEN reverse(qual) ELSE qual END AS v FROM o LEFT JOIN dm USING (cluster_id, read_no)),
p AS (SELECT *, substr(u, cast(fwd_pos AS int) + 13, cast(rev_pos - fwd_pos - 12 AS int)) AS payload, substr(v, cast(fwd_pos AS int) + 13, cast(rev_pos - fwd_pos - 12 AS int)) AS payload_qual FROM t),
r AS (SELECT *, CASE WHEN length(s) < 80 THEN 'unmapped_short' WHEN exp IS NULL THEN 'unmapped_not_found' WHEN length(payload) < 50 OR length(payload) > 110 THEN 'unmapped_invalid' ELSE 'mapped' END AS status FROM p)"""


def _reads(spark, sf):
    """cluster_id, read_no, s, qual: reads between primers and junk, half of them turned, some cut short."""
    md5 = lambda c, column: F.md5(F.concat(F.lit(c), F.col(column).cast("string")))
    junk = lambda c, column, n: F.substring(F.translate(md5(c, column), "0123456789abcdef", "ACGT" * 4), F.lit(1), (F.col(column) % n).cast("int"))
    cut = F.when(F.col("part") % 50 == 0, F.substring("read", 1, 50)).otherwise(F.col("read"))
    w = reads(spark, sf).withColumn("exp", F.col("supp") % 13).join(F.broadcast(primers(spark)), "exp").select("cluster_id", "read_no", "part", F.concat(junk("j", "part", 7), "f", cut, "r", junk("k", "supp", 5)).alias("s"))
    qual = F.substring(F.repeat(md5("q", "part"), F.lit(6)), F.lit(1), F.length("s"))
    return w.select("cluster_id", "read_no", F.when(F.col("part") % 2 == 1, reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("s"), qual.alias("qual"))


def _sorted_out(spark, sf):
    found = D.payload(D.demultiplex(_reads(spark, sf), primers(spark)), qual="qual")
    return found.withColumn("status", D.outcome(most=110))


@query("j5_orientation_demux", f"{_SQL} SELECT cluster_id, read_no, exp, rc, fwd_pos, rev_pos, fwd_dist, rev_dist FROM o LEFT JOIN dm USING (cluster_id, read_no)")
def j5(spark, sf):
    return D.demultiplex(_reads(spark, sf), primers(spark)).select("cluster_id", "read_no", "exp", "rc", "fwd_pos", "rev_pos", "fwd_dist", "rev_dist")


@query("f11_f20_x3_payload_and_outcome", f"{_OUT} SELECT cluster_id, read_no, status, payload, payload_qual FROM r")
def f11(spark, sf):
    return _sorted_out(spark, sf).select("cluster_id", "read_no", "status", "payload", "payload_qual")


@query("j6_truth_primers", f"{VIEWS}, pr AS (SELECT cast(e AS bigint) AS exp, substr(translate(md5(concat('f', cast(e AS varchar))), {_HEX}), 1, 12) AS f, substr(translate(md5(concat('r', cast(e AS varchar))), {_HEX}), 1, 12) AS r FROM range(0, 13) t(e)) SELECT gt_id, exp, gt AS payload, gt_id % 11 <> 0 AS at_ends FROM gt JOIN pr ON exp = gt_id % 13")
def j6(spark, sf):
    """Ground truths between primers; one in eleven has three bases in front, so its primers are sought."""
    p = primers(spark)
    both = ground_truth(spark, sf).withColumn("exp", F.col("gt_id") % 13).join(F.broadcast(p), "exp")
    lead = F.when(F.col("gt_id") % 11 == 0, "CAT").otherwise("")
    return D.truth_payloads(both.select("gt_id", "exp", F.concat(lead, "f", "gt", "r").alias("s")), p)


@query("a6_demux_statistics", f"{_OUT}, x AS (SELECT exp, rc AS orientation, status, fwd_dist + rev_dist AS d FROM r) SELECT exp, orientation, status, count(*) AS reads, round(count(*) FILTER (WHERE status = 'mapped') / count(*), 6) AS mapping_rate, round(avg(d), 6) AS mean_dist, round(median(d), 6) AS median_dist, round(stddev_pop(d), 6) AS std_dist, min(d) AS min_dist, max(d) AS max_dist FROM x GROUP BY GROUPING SETS ((exp), (orientation), (status), ())")
def a6(spark, sf):
    x = _sorted_out(spark, sf).select("exp", F.col("rc").alias("orientation"), "status", (F.col("fwd_dist") + F.col("rev_dist")).cast("long").alias("d"))
    aggs = [F.count("*").alias("reads"), r6(F.count_if(F.col("status") == "mapped") / F.count("*")).alias("mapping_rate"), r6(F.avg("d")).alias("mean_dist"), r6(F.median("d")).alias("median_dist"), r6(F.stddev_pop("d")).alias("std_dist"), F.min("d").alias("min_dist"), F.max("d").alias("max_dist")]
    return x.groupingSets([["exp"], ["orientation"], ["status"], []], "exp", "orientation", "status").agg(*aggs)


@query("k3_files_by_experiment", f"{_OUT} SELECT cast(CASE WHEN status = 'mapped' THEN exp ELSE -1 END AS bigint) AS exp, count(*) AS records, sum(length(CASE WHEN status = 'mapped' THEN payload ELSE s END)) AS bases FROM r GROUP BY 1")
def k3(spark, sf):
    """FASTQ files in a folder for each experiment and one for reads that weren't mapped (-1), read back."""
    path = _folder(spark)
    r = _sorted_out(spark, sf)
    mapped = F.col("status") == "mapped"
    named = r.select(F.concat_ws("_", F.col("cluster_id").cast("string"), F.col("read_no").cast("string")).alias("read_id"), F.when(mapped, F.col("payload")).otherwise(F.col("s")).alias("seq"), F.when(mapped, F.col("payload_qual")).otherwise(F.col("qual")).alias("qual"), F.when(mapped, F.col("exp")).otherwise(-1).alias("exp"))
    scans.write_fastq(named, path, by="exp")
    back = scans.fastq(spark, path, by="exp")
    return back.groupBy("exp").agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("bases"))


def _csv(spark, df):
    path = _folder(spark)
    df.write.option("header", True).csv(path)
    return spark.read.schema(df.schema).option("header", True).csv(path)


@query("k7_read_metadata", f"{_OUT} SELECT concat(cast(cluster_id AS varchar), '_', cast(read_no AS varchar)) AS read_id, exp AS exp_id, CASE rc WHEN 1 THEN 'reverse_complement' ELSE 'forward' END AS orientation, fwd_pos, rev_pos, fwd_dist, rev_dist, fwd_dist + rev_dist AS total_dist, length(payload) AS payload_length, length(s) AS original_length FROM r WHERE status = 'mapped'")
def k7_reads(spark, sf):
    """The CSV of mapped reads' metadata, written and read back."""
    r = _sorted_out(spark, sf).where("status = 'mapped'")
    turned = F.when(F.col("rc") == 1, "reverse_complement").otherwise("forward")
    return _csv(spark, r.select(F.concat_ws("_", F.col("cluster_id").cast("string"), F.col("read_no").cast("string")).alias("read_id"), F.col("exp").alias("exp_id"), turned.alias("orientation"), "fwd_pos", "rev_pos", "fwd_dist", "rev_dist", (F.col("fwd_dist") + F.col("rev_dist")).alias("total_dist"), F.length("payload").alias("payload_length"), F.length("s").alias("original_length")))


@query("k7_truth_metadata", f"{VIEWS}, pr AS (SELECT cast(e AS bigint) AS exp, substr(translate(md5(concat('f', cast(e AS varchar))), {_HEX}), 1, 12) AS f, substr(translate(md5(concat('r', cast(e AS varchar))), {_HEX}), 1, 12) AS r FROM range(0, 13) t(e)) SELECT gt_id AS id, exp, gt AS payload, f AS forward_primer, r AS reverse_primer, length(gt) AS payload_length, gt_id % 11 <> 0 AS primers_at_expected_pos FROM gt JOIN pr ON exp = gt_id % 13")
def k7_truths(spark, sf):
    """The CSV of ground truths' metadata, written and read back."""
    both = j6(spark, sf).join(F.broadcast(primers(spark)), "exp")
    return _csv(spark, both.select(F.col("gt_id").alias("id"), "exp", "payload", F.col("f").alias("forward_primer"), F.col("r").alias("reverse_primer"), F.length("payload").alias("payload_length"), F.col("at_ends").alias("primers_at_expected_pos")))
