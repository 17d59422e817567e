"""Keyed values, restored order, metric keys, adjusted p, distinct strings and composition over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import seeded
from ..operators import errors as E
from ..operators.metrics import r6
from ..sources.fixture import VIEWS, ground_truth, reads, table
from ._edits import CLASSES
from ._register import query


@query("f18_keyed_values", "SELECT event_id, value FROM events WHERE event_type = 'click'")
def f18(spark, sf):
    return table(spark, sf, "events").where("event_type = 'click'").select("event_id", "value")


@query("t6_restored_order", f"{VIEWS} SELECT cluster_id, read_no, read FROM rd ORDER BY cluster_id, read_no")
def t6(spark, sf):
    """Reads dealt out in hash order and put back by their key: a range-partitioned sort."""
    dealt = reads(spark, sf).repartition(seeded("deal", F.col("cluster_id"), F.col("read_no")))
    return dealt.select("cluster_id", "read_no", "read").orderBy("cluster_id", "read_no")


@query("u3_distinct_reads", f"{VIEWS} SELECT read, count(*) AS n FROM rd GROUP BY read")
def u3(spark, sf):
    return reads(spark, sf).groupBy("read").agg(F.count("*").alias("n"))


_METRICS = {"ham_N=5": 0, "ham_N=10": 1, "lev_cropped_N=5": 2, "lev_k=7": 3, "all/ham_N=5": 4}


def _unpivoted() -> str:
    cases = " UNION ALL ".join(f"SELECT event_type, '{key}' AS k, round(avg(value) FILTER (WHERE user_id % 5 = {i}), 6) AS v FROM events GROUP BY event_type" for key, i in _METRICS.items())
    parts = "SELECT event_type, regexp_extract(k, '(ham|lev)', 1) AS metric, contains(k, '_cropped') AS cropped, cast(regexp_extract(k, '[Nk]=([0-9]+)', 1) AS int) AS n, starts_with(k, 'all/') AS whole, v FROM u"
    return f"WITH u AS ({cases}), p AS ({parts}) SELECT event_type, metric, cropped, n, coalesce(max(v) FILTER (WHERE whole), max(v) FILTER (WHERE NOT whole)) AS value FROM p GROUP BY ALL"


@query("a31_metric_keys", _unpivoted())
def a31(spark, sf):
    """A run's metrics by key, unpivoted into metric, crop and size; a key under `all/` goes before the plain one."""
    pairs = [c for key, i in _METRICS.items() for c in (F.lit(key), r6(F.avg(F.when(F.col("user_id") % 5 == i, F.col("value")))))]
    runs = table(spark, sf, "events").groupBy("event_type").agg(F.create_map(*pairs).alias("metrics"))
    flat = runs.select("event_type", F.explode("metrics").alias("k", "v"))
    keys = (F.regexp_extract("k", "(ham|lev)", 1).alias("metric"), F.col("k").contains("_cropped").alias("cropped"), F.regexp_extract("k", "[Nk]=([0-9]+)", 1).cast("int").alias("n"))
    whole = F.col("k").startswith("all/")
    return flat.groupBy("event_type", *keys).agg(F.coalesce(F.max(F.when(whole, F.col("v"))), F.max(F.when(~whole, F.col("v")))).alias("value"))


@query("w6_adjusted_p", f"{VIEWS}, g AS (SELECT part % 100 AS pos, count(*) AS n, avg(CASE WHEN read = gt THEN 0 ELSE 1 END) AS share FROM rd GROUP BY 1), m AS (SELECT avg(CASE WHEN read = gt THEN 0 ELSE 1 END) AS base FROM rd), t AS (SELECT pos, least(1.0, 2 * exp(-2 * n * (share - base) * (share - base))) AS p FROM g, m), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, pos) AS q, row_number() OVER (ORDER BY p, pos) AS k FROM t) SELECT pos, round(p, 6) AS p, round(least(1.0, min(q) OVER (ORDER BY k DESC)), 6) AS p_adjusted FROM r")
def w6(spark, sf):
    """Share of wrong reads by place against the overall share (Hoeffding's bound), adjusted over the 100 places."""
    wrong = F.avg(F.when(F.col("read") == F.col("gt"), 0).otherwise(1))
    r = reads(spark, sf)
    places = r.groupBy((F.col("part") % 100).alias("pos")).agg(F.count("*").alias("n"), wrong.alias("share"))
    off = F.col("share") - F.col("base")
    tests = places.join(r.agg(wrong.alias("base"))).select("pos", F.least(F.lit(1.0), 2 * F.exp(-2 * F.col("n") * off * off)).alias("p"))
    return E.benjamini_hochberg(tests).select("pos", r6(F.col("p")).alias("p"), r6(F.col("p_adjusted")).alias("p_adjusted"))


@query("m18_homopolymer_cover", f"{VIEWS} SELECT gt_id, length(gt) - length(regexp_replace(gt, 'A{{3,}}|C{{3,}}|G{{3,}}|T{{3,}}', '', 'g')) AS covered FROM gt WHERE regexp_matches(gt, 'AAA|CCC|GGG|TTT')")
def m18(spark, sf):
    hp = E.homopolymers(ground_truth(spark, sf), "gt_id", "gt")
    return hp.groupBy("gt_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


@query("m22_compute", "SELECT p_partkey, 12 * p_size * (64 * (1 + p_partkey % 12)) * (64 * (1 + p_partkey % 12)) AS parameters, cast(6 AS double) * (12 * p_size * (64 * (1 + p_partkey % 12)) * (64 * (1 + p_partkey % 12))) * 1000000 AS flops FROM part")
def m22(spark, sf):
    """Parameters 12 L d d and training operations 6 N D of configurations taken from the parts (L by size, d by key)."""
    d = 64 * (1 + F.col("p_partkey") % 12)
    n = (12 * F.col("p_size") * d * d).cast("long")
    return table(spark, sf, "part").select("p_partkey", n.alias("parameters"), (6.0 * n * 1000000).alias("flops"))


@query("m19_common_subsequence", f"{VIEWS} SELECT cluster_id, read_no, least(length(gt), length(read)) - CASE WHEN length(gt) = length(read) AND gt <> read THEN 1 ELSE 0 END AS lcs FROM rd")
def m19(spark, sf):
    """Length of the longest common subsequence of each read and its ground truth."""
    return E.common_subsequence(reads(spark, sf).select("cluster_id", "read_no", "gt", "read")).select("cluster_id", "read_no", "lcs")


@query("m17_homopolymer_class", f"{CLASSES} SELECT op, hp_class, count(*) AS n FROM cl GROUP BY ALL")
def m17(spark, sf):
    """Operations between reads and ground truths by their effect on homopolymers."""
    return E.homopolymer_counts(reads(spark, sf)).where("what = 'operation'").groupBy("op", "hp_class").agg(F.sum("n").alias("n"))
