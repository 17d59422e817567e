"""Round trips of result tables: CSV, TSV, JSON, Parquet and experiment folders (S7-S13, K5-K14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators.encoding import shifted_pairs, shown
from ..operators.joins import approximate_hits, best_match
from ..operators.metrics import r6
from ..sources import scans
from ..sources.fixture import VIEWS, clusters, ground_truth, reads
from ._register import ORACLES, QUERIES, query
from .clustering import _SHIFTED, _shifted
from .clustering import shortest_unique_prefix
from .noisy import approximate_twin, match_twin
from .sources import _folder
from .voting import _SCORED, _scored


def _through(spark, df: DataFrame, kind: str, **options) -> DataFrame:
    """df written to a new folder and read again by its own schema."""
    path = _folder(spark)
    df.write.format(kind).options(**options).save(path)
    return spark.read.schema(df.schema).format(kind).options(**options).load(path)


_RAW = f"{VIEWS} SELECT cluster_id, rd.gt AS gt, string_agg(read, '|' ORDER BY read_no) AS reads FROM rd GROUP BY ALL"


@query("s7_labelled_clusters", f"SELECT gt, reads FROM ({_RAW})")
def s7(spark, sf):
    path = _folder(spark)
    scans.write_labelled_clusters(clusters(spark, sf).withColumnRenamed("cluster_id", "idx"), path)
    return scans.labelled_clusters(spark, path).select("gt", F.array_join("reads", "|").alias("reads"))


_ID = "concat(cast(cluster_id AS varchar), '_', cast(read_no AS varchar)) AS read_id"


@query("s8_k7_f12_clustering_csv", f"{_SHIFTED}, {approximate_twin('sh', 20, 1)}, m AS ({match_twin('sh')}) SELECT {_ID}, gt_id, pos AS match_pos, edit_dist, status, hits AS num_matches FROM m WHERE hits > 0")
def s8(spark, sf):
    """Results of the clustering within one edit as CSV with a header: place and distance of the match, -1 and `unmapped` where there
    is none. Read back, the sentinels are nulls, and mapped and ambiguous reads are kept."""
    s = _shifted(spark, sf)
    found = best_match(s, approximate_hits(s, ground_truth(spark, sf), 20, 1))
    path = _folder(spark)
    scans.write_clustering_results(found.withColumn("read_id", F.concat_ws("_", F.col("cluster_id").cast("string"), F.col("read_no").cast("string"))), path)
    return scans.clustering_results(spark, path).where(F.col("status").isin("mapped", "mapped_ambiguous"))


@query("s10_k10_position_parquet", ORACLES["a17_w3_position_metrics"])
def s10(spark, sf):
    return _through(spark, QUERIES["a17_w3_position_metrics"](spark, sf), "parquet")


@query("s11_cluster_json", f"SELECT CASE WHEN cluster_id % 3 = 0 THEN substr(gt, 1, 12) ELSE concat('c', cast(cluster_id AS varchar)) END AS index, gt AS data, reads FROM ({_RAW})")
def s11(spark, sf):
    """Every third cluster is written without its index, which is then the data's prefix."""
    path = _folder(spark)
    index = F.when(F.col("cluster_id") % 3 != 0, F.concat(F.lit("c"), F.col("cluster_id").cast("string")))
    clusters(spark, sf).select(index.alias("index"), F.col("gt").alias("data"), F.col("reads").alias("noisy_copies")).write.json(path)
    return scans.cluster_json(spark, path, 12).select("index", "data", F.array_join("noisy_copies", "|").alias("reads"))


@query("k11_statistics_json", f"{VIEWS}, c AS (SELECT cluster_id, count(*) AS n FROM rd GROUP BY ALL) SELECT n AS cluster_size, count(*) AS clusters, n * count(*) AS reads FROM c GROUP BY n")
def k11(spark, sf):
    n = reads(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n")).groupBy(F.col("n").alias("cluster_size")).agg(F.count("*").alias("clusters"))
    return _through(spark, n.withColumn("reads", F.col("cluster_size") * F.col("clusters")), "json")


@query("k11_prefix_json", f"{VIEWS}, l AS (SELECT min(k) AS k FROM (SELECT k, count(DISTINCT substr(gt, 1, k)) = count(*) AS u FROM gt, (SELECT cast(k AS int) AS k FROM range(1, 31) t(k)) GROUP BY k) WHERE u) SELECT substr(gt, 1, k) AS prefix, gt_id, k AS prefix_length, (SELECT count(*) FROM gt) AS num_prefixes FROM gt, l")
def k11_prefixes(spark, sf):
    """The prefixes that tell ground truths apart: one object of their length and number, and one for each prefix, as there are as many
    as ground truths."""
    truths, folder = ground_truth(spark, sf), _folder(spark)
    info = shortest_unique_prefix(truths, "gt").select(F.col("length").alias("prefix_length")).crossJoin(truths.agg(F.count("*").alias("num_prefixes")))
    scans.write_json_object(info, f"{folder}/info")
    info = scans.json_object(spark, f"{folder}/info", info.schema)
    prefixes = truths.crossJoin(F.broadcast(info)).select(F.expr("substring(gt, 1, prefix_length)").alias("prefix"), "gt_id")
    prefixes.write.json(f"{folder}/prefixes")
    return spark.read.schema(prefixes.schema).json(f"{folder}/prefixes").crossJoin(F.broadcast(info))


@query("k11_dataset_json", ORACLES["a37_p2_split_statistics"])
def k11_dataset(spark, sf):
    """Statistics of the splits as one object with a key for each split."""
    stats = QUERIES["a37_p2_split_statistics"](spark, sf)
    values = [c for c in stats.columns if c != "split"]
    whole = stats.agg(F.map_from_entries(F.collect_list(F.struct("split", F.struct(*values)))).alias("splits"))
    path = _folder(spark)
    scans.write_json_object(whole, path)
    return scans.json_object(spark, path, whole.schema).select(F.explode("splits").alias("split", "s")).select("split", "s.*")


@query("k11_processing_json", f"WITH a AS MATERIALIZED ({ORACLES['a6_demux_statistics']}) SELECT 'experiment' AS by, cast(exp AS varchar) AS key, reads FROM a WHERE exp IS NOT NULL UNION ALL SELECT 'orientation', cast(orientation AS varchar), reads FROM a WHERE orientation IS NOT NULL UNION ALL SELECT 'status', status, reads FROM a WHERE status IS NOT NULL")
def k11_processing(spark, sf):
    """Numbers of demultiplexed reads by experiment, orientation and status as one nested object."""
    stats = QUERIES["a6_demux_statistics"](spark, sf)
    name = {"experiment": "exp", "orientation": "orientation", "status": "status"}
    entry = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("string").alias("key"), "reads"))))
    whole = stats.agg(*(entry(c).alias(by) for by, c in name.items()))
    path = _folder(spark)
    scans.write_json_object(whole, path)
    read = scans.json_object(spark, path, whole.schema)
    parts = [read.select(F.lit(by).alias("by"), F.explode(by).alias("key", "reads")) for by in name]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("k11_summary_json", ORACLES["a16_frequency_evaluation"])
def k11_summary(spark, sf):
    return _through(spark, QUERIES["a16_frequency_evaluation"](spark, sf), "json")


@query("s12_result_lines", f"{VIEWS} SELECT cluster_id AS idx, levenshtein(read, gt) AS lev, CASE WHEN length(read) = length(gt) THEN hamming(read, gt) ELSE -1 END AS ham, read AS estimate, gt AS original FROM rd")
def s12(spark, sf):
    path = _folder(spark)
    ham = F.when(F.length("read") == F.length("gt"), S.hamming(F.col("gt"), F.col("read"))).otherwise(-1)
    reads(spark, sf).select(F.concat_ws(", ", F.col("cluster_id").cast("string"), ham.cast("string"), F.levenshtein("read", "gt").cast("string"), "read", "gt")).write.text(path)
    return scans.result_lines(spark, path).select("idx", "ham", "lev", "estimate", "original")


@query("s13_experiment_folders", f"{VIEWS} SELECT cluster_id % 5 AS experiment, kind, count(*) AS n, sum(length(read)) AS bases FROM rd WHERE cluster_id % 5 <> 3 GROUP BY ALL")
def s13(spark, sf):
    """Five experiments of which one has no folder; the scan reads those there in one plan."""
    folder = _folder(spark)
    stats = reads(spark, sf).groupBy((F.col("cluster_id") % 5).alias("e"), "kind").agg(F.count("*").alias("n"), F.sum(F.length("read")).alias("bases"))
    stats = _through(spark, stats, "parquet")
    for e in (0, 1, 2, 4):
        stats.where(F.col("e") == e).drop("e").write.option("header", True).csv(f"{folder}/experiment_{e}")
    return scans.experiments(spark, folder, "kind long, n long, bases long").select("experiment", "kind", "n", "bases")


@query("k5_pair_csv", f"{VIEWS} SELECT read, gt FROM rd")
def k5(spark, sf):
    return _through(spark, reads(spark, sf).select("read", "gt"), "csv", header=True)


@query("k6_ragged_csv", f"SELECT cast(cluster_id AS varchar) AS key, reads FROM ({_RAW})")
def k6(spark, sf):
    path = _folder(spark)
    scans.write_ragged(clusters(spark, sf).select(F.col("cluster_id").alias("key"), "reads"), path)
    return scans.ragged(spark, path).select("key", F.array_join("reads", "|").alias("reads"))


@query("k9_per_size_csv", f"SELECT * EXCLUDE (n), coalesce(cast(n AS varchar), 'all') AS n FROM ({ORACLES['a8_reconstruction_metrics']})")
def k9(spark, sf):
    """Reconstruction metrics by cluster size, and the row of all clusters under the name `all`."""
    m = QUERIES["a8_reconstruction_metrics"](spark, sf)
    return _through(spark, m.withColumn("n", F.coalesce(F.col("n").cast("string"), F.lit("all"))), "csv", header=True)


@query("k9_per_example_csv", f"{_SCORED}, pk AS (SELECT cluster_id, string_agg(read, '|' ORDER BY read_no) AS reads FROM rd GROUP BY 1) SELECT n, reads, gt AS ground_truth, consensus AS prediction, round(ham, 6) AS hamming, round(lev, 6) AS levenshtein FROM sc JOIN pk USING (cluster_id)")
def k9_examples(spark, sf):
    """One line an example: its size, reads, ground truth and prediction, and their distances as shares of the length."""
    packed = clusters(spark, sf).select("cluster_id", F.array_join("reads", "|").alias("reads"))
    each = _scored(spark, sf).join(packed, "cluster_id")
    out = each.select("n", "reads", F.col("gt").alias("ground_truth"), F.col("consensus").alias("prediction"), r6(F.col("ham")).alias("hamming"), r6(F.col("lev")).alias("levenshtein"))
    return _through(spark, out, "csv", header=True)


@query("k12_worst_tsv", ORACLES["t4_worst_share_by_size"])
def k12(spark, sf):
    return _through(spark, QUERIES["t4_worst_share_by_size"](spark, sf), "csv", header=True, sep="\t")


@query("k13_misclustering_csv", ORACLES["j11_a12_misclustering_rate"])
def k13(spark, sf):
    return _through(spark, QUERIES["j11_a12_misclustering_rate"](spark, sf), "csv", header=True)


@query("k14_encoded_dataset", f"{VIEWS}, t AS (SELECT cluster_id, read_no, rpad(concat(read, ':', gt), 256, '#') AS s FROM rd), p AS (SELECT cluster_id, read_no, i, strpos('ACGT-|:#', substr(s, cast(i AS int), 1)) - 1 AS id FROM t, range(1, 257) r(i)) SELECT cluster_id, read_no, string_agg(cast(id AS varchar), ',' ORDER BY i) FILTER (WHERE i < 256) AS x, string_agg(cast(id AS varchar), ',' ORDER BY i) FILTER (WHERE i > 1) AS y FROM p GROUP BY ALL")
def k14(spark, sf):
    rows = reads(spark, sf).select("cluster_id", "read_no", F.concat("read", F.lit(":"), "gt").alias("s"))
    return shown(_through(spark, shifted_pairs(rows, "s", 256), "parquet"), "x", "y")
