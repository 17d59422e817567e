"""Text scans with positional identity, and the sinks that write the same formats."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Line between clusters (fixed by the format).
SEPARATOR = "=" * 31


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table of files, in ``spark.checkpoint.dir``; a local master has a local one where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="traceloom-")
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run here go when it ends, as nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again, so that what reads it several times doesn't make it again. Its shuffle files go when it is written."""
    path = shared_folder(df.sparkSession, "kept")
    with shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def indexed(df: DataFrame, across: bool = False) -> DataFrame:
    """value, file, idx: the place of each row in its file, or with `across` in all files in the order of their names. Only
    the rows' counts by file block meet in one place; no text is moved into one partition to be numbered."""
    raw = df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mono"))
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("mono").alias("first"))
    order = Window.orderBy("file", "block") if across else Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(counts.withColumn("before", before), ["file", "block"]).select("value", "file", (F.col("before") + F.col("mono") - F.col("first")).alias("idx"))


def lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    return indexed(spark.read.text(path), across)


def cluster_file(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, reads: clusters ended by a separator line; an empty cluster keeps its row and place."""
    rows = indexed(spark.read.text(path, lineSep=SEPARATOR + "\n"), across=True)
    return rows.select("file", "idx", F.filter(F.split("value", "\n"), lambda x: x != "").alias("reads"))


def with_ground_truth(clusters: DataFrame, truths: DataFrame) -> DataFrame:
    """Clusters and ground truths paired by place; a row of either side without the other raises."""
    both = clusters.join(truths.select("idx", F.col("value").alias("gt")), "idx", "full")
    missing = F.col("gt").isNull() | F.col("reads").isNull()
    return both.select("idx", "reads", F.when(missing, F.raise_error(F.lit("clusters and ground truths differ in number")).cast("string")).otherwise(F.col("gt")).alias("gt"))


def packed_examples(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """idx, reads, gt of lines `r1|r2:gt`; lines without ':' are skipped. by: the key of the folders, which comes back too."""
    rows = lines(spark, path).where(F.col("value").contains(":"))
    key = [F.regexp_extract("file", f"/{by}=([^/]+)/", 1).alias(by)] if by else []
    return rows.select("idx", F.split(F.split_part("value", F.lit(":"), F.lit(1)), "\\|").alias("reads"), F.split_part("value", F.lit(":"), F.lit(2)).alias("gt"), *key)


def fastq(spark: SparkSession, path: str, by: str | None = None) -> DataFrame:
    """read_id, seq, qual, four lines a record; plain or gzip. by: the key of the folders, which comes back as a long."""
    # Lines of records pack so well that partitions of the usual bytes would hold millions: eight for each part of the files.
    rows = lines(spark, path).repartition(8 * spark.read.text(path).rdd.getNumPartitions(), "file", F.expr("idx div 4"))
    part = lambda k: F.max(F.when(F.col("idx") % 4 == k, F.col("value")))
    records = rows.groupBy("file", F.expr("idx div 4").alias("record")).agg(F.substr(part(0), F.lit(2)).alias("read_id"), part(1).alias("seq"), part(3).alias("qual"))
    key = [F.regexp_extract("file", f"/{by}=(-?[0-9]+)/", 1).cast("long").alias(by)] if by else []
    return records.select("read_id", "seq", "qual", *key)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """idx, id, seq in record order; sequences may span lines."""
    rows = indexed(spark.read.text(path, lineSep=">")).where("value <> ''")
    parts = F.split("value", "\n")
    return rows.select((F.col("idx") - 1).alias("idx"), parts[0].alias("id"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "").alias("seq"))


def labelled_clusters(spark: SparkSession, path: str) -> DataFrame:
    """idx, gt, reads of blocks: label, ****, reads, two empty lines."""
    rows = indexed(spark.read.text(path, lineSep="\n\n\n"), across=True).where("value <> ''")
    parts = F.split(F.rtrim("value"), "\n")
    return rows.select("idx", parts[0].alias("gt"), F.slice(parts, F.lit(3), F.size(parts)).alias("reads"))


def cluster_json(spark: SparkSession, path: str, index_length: int) -> DataFrame:
    """index, data, noisy_copies of one JSON object a line; a missing index is the data's prefix."""
    rows = spark.read.schema("index string, data string, noisy_copies array<string>").json(path)
    return rows.select(F.coalesce("index", F.substring("data", 1, index_length)).alias("index"), "data", "noisy_copies")


def result_lines(spark: SparkSession, path: str) -> DataFrame:
    """idx, ham, lev, estimate, original of lines with commas and any blanks around them, without a header."""
    schema = "idx long, ham long, lev long, estimate string, original string"
    return spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def experiments(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """experiment and the columns of CSV files under experiment_<id> folders: all of them in one plan, missing ones absent."""
    rows = spark.read.schema(schema).option("header", True).csv(f"{folder}/experiment_*")
    return rows.select(F.regexp_extract("_metadata.file_path", r"experiment_(\d+)", 1).cast("long").alias("experiment"), "*")


def ragged(spark: SparkSession, path: str) -> DataFrame:
    """key, reads of lines `key,r1,r2,...` of any number of reads."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(parts[0].alias("key"), F.slice(parts, F.lit(2), F.size(parts)).alias("reads"))


def in_order(df: DataFrame, order: str, value: Column | str, path: str, line_sep: str = "\n", parts: int | None = None) -> None:
    """Rows' text in order, in files whose names are in order too: what follows one another in the names' order is one
    positional file. Each task writes a range; none writes all. A value made of df's columns is made after they are dealt."""
    dealt = df.repartitionByRange(parts, order) if parts else df.repartitionByRange(order)
    dealt.sortWithinPartitions(order).select(F.col(value) if isinstance(value, str) else value.alias("value")).write.option("lineSep", line_sep).text(path)


def write_clusters(df: DataFrame, folder: str, reads: Column | str = "reads", gt: Column | str = "gt", parts: int | None = None) -> None:
    """reads and ground_truth files of df (idx, and what reads and gt are made of), in one order."""
    reads, gt = (F.col(c) if isinstance(c, str) else c for c in (reads, gt))
    body = F.concat(F.array_join(reads, "\n"), F.when(F.size(reads) > 0, "\n").otherwise(""))
    in_order(df, "idx", body, f"{folder}/reads", SEPARATOR + "\n", parts)
    in_order(df, "idx", gt, f"{folder}/ground_truth", parts=parts)


def write_labelled_clusters(df: DataFrame, path: str) -> None:
    """df (idx, reads, gt) as blocks: label, ****, reads, two empty lines."""
    block = F.concat("gt", F.lit("\n****\n"), F.array_join("reads", "\n"))
    in_order(df.select("idx", block.alias("v")), "idx", "v", path, "\n\n\n")


def write_clustering_results(df: DataFrame, path: str) -> None:
    """df (read_id, gt_id, pos, edit_dist, status, hits) as CSV with a header; what is missing is written as -1, and a missing gt_id as unmapped."""
    none = lambda c: F.coalesce(c, F.lit(-1)).alias
    df.select("read_id", F.coalesce(F.col("gt_id").cast("string"), F.lit("unmapped")).alias("gt_id"), none("pos")("match_pos"), none("edit_dist")("edit_dist"), "status", F.col("hits").alias("num_matches")).write.csv(path, header=True)


def clustering_results(spark: SparkSession, path: str) -> DataFrame:
    """read_id, gt_id, match_pos, edit_dist, status, num_matches; -1 and unmapped are nulls."""
    rows = spark.read.schema("read_id string, gt_id string, match_pos int, edit_dist int, status string, num_matches long").csv(path, header=True)
    seen = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return rows.select("read_id", F.when(F.col("gt_id") != "unmapped", F.col("gt_id")).cast("long").alias("gt_id"), seen("match_pos"), seen("edit_dist"), "status", "num_matches")


def write_json_object(df: DataFrame, path: str) -> None:
    """A table of one row as one JSON object, fields without a value included."""
    df.write.option("ignoreNullFields", False).json(path)


def json_object(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_ragged(df: DataFrame, path: str) -> None:
    """df (key, reads) as one line a cluster."""
    df.select(F.concat_ws(",", F.col("key").cast("string"), "reads")).write.text(path)


def write_fastq(df: DataFrame, path: str, by: str | None = None, gzip: bool = False) -> None:
    """df (read_id, seq, qual) as records of four lines; by: a folder for each value of that column."""
    text = df.select(F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "seq", F.lit("+"), "qual"), *([by] if by else []))
    writer = text.write.option("compression", "gzip") if gzip else text.write
    (writer.partitionBy(by) if by else writer).text(path)


def write_fasta(df: DataFrame, path: str, append: bool = False) -> None:
    """df (id, seq) as records; append: beside those that are in the folder already."""
    df.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq")).write.mode("append" if append else "errorifexists").text(path)
