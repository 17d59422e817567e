"""Operator 4: shards cut from proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import buckets, read, table


def _global_rank(rows: DataFrame, group: list[str], bucket: str, order: list[Column], to: str) -> DataFrame:
    """Add `to`: the rank from 0 within group by (bucket, order). Buckets are ranges of the order, small enough
    for one task each; ranks within a bucket get the counts of the buckets before, so no group is sorted whole."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*group, bucket, F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(counts, [*group, bucket]).withColumn(to, F.col("_before") + F.col("_own")).drop("_own", "_before")


def shuffle_key(seed: int) -> Column:
    """The place in the seeded shuffle of a row's copy."""
    return F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "size", "text_crc32", "copy")


def stratified_shards(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_rows: int = 20_000) -> DataFrame:
    """Put every row of docs (doc_id long, text string, source string) into shards 0 to `shards` - 1.

    Rows are shuffled by a seeded hash of doc_id, ranked within their source, and interleaved by fractional
    rank (rank + 1/2) / rows of the source; the sequence is cut into shards whose counts differ by one at
    most, so every shard holds each source in proportion. Law `rows`. Returns doc_id, size (UTF-8 bytes of
    the text, null: none, plus 1), text_crc32, law, shard, slot, grown_shard (null: this law moves rows when
    a shard is added). Null source: a source of its own. Null text: crc32 of no bytes. Repeated rows each get
    a slot. An empty table gives an empty result.

    Rows that are equal in all that comes back are counted and then dealt anew as copies 0, 1, ..., in blocks of
    `bucket_rows`. The hash that shuffles them takes the copy's number, size and checksum beside doc_id, so rows
    without doc_id, or of one doc_id, spread over all ranges as other rows do.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {bucket_rows}")))).repartition("doc_id", "source", "text_crc32", "block")
    last = F.least(F.col("copies"), (F.col("block") + 1) * bucket_rows) - 1
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("block") * bucket_rows, last))).drop("copies", "block")
    rows = table(rows.withColumn("key", shuffle_key(seed)))
    sizes = rows.groupBy("source").agg(F.count("*").alias("of_source"))
    n = rows.count()
    ranges = buckets(n, bucket_rows, 16)
    unit = F.col("key").cast("double") / float(1 << 64) + 0.5
    rows = rows.withColumn("range", F.least(F.floor(unit * ranges), F.lit(ranges - 1)).cast("long"))
    rows = _global_rank(rows, ["source"], "range", [F.col(c) for c in ("key", "doc_id", "size", "text_crc32", "copy")], "rank")
    rows = rows.join(sizes, "source").withColumn("fraction", (F.col("rank") + 0.5) / F.col("of_source"))
    rows = rows.withColumn("part", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1)).cast("long")).withColumn("all", F.lit(0))
    rows = _global_rank(rows, ["all"], "part", [F.col(c) for c in ("fraction", "source", "rank")], "place")
    # Whole-number cuts: place * shards div n, and the first place of each shard.
    rows = rows.withColumn("shard", F.expr(f"cast(place * {shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(cast(shard as long) * {n} + {shards} - 1) div {shards}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(read(spark, sf_dir, "documents"))
