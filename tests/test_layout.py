"""Length batches and their layout, few-shot prompts, statistics files."""

import re

from pyspark.sql import functions as F

from traceloom.functions import sequence as S
from traceloom.operators.layout import length_batches, write_batches
from traceloom.sources import scans


def exchanges(df):
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


def test_length_batches_by_hand(spark):
    """Many rows of one length, keys in no order, null lengths, columns with the operator's own names."""
    rows = [((i * 7919) % 20011, 100 if i % 3 else i % 17, i) for i in range(20011)] + [(30000 + i, None, -1) for i in range(5)]
    d = spark.createDataFrame(rows, "key long, n int, place int").withColumnRenamed("place", "x")
    got = {r.key: (r.place, r.batch) for r in length_batches(d, "n", "key", 100).collect()}
    order = sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[0]))
    assert got == {key: (i, i // 100) for i, (key, _, _) in enumerate(order)}
    assert length_batches(d.where("false"), "n", "key").count() == 0


def test_layout_reads_back_without_a_shuffle(spark):
    d = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 91).alias("n"))
    laid = write_batches(length_batches(d, "n", "key", 64), scans.shared_folder(spark, "batches"), 4)
    other = write_batches(length_batches(d, "n", "key", 64), scans.shared_folder(spark, "batches"), 4)
    by_batch = laid.groupBy("batch").agg(F.count("*").alias("rows"), F.max("n") - F.min("n"))
    assert exchanges(by_batch) == 0
    assert sorted(r.rows for r in by_batch.collect()) == [5000 % 64] + [64] * (5000 // 64)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(laid.join(other, "batch")) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert laid.select("key").distinct().count() == 5000
    # A bucket's file is in order of place.
    for part in laid.select("place", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list("place").alias("p")).collect():
        assert part.p == sorted(part.p)


def test_few_shot_prompts(spark):
    d = spark.createDataFrame([("AC|G:ACG",), ("T:T",), (None,)], "packed string").select(S.worked_example(F.col("packed")).alias("e"))
    texts = [r.e for r in d.collect()]
    assert texts == ["1. AC\n2. G\nCorrect output:\nACG", "1. T\nCorrect output:\nT", None]
    shot = lambda *e: spark.createDataFrame([(list(e),)], "e array<string>").select(S.few_shot(F.col("e"))).first()[0]
    assert shot(texts[1]) == "\nHere is an example:\n" + texts[1]
    assert shot(*texts[:2]) == "\nHere are some examples:\n" + texts[0] + "\n" + texts[1]


def test_json_object_keeps_fields_without_value(spark):
    one = spark.sql("select 3L as n, cast(null as double) as mean, map('a', named_struct('x', 1)) as by")
    path = scans.shared_folder(spark, "json")
    scans.write_json_object(one, path)
    assert '"mean":null' in spark.read.text(path).first()[0]
    assert scans.json_object(spark, path, one.schema).collect() == one.collect()


def test_fastq_ids_are_whole(spark):
    name = "r" * ((1 << 20) + 7)
    path = scans.shared_folder(spark, "fastq")
    scans.write_fastq(spark.createDataFrame([(name, "ACGT", "IIII")], "read_id string, seq string, qual string"), path)
    assert scans.fastq(spark, path).first()["read_id"] == name
