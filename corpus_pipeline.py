"""Corpus pipeline: quality classifier, near-duplicate removal, substring removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm._shared import read, table
from traceloom.llm.gam_quality import gam_quality
from traceloom.llm.order_minhash import near_duplicates
from traceloom.llm.pattern_packing import pack_documents, word_vocabulary
from traceloom.llm.suffix_tree_dedup import suffix_tree_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts (score of 0.7 or more), whatever their doc_id: a row without doc_id, and each
    of several rows of one doc_id, is judged by its own text. Null text: empty. An empty table stays empty."""
    others = [c for c in docs.columns if c != "text"]
    scored = gam_quality(docs, read(spark, sf_dir, "labels"), carry={f"own_{c}": F.col(c) for c in others}, keep_text=True)
    return scored.where("predicted = 1").select(*(F.col("text" if c == "text" else f"own_{c}").alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each class of near copies. Rows of one doc_id with different texts are
    documents of their own; equal rows are copies, of which one stays. A row without doc_id or without text stays.
    Columns of any name are kept as they are. An empty table stays empty."""
    spare = [c + "_" * max(map(len, docs.columns)) for c in ("id", "hash")]  # longer than, so unlike, all names of docs
    kept = near_duplicates(docs).where("kept and text_hash is not null").select(F.col("doc_id").alias(spare[0]), F.col("text_hash").alias(spare[1]))
    usable = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    rows = docs.where(usable).withColumn(spare[0], F.col("doc_id").cast("long")).withColumn(spare[1], F.xxhash64("text"))
    out = rows.join(kept.distinct(), spare, "left_semi").dropDuplicates(spare)
    return out.select(docs.columns).union(docs.where(~usable))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller doc_id has. Texts that lose
    nothing stay as they are; others are their kept words joined by one space. Rows of one doc_id don't cut
    each other; a row without doc_id or text stays whole. Columns of any name but text and n_chars are kept as they are. An empty
    table stays empty."""
    cut = suffix_tree_dedup(docs, carry={f"own_{c}": F.col(c) for c in docs.columns if c != "text"})
    n_chars = F.when(F.col("n_removed") > 0, F.length("rest").cast("long")).otherwise(F.col("own_n_chars"))
    return cut.select(*((F.col("rest") if c == "text" else n_chars if c == "n_chars" else F.col(f"own_{c}")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept texts and their places in sequences of 4096 tokens. Null or empty text: its end token alone, a piece as
    well; repeated rows are packed once each, a null doc_id stays null. An empty table gives no pieces."""
    return pack_documents(docs, word_vocabulary())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The stages aren't expressible in SQL; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return table(STAGES[-1][1](spark, docs, sf_dir))
