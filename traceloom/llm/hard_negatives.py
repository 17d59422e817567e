"""Operator 12: hard negatives by a secondary sort of packed pair scores."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vectors as V
from ._shared import buckets, read, table
from .norm_buckets import WHOLE, best

#: Big-endian and unsigned, so that keys sort as bytes: anchor, score (turned: high scores first), kind, id.
_KEY = struct.Struct(">QQBQ")
_SIGN, _ALL = 1 << 63, (1 << 64) - 1
POSITIVE, NEGATIVE = 0, 1


def pack_keys(anchor: np.ndarray, score: np.ndarray, kind: int, other: np.ndarray) -> list[bytes]:
    return [_KEY.pack(a + _SIGN, _ALL - (s + _SIGN), kind, o + _SIGN) for a, s, o in zip(anchor.tolist(), score.tolist(), other.tolist(), strict=True)]


def unpack_key(key: bytes) -> tuple[int, int, int, int]:
    a, s, kind, o = _KEY.unpack(key)
    return a - _SIGN, _ALL - s - _SIGN, kind, o - _SIGN


def floor_of_window(positive: np.ndarray | int) -> np.ndarray | int:
    """The least whole score of at least 80 hundredths of `positive`, without leaving 64 bits."""
    return positive - positive // 5


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            packed, good, _ = V.whole(batch.column(1), dim)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep), pa.array(packed, pa.binary())], ["vec_id", "label", "v"])

    return run


def _read(of: pa.Table, names: tuple[str, str, str], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, label, v = (of[c] for c in names)
    return ids.to_numpy(), label.to_numpy(), V.whole_rows(v.to_pylist(), dim)


def _positives(dim: int, k: int, chunk: int = 256):
    """Keys of each anchor's k best rows of its label in one block of rows."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        keys: list[bytes] = []
        if anchors.num_rows and rows.num_rows:
            a_id, a_label, a = _read(anchors, ("anchor_id", "anchor_label", "anchor"), dim)
            ids, label, x = _read(rows, ("vec_id", "label", "v"), dim)
            for name in np.unique(a_label):
                mine, others = np.flatnonzero(a_label == name), np.flatnonzero(label == name)
                for i in range(0, len(mine) if len(others) else 0, chunk):
                    some = mine[i : i + chunk]
                    score, barred = V.products(a[some], x[others]), a_id[some][:, None] == ids[others][None, :]
                    if len(others) > k:
                        kept = np.where(barred, np.iinfo(np.int64).min, score)
                        barred |= score < np.partition(kept, len(others) - k, axis=1)[:, len(others) - k][:, None]
                    r, c = np.nonzero(~barred)
                    r, c, found = best(r, others[c], score[r, c], ids, k)
                    keys += pack_keys(a_id[some[r]], found, POSITIVE, ids[c])
        return pa.table({"key": pa.array(keys, pa.binary())})

    return run


def _negatives(dim: int, k: int, chunk: int = 64):
    """Keys of the k best rows of other labels in each window of each anchor, in one block of rows. Windows of one anchor
    overlap; a row is written once."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        keys: list[bytes] = []
        if anchors.num_rows and rows.num_rows:
            a_id, a_label, a = _read(anchors, ("anchor_id", "anchor_label", "anchor"), dim)
            highs = anchors["highs"].to_pylist()
            ids, label, x = _read(rows, ("vec_id", "label", "v"), dim)
            for i in range(0, len(a_id), chunk):
                tops = [sorted({h for h in own if h >= 0}, reverse=True) for own in highs[i : i + chunk]]
                score = V.products(a[i : i + chunk], x)
                high = np.array([t[0] if t else -1 for t in tops])
                low = np.array([floor_of_window(t[-1]) if t else 0 for t in tops])
                r, c = np.nonzero((score <= high[:, None]) & (score >= low[:, None]) & (label[None, :] != a_label[i : i + chunk, None]))
                value = score[r, c]
                order = np.lexsort((ids[c], -value, r))
                r, c, value = r[order], c[order], value[order]
                cut = np.searchsorted(r, np.arange(len(tops) + 1))
                take: list[np.ndarray] = []
                for j, own in enumerate(tops):
                    falling = -value[cut[j] : cut[j + 1]]
                    for t in own:
                        start = np.searchsorted(falling, -t)
                        end = min(start + k, np.searchsorted(falling, -floor_of_window(t), "right"))
                        take.append(np.arange(cut[j] + start, cut[j] + end))
                at = np.unique(np.concatenate(take)) if take else np.zeros(0, np.int64)
                keys += pack_keys(a_id[i + r[at]], value[at], NEGATIVE, ids[c[at]])
        return pa.table({"key": pa.array(keys, pa.binary())})

    return run


def _in_order(keys: DataFrame, parts: int) -> DataFrame:
    """The secondary sort: an anchor's keys go to one partition, where all keys are sorted as bytes; big ones spill."""
    return keys.select("key", F.substring("key", 1, 8).alias("anchor")).repartition(parts, "anchor").sortWithinPartitions("key").select("key")


def _first_positives(k: int):
    """Streams sorted keys; the first k of each anchor are its positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, seen = None, 0
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                a, score, _, other = unpack_key(key)
                if a != anchor:
                    anchor, seen = a, 0
                seen += 1
                if seen <= k:
                    out.append((a, other, score))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "positive_id", "positive_score"])

    return run


def _stream(k: int):
    """Streams sorted keys: a positive opens a window, a negative goes to each open window it is in. A window closes when it is
    full or the scores have fallen out of it, so an anchor has no more in memory than its open windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                a, score, kind, other = unpack_key(key)
                if a != anchor:
                    anchor, windows = a, []
                if kind == POSITIVE:
                    if score >= 0:
                        windows.append([other, score, floor_of_window(score), 0])
                    continue
                windows = [w for w in windows if w[3] < k and score >= w[2]]
                for w in windows:
                    w[3] += 1
                    out.append((a, w[0], w[3], other, w[1], score))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, dim: int | None = None, block_rows: int = 16_384, anchor_rows: int = 4096, seed: int = 12) -> DataFrame:
    """For each anchor its first `positives` other rows of the same label, and for each of these the first `negatives` rows of
    another label that score from 80 to 100 hundredths of it. Scores are integer inner products, components floor(256 x);
    higher ones come first, ties to smaller vec_id.

    vectors: vec_id long, embedding, label; is_anchor (of vec_id) picks the anchors, `label` is the label to use. Anchors meet all
    rows in blocks, twice: for the positives, then, with their scores known, for the negatives. A block writes no more
    than can be wanted of it, as packed keys (anchor, falling score, kind, id). One shuffle by anchor sorts these within
    partitions, and an iterator over the sorted keys opens a window at each positive and emits negatives as they come;
    no anchor's rows are gathered.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Rows with a null vec_id or label,
    a null vector, null or non-finite components, or another length than `dim` (that of most, if not given) take no part;
    zero vectors do. Rows that repeat a vec_id are one (the least in byte order, then by label). A positive of negative
    score has no window. No usable vectors: an empty result. Other columns are ignored. Scores that don't fit a long wrap.
    """
    if dim is None:
        dim = V.usual_length(vectors)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", (F.col("label") if label is None else label).cast("long").alias("label")).where("label is not null")
    rows = rows.mapInArrow(_pack(dim), "vec_id long, label long, v binary").groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x"))
    rows = table(rows.select("vec_id", "x.label", "x.v"))
    n, asking = rows.agg(F.count("*"), F.count_if(F.coalesce(is_anchor, F.lit(False)))).first()
    blocks, splits = buckets(n, block_rows), buckets(asking, anchor_rows)
    # Both sides of a cogroup need keys of one type: int and long of the same value hash to different partitions.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("anchor"), F.pmod(F.xxhash64("vec_id"), F.lit(splits)).cast("int").alias("split"))

    def meet(asked: DataFrame, kernel) -> DataFrame:
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return asked.groupBy("block", "split").cogroup(dealt.groupBy("block", "split")).applyInArrow(kernel, "key binary")

    parts = buckets(asking * blocks, 50_000, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = _in_order(meet(anchors, _positives(dim, positives)), parts).mapInArrow(_first_positives(positives), "anchor_id long, positive_id long, positive_score long")
    near = table(near)
    # At most `positives` scores an anchor.
    highs = near.groupBy("anchor_id").agg(F.collect_list("positive_score").alias("highs"))
    far = meet(anchors.join(highs, "anchor_id"), _negatives(dim, negatives))
    again = near.mapInArrow(_keys_of_positives, "key binary")
    return _in_order(again.unionByName(far), parts).mapInArrow(_stream(negatives), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _keys_of_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, other, score = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(pack_keys(a, score, POSITIVE, other), pa.binary())], ["key"])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


ORACLE = f"""WITH {WHOLE}, m AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM e WHERE label IS NOT NULL),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::bigint AS score FROM m a JOIN m b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
  p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
  n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
