"""Operator 8: exact byte-level deduplication by longest-previous-factor arrays over suffix order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._repeats import Segments, repeated_spans
from ._shared import read, tidy


def suffix_ranks(data: np.ndarray, window: int) -> np.ndarray:
    """Rank of every suffix of data cut to `window` bytes (prefix doubling from 8-byte words)."""
    n = len(data)
    rank, h = np.zeros(n, np.uint64), min(8, window)
    padded = np.concatenate([data, np.zeros(window + 8, np.uint8)])
    for i in range(h):
        rank = (rank << np.uint64(8)) | padded[i : i + n]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while h < window:
        step = min(h, window - h)
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        h += step
    return rank


def previous_factors(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places in text order with the rank of their suffixes: whether the suffix has a full match at an
    earlier place, and the first such place (itself if none).

    Places in suffix order whose neighbours share the whole window form runs. Inside a run the previous
    and the next smaller place (running minima from both sides) are the only ones that can give the
    longest previous factor.
    """
    n = len(rank)
    order = np.argsort(rank, kind="stable")  # ties in text order
    head = np.ones(n, bool)
    head[1:] = rank[order][1:] != rank[order][:-1]
    run = np.cumsum(head) - 1
    # Offsetting each run by its number keeps the running minimum inside the run.
    low = np.minimum.accumulate(order - run * n) + run * n
    previous = np.full(n, n)
    previous[1:] = np.where(head[1:], n, low[:-1])
    up = order[::-1] - (run.max() - run[::-1]) * n if n else order
    low = np.minimum.accumulate(up) + (run.max() - run[::-1]) * n if n else order
    following = np.full(n, n)
    following[: n - 1] = np.where(head[1:], n, low[::-1][1:])
    first = np.empty(n, np.int64)
    first[order] = np.minimum(np.minimum(previous, following), order)
    return first != np.arange(n), first


def match(window: int, sources: bool):
    def run(s: Segments) -> list[list[tuple[int, int, int, int]]]:
        rank = suffix_ranks(s.values, window)[s.at]
        earlier, first = previous_factors(rank)
        later = np.zeros(len(rank), bool)
        later[first[earlier]] = True
        repeated = earlier | later | (s.copies[s.owner] > 1)
        if not sources:
            return s.runs(repeated)
        # Windows stand in the order of segments' first occurrences, which isn't that of the windows.
        place = s.pos[s.owner] + s.off
        best = np.lexsort((place, s.doc[s.owner], rank))
        head = np.ones(len(best), bool)
        head[1:] = np.diff(rank[best]) != 0
        source = np.empty(len(best), np.int64)
        source[best] = best[np.flatnonzero(head)][np.cumsum(head) - 1]
        return s.runs(repeated, s.doc[s.owner][source], place[source])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, out = batch.column(2).to_pylist(), [[], [], [], [], []]
        for row, offsets, data in T.pieces(batch.column(1)):
            for k in range(len(offsets) - 1):
                text, got = data[offsets[k] : offsets[k + 1]], spans[row + k] or []
                gone = T.covered(np.array([x["a"] for x in got], np.int64), np.array([x["b"] for x in got], np.int64), len(text))
                kept = text[~gone].tobytes()
                edge = np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1
                for c, v in zip(out, (len(text), int(gone.sum()), int(edge.sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(v)
        arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def lpf_dedup(docs: DataFrame, window: int = 400, gram: int = 64, keep_first: bool = False) -> DataFrame:
    """Remove every byte covered by a `window`-byte string that also starts elsewhere (any document).

    docs: doc_id long, text string; other columns are ignored. With keep_first, the earliest occurrence
    (least doc_id, then place) stays, which is what a longest-previous-factor array marks; without it,
    occurrences with a later match go too. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept
    (binary: the cut can split a character). Null text: empty. Texts under `window` bytes keep all. A row
    without doc_id stays whole and matches nothing. A repeated row is one more occurrence of its text; rows of
    one doc_id with different texts are each cut by their own. A very long text is worked in one numpy pass
    of its task. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))

    def later(doc, pos, first_doc, first_pos):
        return ((doc > first_doc) | ((doc == first_doc) & (pos > first_pos))) if keep_first else F.lit(True)

    spans = repeated_spans(rows, "byte", window, gram, match(window, keep_first), later)
    return rows.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans").mapInArrow(tidy(_remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup(read(spark, sf_dir, "documents")).drop("kept")
