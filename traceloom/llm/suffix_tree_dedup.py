"""Operator 7: word-level substring deduplication by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._repeats import Segments, repeated_spans
from ._shared import read, tidy


def deep_nodes(values: np.ndarray, at: np.ndarray, depth: int, group: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (indices into `at`) and node numbers of the internal nodes at `depth` symbols of the suffix
    tree of the suffixes at `at`.

    Prefixes grow by doubling: suffixes whose prefix nobody shares are leaves of shallow nodes and leave;
    each group of equal prefixes that has come down to `group` suffixes is a subtree of its own, whose
    suffixes are put in order by their prefix hashes at the remaining depths.
    """
    hashes = T.Rolling(values)
    levels = [d for d in (1 << i for i in range(1, 30)) if d < depth] + [depth]
    live = np.arange(len(at))
    for k, d in enumerate(levels):
        key = hashes.spans(at[live], at[live] + d)
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        shared = same[1:] | same[:-1]
        live, key = live[shared], key[shared]
        if d == depth or not len(live):
            break
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        if np.diff(np.append(np.flatnonzero(head), len(key))).max() <= group:
            return _subtrees(hashes, at, live, np.cumsum(head) - 1, levels[k + 1 :])
    head = np.ones(len(live), bool)
    head[1:] = key[1:] != key[:-1]
    return live, np.cumsum(head) - 1


def _subtrees(hashes: T.Rolling, at: np.ndarray, live: np.ndarray, prefix: np.ndarray, depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The deepest nodes of the subtrees under each prefix: children split at each depth, single leaves left out."""
    node = prefix
    for d in depths:
        key = hashes.spans(at[live], at[live] + d)
        order = np.lexsort((key, node))
        live, key, node = live[order], key[order], node[order]
        head = np.ones(len(live), bool)
        head[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        child = np.cumsum(head) - 1
        leaves = np.bincount(child)[child] if len(child) else child
        live, node = live[leaves > 1], child[leaves > 1]
    return live, np.unique(node, return_inverse=True)[1] if len(node) else node


def confirmed(values: np.ndarray, at: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    """Nodes split where leaves that share a hash differ in one of their `depth` symbols."""
    head = np.full(node.max(initial=-1) + 1, len(node))
    np.minimum.at(head, node, np.arange(len(node)))
    same = np.ones(len(node), bool)
    for k in range(depth):
        same &= values[at + k] == values[at[head[node]] + k]
    odd = np.flatnonzero(~same)
    if len(odd):
        rows = np.unique(values[at[odd][:, None] + np.arange(depth)], axis=0, return_inverse=True)[1]
        node = node.copy()
        node[odd] = len(head) + rows.ravel()
    return node


def match(window: int):
    def run(s: Segments) -> list[list[tuple[int, int, int, int]]]:
        leaf, node = deep_nodes(s.values, s.at, window)
        node = confirmed(s.words(), s.at[leaf], node, window)
        leaves = np.bincount(node)[node] if len(node) else node
        leaf, node = leaf[leaves > 1], np.unique(node[leaves > 1], return_inverse=True)[1]
        first = s.doc[s.owner].copy()
        repeated = s.copies[s.owner] > 1
        repeated[leaf] = True
        least = np.full(node.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, first[leaf])
        first[leaf] = least[node]
        return s.runs(repeated, first)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, out = batch.column(2).to_pylist(), [[], [], [], []]
        for row, offsets, data in T.pieces(batch.column(1)):
            starts, ends, at = T.words(offsets, data)
            for k in range(len(offsets) - 1):
                lo, hi = at[k], at[k + 1]
                got = spans[row + k] or []
                gone = T.covered(np.array([x["a"] for x in got], np.int64), np.array([x["b"] for x in got], np.int64), hi - lo)
                whole = data[offsets[k] : offsets[k + 1]].tobytes()
                if gone.any():
                    rest = kept = b" ".join(data[a:b].tobytes() for a, b in zip(starts[lo:hi][~gone], ends[lo:hi][~gone], strict=True))
                else:
                    rest, kept = whole, b" ".join(whole.split())
                for c, v in zip(out, (int(hi - lo), int(gone.sum()), hashlib.sha256(kept).hexdigest(), rest.decode()), strict=True):
                    c.append(v)
        none = np.asarray(batch.column(1).is_null())
        arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string(), mask=none)]
        yield pa.RecordBatch.from_arrays(arrays + [batch.column(i) for i in range(3, batch.num_columns)], ["doc_id", "n_words", "n_removed", "kept_sha256", "rest", *batch.schema.names[3:]])


def suffix_tree_dedup(docs: DataFrame, window: int = 50, gram: int = 10, carry: dict[str, Column] | None = None) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document with a smaller doc_id.

    Words are runs without ASCII white space. docs: doc_id long, text string; the columns `carry` (by name in the
    result) come back too, others are ignored.
    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), rest (these, or
    the text as it was where nothing is removed, null for null). Null text:
    no words. A text of fewer than `window` words keeps all; a very long one is worked in one numpy pass of its
    task. A row without doc_id stays whole and matches nothing. Rows of one doc_id, with equal or different
    texts, don't remove each other, and each is cut by its own text. An empty table gives an empty result.
    """
    carry = carry or {}
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    spans = repeated_spans(plain, "word", window, gram, match(window), lambda doc, pos, first_doc, first_pos: doc > first_doc)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), *(c.alias(f"carried_{k}") for k, c in enumerate(carry.values()))).withColumn("tag", F.xxhash64("text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:-1]]
    joined = rows.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans", *(f"carried_{k}" for k in range(len(carry))))
    out = joined.mapInArrow(tidy(_remove), ", ".join(["doc_id long, n_words long, n_removed long, kept_sha256 string, rest string", *kinds]))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "rest", *(F.col(f"carried_{k}").alias(name) for k, name in enumerate(carry)))


def op7_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_dedup(read(spark, sf_dir, "documents")).drop("rest")
