"""Operator 1: nearest neighbours through a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vectors as V
from ._shared import read, table


class Tree:
    """centres of all nodes; children of each node (none: a leaf). The fullest node is split next, until
    there are `leaves` leaves: a query's visits then depend on the tree and not on the number of rows."""

    def __init__(self, sample: np.ndarray, branching: int, leaves: int, seed: int, least: int = 8):
        self.rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [sample.mean(axis=0)] if len(sample) else [np.zeros(1)]
        self.children: list[list[int]] = [[]]
        todo, ends = [(-len(sample), 0, sample)], 1
        while todo and ends < leaves:
            _, node, rows = heapq.heappop(todo)
            if len(rows) <= least:
                break
            label, centres = self._split(rows, branching)
            if len(centres) < 2:
                continue  # copies of one vector: no split parts them
            for k, c in enumerate(centres):
                self.children[node].append(len(self.centres))
                self.centres.append(c)
                self.children.append([])
                mine = rows[label == k]
                heapq.heappush(todo, (-len(mine), len(self.centres) - 1, mine))
            ends += len(centres) - 1
        self.table = np.array(self.centres)
        self.leaves = [i for i, c in enumerate(self.children) if not c]

    def _split(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        centres = np.unique(rows[self.rng.choice(len(rows), min(k, len(rows)), replace=False)], axis=0)
        for _ in range(8):
            label = (((rows**2).sum(1)[:, None] - 2 * rows @ centres.T) + (centres**2).sum(1)).argmin(1)
            used = np.unique(label)
            centres = np.array([rows[label == j].mean(axis=0) for j in used])
        label = (((rows**2).sum(1)[:, None] - 2 * rows @ centres.T) + (centres**2).sum(1)).argmin(1)
        used, label = np.unique(label, return_inverse=True)
        return label, centres[used]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down through the nearest centres."""
        at = np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            nodes = at[live]
            for node in np.unique(nodes):
                if c := self.children[node]:
                    mine = live[nodes == node]
                    t = self.table[c]
                    at[mine] = np.array(c)[((t**2).sum(1) - 2 * rows[mine] @ t.T).argmin(1)]
            live = live[[bool(self.children[i]) for i in at[live]]]
        return at

    def visits(self, query: np.ndarray, most: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first `most` leaves in best-bin-first order, and further ones until they hold `least` rows (held: rows
        of each leaf): the branch with the largest product next, whatever its depth."""
        queue, out, rows = [(0.0, 0)], [], 0
        while queue and (len(out) < most or (held is not None and rows < least)):
            _, node = heapq.heappop(queue)
            while c := self.children[node]:
                near = self.table[c] @ query
                best = int(near.argmax())
                for k, i in enumerate(c):
                    if k != best:
                        heapq.heappush(queue, (-near[k], i))
                node = c[best]
            out.append(node)
            rows += held.get(node, 0) if held else 0
        return out


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, good = V.matrix(batch.column(1), dim)
            good &= ~np.asarray(batch.column(0).is_null())
            ids = batch.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes() for v in values[good].astype("<f8")], pa.binary())], ["vec_id", "v"])

    return run


def _leaf(tree: Tree, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = tree.assign(V.rows(batch.column(1).to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at)], ["vec_id", "v", "leaf"])

    return run


def _visit(tree: Tree, dim: int, most: int, held: dict[int, int] | None, least: int, buckets: int):
    """For each query a row for each bucket of leaves that it visits: the leaves and their places in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, bucket, leaves, places = [], [], [], []
            for i, q in enumerate(V.rows(batch.column(1).to_pylist(), dim)):
                visited = np.array(tree.visits(q, most, held, least), np.int64)
                of = visited % buckets
                for b in np.unique(of).tolist():
                    mine = np.flatnonzero(of == b)
                    which.append(i)
                    bucket.append(b)
                    leaves.append(visited[mine].astype("<i4").tobytes())
                    places.append(mine.astype("<i4").tobytes())
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(bucket, pa.int32()), pa.array(leaves, pa.binary()), pa.array(places, pa.binary())], ["query_id", "q", "bucket", "leaves", "places"])

    return run


_FOUND = "query_id long, found array<struct<minus:double,vec_id:long,visit:int>>"


def _score(dim: int, k: int, chunk: int = 512):
    """The k nearest rows for each query among those of its leaves in one block of a bucket."""

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out_ids, out = [], []
        if len(queries) and len(rows):
            rows = rows.sort_values(["leaf", "vec_id"])
            ids, x, leaf = rows["vec_id"].to_numpy(np.int64), V.rows(rows["v"].tolist(), dim), rows["leaf"].to_numpy(np.int64)
            leaves, begin = np.unique(leaf, return_index=True)
            ends = np.append(begin[1:], len(leaf))
            longest = np.linalg.norm(x, axis=1).max()
            for lo in range(0, len(queries), chunk):
                part = queries.iloc[lo : lo + chunk]
                q, asked = part["query_id"].to_numpy(np.int64), V.rows(part["q"].tolist(), dim)
                want = [np.frombuffer(v, "<i4") for v in part["leaves"]]
                of = np.repeat(np.arange(len(q)), [len(v) for v in want])
                want, place = np.concatenate(want), np.concatenate([np.frombuffer(v, "<i4") for v in part["places"]])
                s, visit = np.full((len(q), len(ids)), -np.inf), np.zeros((len(q), len(leaves)), np.int64)
                for j, name in enumerate(leaves):
                    here = np.flatnonzero(want == name)
                    if len(here):
                        s[of[here], begin[j] : ends[j]] = asked[of[here]] @ x[begin[j] : ends[j]].T
                        visit[of[here], j] = place[here]
                s[q[:, None] == ids[None, :]] = -np.inf
                # The matrix product is off by rounding only: all within that of the k-th are scored exactly.
                if len(ids) > k:
                    slack = 1e-12 * np.linalg.norm(asked, axis=1) * longest
                    least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] - slack
                    r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                else:
                    r, c = np.nonzero(np.isfinite(s))
                exact = V.paired(asked, x, r, c)
                order = np.lexsort((ids[c], -exact, r))
                r, c, exact = r[order], c[order], exact[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c, exact = r[keep], c[keep], exact[keep]
                cut = np.searchsorted(r, np.arange(len(q) + 1))
                seen = visit[r, np.searchsorted(begin, c, "right") - 1]
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    mine = slice(cut[i], cut[i + 1])
                    out_ids.append(q[i])
                    out.append([{"minus": m, "vec_id": v, "visit": w} for m, v, w in zip((-exact[mine]).tolist(), ids[c[mine]].tolist(), seen[mine].tolist(), strict=True)])
        return pd.DataFrame({"query_id": pd.Series(out_ids, dtype="int64"), "found": pd.Series(out, dtype=object)})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score, visit: the k best of what the blocks found, ties to the smaller vec_id."""
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", (-F.col("b.minus")).alias("score"), "b.visit")


def _search(index: DataFrame, visits: DataFrame, splits: int, dim: int, k: int) -> DataFrame:
    """What each query finds in the leaves that it visits, a row for each block with an answer. A bucket's rows are dealt in
    blocks and the queries in splits, so that neither a hot leaf nor many queries make a large task."""
    blocks = index.groupBy("bucket").agg((F.max("block") + 1).alias("blocks"))
    asked = visits.join(F.broadcast(blocks), "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = asked.withColumn("split", F.pmod(F.xxhash64("query_id"), F.lit(splits)).cast("int"))
    rows = index.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return asked.groupBy("bucket", "block", "split").cogroup(rows.groupBy("bucket", "block", "split")).applyInPandas(_score(dim, k), _FOUND)


def _hashed(df: DataFrame, seed: int, share: float) -> DataFrame:
    """The rows whose vec_id's hash lies in the first `share` of all hashes."""
    return df.where((F.xxhash64(F.lit(seed), "vec_id") / 2.0**64 + 0.5) < share)


def kmeans_tree_search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, dim: int | None = None, sample: int = 20_000, branching: int = 12, leaf_rows: int = 64, calibration: int = 128, block_rows: int = 4096, query_rows: int = 8192, seed: int = 5) -> DataFrame:
    """Each query's k rows of largest inner product (double precision, original vectors), ties to smaller vec_id.

    vectors: vec_id long, embedding array of numbers; is_query (of vec_id) picks the queries among them. The tree is
    fitted on about `sample` rows (those of least hash) and has a leaf for each `leaf_rows` rows, 144 at least and one for
    16 sampled rows at most; every row is indexed. Leaves share buckets of about `block_rows` rows, and a query goes once to
    each bucket with the leaves that it visits there. How many leaves a query visits is calibrated: about `calibration`
    queries are compared with all rows, and the visits widen until their recall is `recall`; a query
    whose leaves hold fewer than k candidates goes on to further leaves. Returns query_id, rank (from 1), vec_id,
    score, visits (leaves allowed to all). `dim` is the length of most vectors if not given. Vectors that are null,
    zero, of another length, or with null or non-finite components take no part. Fewer candidates than k: all. Copies
    tie and are ordered by id. Rows that repeat a vec_id are one (of different vectors the least in byte order). A null
    vec_id takes no part. No usable vectors: an empty result. Other columns are ignored.
    """
    if dim is None:
        dim = V.usual_length(vectors)
    packed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_pack(dim), "vec_id long, v binary")
    packed = table(packed.groupBy("vec_id").agg(F.min("v").alias("v")))
    n, asking = packed.agg(F.count("*"), F.count_if(F.coalesce(is_query, F.lit(False)))).first()
    picked = _hashed(packed, seed, sample / max(n, 1)).orderBy("vec_id").select("v").toPandas()["v"].tolist()
    rows = V.rows(picked, dim)
    tree = Tree(rows, branching, int(min(max(144, n / leaf_rows), max(144, len(rows) / 16))), seed)
    buckets = max(1, round(n / block_rows))
    indexed = packed.mapInArrow(_leaf(tree, dim), "vec_id long, v binary, leaf long").withColumn("bucket", (F.col("leaf") % buckets).cast("int"))
    held = table(indexed.groupBy("bucket", "leaf").agg(F.count("*").alias("held")))
    blocks = held.groupBy("bucket").agg(F.ceil(F.sum("held") / (2 * block_rows)).alias("blocks"))
    indexed = indexed.join(F.broadcast(blocks), "bucket").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), "blocks").cast("int"))
    index = table(indexed.select("bucket", "leaf", "block", "vec_id", "v"))

    queries = packed.where(is_query)
    splits = max(1, -(-asking // query_rows))
    asked = _hashed(queries, seed + 1, calibration / max(asking, 1))
    every = asked.mapInArrow(_visit(tree, dim, len(tree.leaves), None, 0, buckets), "query_id long, q binary, bucket int, leaves binary, places binary")
    truth = _top(_search(index, every, 1, dim, k), k).groupBy("visit").agg(F.count("*").alias("hits")).orderBy("visit").collect()
    allowed, found, total = 1, 0, sum(r["hits"] for r in truth)
    for r in truth:  # the places of the true neighbours' leaves in the visiting order say how recall grows
        if found >= recall * total:
            break
        allowed, found = r["visit"] + 1, found + r["hits"]
    sizes = {r["leaf"]: r["held"] for r in held.collect()}
    visits = queries.mapInArrow(_visit(tree, dim, allowed, sizes, k + 1, buckets), "query_id long, q binary, bucket int, leaves binary, places binary")
    return _top(_search(index, visits, splits, dim, k), k).select("query_id", "rank", "vec_id", "score", F.lit(allowed).alias("visits"))


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree_search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
