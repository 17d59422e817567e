"""Operator 11: exact search for the largest inner products over buckets of vectors of like length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _vectors as V
from ._shared import buckets, read, table

#: Lengths and cosines are off by rounding only; bounds give way by this share.
SLACK = 1e-9


def pack(dim: int):
    """vec_id, v (integers) and norm of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            packed, good, norm = V.whole(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(packed, pa.binary()), pa.array(norm)], ["vec_id", "v", "norm"])

    return run


def near_range(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a unit vector's coordinate must lie, given a unit query's q there and the least cosine between the two: the angles
    to the axis differ by no more than the angle between them."""
    cosine = np.clip(cosine, -1, 1)
    side = np.sqrt((1 - q * q).clip(0) * (1 - cosine * cosine))
    low = np.where(q <= -cosine, -1.0, q * cosine - side)  # the two angles pass a straight angle
    high = np.where(q >= cosine, 1.0, q * cosine + side)  # the query's cone holds the axis
    return low - SLACK, high + SLACK


def best(r: np.ndarray, c: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, smaller id) of each r."""
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], score[keep]


class Bucket:
    """Vectors of like length, longest first. A query's least cosine to them follows from its threshold and their lengths."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: np.ndarray):
        order = np.argsort(-norm, kind="stable")
        self.ids, self.x, self.norm = ids[order], x[order], norm[order]
        unit = self.x / np.maximum(self.norm, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").T  # rows by each coordinate
        self.sorted = np.take_along_axis(unit, self.order.T, axis=0).T

    def search(self, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, focus: int = 3, share: float = 0.05, chunk: int = 256) -> tuple[np.ndarray, ...]:
        """query's place, row, score: the k best of each query that score at least its `least`.

        By length: only rows as long as least / |q| can score enough. By coordinate: among the `focus` largest coordinates of
        the query, the one whose range of `near_range` holds the fewest rows. A query takes that where it leaves less than `share`
        of the rows, as its rows are then fetched one by one. What is left is verified by exact products."""
        n = len(self.ids)
        q_norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.where(least > 0, least / q_norm, 0.0)  # a zero query scores 0
        reach = n - np.searchsorted(self.norm[::-1], bound * (1 - SLACK))
        found: list[tuple[np.ndarray, ...]] = []
        unit = q / np.maximum(q_norm, 1e-300)[:, None]
        cosine = np.where(self.norm[0] > 0, bound / max(self.norm[0], 1e-300), 0.0)
        try_ = np.flatnonzero((cosine > 0) & (reach > 0))
        by_length = np.ones(len(q), bool)
        if len(try_):
            axes = np.argsort(-np.abs(unit[try_]), axis=1)[:, :focus]
            width, lo, hi = (np.empty(axes.shape, np.int64) for _ in range(3))
            for f in range(axes.shape[1]):
                low, high = near_range(unit[try_, axes[:, f]], cosine[try_])
                for axis in np.unique(axes[:, f]):
                    m = axes[:, f] == axis
                    lo[m, f], hi[m, f] = np.searchsorted(self.sorted[axis], low[m], "left"), np.searchsorted(self.sorted[axis], high[m], "right")
            width = np.maximum(hi - lo, 0)
            pick = width.argmin(axis=1)
            few = width[np.arange(len(try_)), pick] < share * reach[try_]
            for i, f in zip(np.flatnonzero(few).tolist(), pick[few].tolist(), strict=True):
                at = try_[i]
                by_length[at] = False
                rows = self.order[axes[i, f], lo[i, f] : max(hi[i, f], lo[i, f])]
                rows = rows[(rows < reach[at]) & (self.ids[rows] != q_ids[at])]
                score = V.products(q[at : at + 1], self.x[rows])[0]
                enough = score >= least[at]
                found.append(best(np.full(enough.sum(), at), rows[enough], score[enough], self.ids, k))
        live = np.flatnonzero(by_length & (reach > 0))
        live = live[np.argsort(-reach[live], kind="stable")]
        for i in range(0, len(live), chunk):
            some = live[i : i + chunk]
            m = int(reach[some[0]])
            score = V.products(q[some], self.x[:m])
            barred = (np.arange(m) >= reach[some][:, None]) | (self.ids[:m] == q_ids[some][:, None])
            bar = least[some].astype(np.float64)
            if m > k:
                kept = np.where(barred, np.iinfo(np.int64).min, score)
                bar = np.maximum(bar, np.partition(kept, m - k, axis=1)[:, m - k].astype(np.float64))
            r, c = np.nonzero((score >= bar[:, None]) & ~barred)
            found.append(best(some[r], c, score[r, c], self.ids, k))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_FOUND = "query_id long, vec_id long, score long"


def _cell(dim: int, k: int):
    """The k best rows of one block of a bucket for each query sent to it."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if queries.num_rows and rows.num_rows:
            held = Bucket(rows["vec_id"].to_numpy(), V.whole_rows(rows["v"].to_pylist(), dim), rows["norm"].to_numpy())
            ids = queries["query_id"].to_numpy()
            r, c, score = held.search(ids, V.whole_rows(queries["q"].to_pylist(), dim), queries["least"].to_numpy(), k)
            out = [ids[r], held.ids[c], score]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out), strict=True)))

    return run


def _meet(asked: DataFrame, index: DataFrame, splits: int, dim: int, k: int) -> DataFrame:
    """What queries (query_id, q, least, bucket, block) find. Queries are dealt in splits, rows in blocks: one task holds one
    of each."""
    asked = asked.withColumn("split", F.pmod(F.xxhash64("query_id"), F.lit(splits)).cast("int"))
    rows = index.select("bucket", "block", "vec_id", "v", "norm", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    return asked.groupBy("bucket", "block", "split").cogroup(rows.groupBy("bucket", "block", "split")).applyInArrow(_cell(dim, k), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, cut in each task before and after the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def largest_products(vectors: DataFrame, is_query: Column, k: int = 5, dim: int | None = None, most_buckets: int = 32, block_rows: int = 16_384, query_rows: int = 8192, sample: int = 20_000, seed: int = 11) -> DataFrame:
    """Each query's k rows of largest integer inner product, components floor(256 x), ties to smaller vec_id: exact.

    vectors: vec_id long, embedding array of numbers; is_query (of vec_id) picks the queries among them. Rows fall into at most
    `most_buckets` buckets by length (bounds from about `sample` rows, those of least hash; they decide cost alone), each in
    blocks of about `block_rows`. A query's k-th best in one block of the longest gives a threshold that its answers reach.
    Buckets whose vectors are too short for it are left out; in others its least cosine is higher the shorter
    they are, and picks the pruning (`Bucket.search`). Queries times blocks is the work where lengths are alike.

    Returns query_id, rank (from 1), vec_id, score. Vectors that are null, of another length than `dim` (that of most, if not
    given) or with null or non-finite components take no part; zero vectors do. Fewer candidates than k: all. Rows that repeat
    a vec_id are one (of different vectors the least in byte order). A null vec_id takes no part. No usable vectors: an
    empty result. Other columns are ignored. Scores that don't fit a long wrap.
    """
    if dim is None:
        dim = V.usual_length(vectors)
    packed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(pack(dim), "vec_id long, v binary, norm double")
    packed = table(packed.groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x")).select("vec_id", "x.v", "x.norm"))
    n, asking = packed.agg(F.count("*"), F.count_if(F.coalesce(is_query, F.lit(False)))).first()
    sampled = packed.where((F.xxhash64(F.lit(seed), "vec_id") / 2.0**64 + 0.5) < sample / max(n, 1)).select("norm")
    norms = np.sort(np.array([r["norm"] for r in sampled.collect()]))[::-1]
    wanted = min(most_buckets, buckets(n, block_rows))
    bounds = np.unique([norms[len(norms) * i // wanted] for i in range(1, wanted)] if len(norms) else [])[::-1].tolist()
    bucket = sum(((F.col("norm") < b).cast("int") for b in bounds), F.lit(0))
    index = packed.withColumn("bucket", bucket)
    held = {r["bucket"]: r for r in index.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    # At most `most_buckets` rows: number, length of the longest, blocks.
    plan = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(float(r["longest"])).alias("longest"), F.lit(buckets(r["n"], block_rows)).alias("blocks")) for b, r in sorted(held.items()))) if held else F.array().cast("array<struct<bucket:int,longest:double,blocks:int>>")
    blocks = F.filter(plan, lambda p: p["bucket"] == F.col("bucket"))[0]["blocks"]
    index = table(index.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), blocks).cast("int")))

    splits = buckets(asking, query_rows)
    queries = packed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("q_norm"))
    lowest = F.lit(-(1 << 63))
    first = queries.select("query_id", "q", lowest.alias("least"), F.lit(min(held, default=0)).alias("bucket"), F.lit(0).alias("block"))
    seeds = _first(_meet(first, index.where((F.col("bucket") == min(held, default=0)) & (F.col("block") == 0)), splits, dim, k), k)
    seeds = table(seeds.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")))
    asked = queries.join(seeds, "query_id", "left").withColumn("least", F.coalesce("least", lowest))
    reach = F.filter(plan, lambda p: F.col("least") <= F.greatest(F.col("q_norm") * p["longest"] * (1 + SLACK), F.lit(0.0)))
    asked = asked.select("query_id", "q", "least", F.explode(reach).alias("b"))
    asked = asked.select("query_id", "q", "least", "b.bucket", F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)).alias("block"))
    return _first(_meet(asked, index, splits, dim, k), k).select("query_id", "rank", "vec_id", "score")


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Vectors that take part, as integers.
WHOLE = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

ORACLE = f"""WITH {WHOLE}, s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::bigint AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
  r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
