"""Operator 6: near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vectors as V
from ._graph import components
from ._shared import read, table


class Tree:
    """Random directions and thresholds, node by node; a vector near a threshold goes to both sides."""

    def __init__(self, sample: np.ndarray, depth: int, spill: float, rng: np.random.Generator):
        self.depth, self.spill = depth, spill
        n = (1 << depth) - 1
        self.directions = self._directions(n, sample.shape[1], rng)
        self.thresholds = np.zeros(n)
        held = {0: np.arange(len(sample))}
        for node in range(n):
            rows = held.pop(node, np.zeros(0, np.int64))
            p = sample[rows] @ self.directions[node]
            self.thresholds[node] = np.median(p) if len(rows) else 0.0
            if 2 * node + 2 < n:
                held[2 * node + 1], held[2 * node + 2] = rows[p <= self.thresholds[node]], rows[p > self.thresholds[node]]

    @staticmethod
    def _directions(n: int, dim: int, rng: np.random.Generator) -> np.ndarray:
        """The first n directions of a generator: a shallower tree has the first ones of a deeper tree."""
        out = rng.normal(size=(n, dim))
        return out / np.linalg.norm(out, axis=1)[:, None]

    @classmethod
    def known(cls, thresholds: np.ndarray, dim: int, spill: float, rng: np.random.Generator) -> Tree:
        """The tree that had these thresholds under the same generator."""
        tree = cls.__new__(cls)
        tree.depth, tree.spill, tree.thresholds = int(np.log2(len(thresholds) + 1)), spill, thresholds
        tree.directions = cls._directions(len(thresholds), dim, rng)
        return tree

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of row and leaf."""
        row, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            gap = np.einsum("ij,ij->i", rows[row], self.directions[node]) - self.thresholds[node]
            left, right = gap <= self.spill, gap > -self.spill
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node


def _depth(sample: np.ndarray, n: int, leaf: int, spill: float, rng: np.random.Generator, least: int = 16) -> int:
    """The depth at which a leaf holds about `leaf` of n vectors, spilled ones included; a leaf keeps `least` sampled rows."""
    most = int(max(0, np.floor(np.log2(max(len(sample), 1) / least))))
    tree, held, depth = Tree(sample, most, spill, rng), float(n), 0
    while depth < most and held > leaf:
        depth += 1
        tree.depth = depth
        held = n * len(tree.leaves(sample)[0]) / len(sample) / (1 << depth)
    return depth


def _unit(dim: int):
    """Usable vectors scaled to length one, with a key that equal directions given by equal vectors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, good = V.matrix(batch.column(1), dim)
            norm = np.sqrt((values * values).sum(axis=1))
            good &= np.isfinite(norm) & (norm > 0) & ~np.asarray(batch.column(0).is_null())
            unit = values[good] / norm[good][:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([v.tobytes() for v in unit.astype("<f8")], pa.binary())], ["vec_id", "v"])

    return run


def _plant(forest: list[Tree], dim: int):
    """A row for each leaf of each tree that a vector falls in; `all` holds its leaves in all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = V.rows(batch.column(1).to_pylist(), dim)
            at = [t.leaves(rows) for t in forest]
            row = np.concatenate([r for r, _ in at])
            leaf = np.concatenate([(k << 40) + n for k, (_, n) in enumerate(at)])
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            ends = np.searchsorted(row, np.arange(len(rows) + 1))
            every = pa.array([leaf[a:b].astype("<i8").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), every.take(take), pa.array(leaf)], ["vec_id", "v", "copies", "all", "leaf"])

    return run


def _leaf_rng(seed: int, leaf: int) -> np.random.Generator:
    return np.random.default_rng([seed, leaf & (2**64 - 1)])


_MORE = 1.3  #: a level of a subtree that makes more than so many rows of each is no split, as most rows would go both ways


def _fit(dim: int, leaf: int, spill: float, seed: int, least: int = 16):
    """The thresholds of a tree under one full leaf, fitted on a bounded sample of its rows; none where its rows lie so close
    that they spill to both sides: such rows are nearly all linked, and are compared block by block."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        name, held, rows = int(frame["leaf"].iloc[0]), int(frame["held"].iloc[0]), V.rows(frame["v"].tolist(), dim)
        most = int(max(0, np.floor(np.log2(len(rows) / least))))
        tree, depth, now = Tree(rows, most, spill, _leaf_rng(seed, name)), 0, len(rows)
        while depth < most and held * now / len(rows) / (1 << depth) > leaf:
            tree.depth = depth + 1
            then = len(tree.leaves(rows)[0])
            if then > _MORE * now:
                break
            depth, now = depth + 1, then
        cuts = [tree.thresholds[: (1 << depth) - 1].astype("<f8").tobytes()] if depth else []
        return pd.DataFrame({"leaf": pd.Series([name] * len(cuts), dtype="int64"), "cuts": pd.Series(cuts, dtype=object)})

    return run


def _descend(dim: int, spill: float, seed: int):
    """A row for each leaf of the tree under its leaf that a vector falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, cuts = batch.column(3).to_numpy(), batch.column(4)
            rows = V.rows(batch.column(1).to_pylist(), dim)
            take, child = [], []
            for name, at in zip(*np.unique(leaf, return_index=True), strict=True):
                mine = np.flatnonzero(leaf == name)
                tree = Tree.known(np.frombuffer(cuts[int(at)].as_py(), "<f8"), dim, spill, _leaf_rng(seed, int(name)))
                row, node = tree.leaves(rows[mine])
                take.append(mine[row])
                child.append(node)
            take = pa.array(np.concatenate(take) if take else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(4)), pa.array(np.concatenate(child) if child else np.zeros(0, np.int64), pa.int64())], ["vec_id", "v", "copies", "leaf", "child"])

    return run


def _grown(planted: DataFrame, dim: int, leaf: int, spill: float, full: int, fit_rows: int, seed: int) -> DataFrame:
    """planted, with trees grown under all leaves of over `full` rows, round by round, until none is left that a split makes
    smaller. A round makes up to 32 leaves of one, so the rounds grow with the logarithm of the rows. Leaves are
    named by hashes; two that shared a name would only be compared together."""
    live, kept = planted, []
    while True:
        held = live.groupBy("leaf").agg(F.count("*").alias("held")).where(F.col("held") > full)
        picked = live.join(held, "leaf").where((F.xxhash64(F.lit(seed + len(kept) + 1), "vec_id") / 2.0**64 + 0.5) < F.lit(float(fit_rows)) / F.col("held"))
        trees = table(picked.select("leaf", "held", "vec_id", "v").groupBy("leaf").applyInPandas(_fit(dim, leaf, spill, seed), "leaf long, cuts binary"))
        if trees.isEmpty():
            break
        kept.append(live.join(trees, "leaf", "left_anti").select("vec_id", "v", "copies", "leaf"))
        below = live.join(trees, "leaf").select("vec_id", "v", "copies", "leaf", "cuts").mapInArrow(_descend(dim, spill, seed), "vec_id long, v binary, copies long, leaf long, child long")
        live = table(below.select("vec_id", "v", "copies", F.xxhash64("leaf", "child").alias("leaf")))
    if not kept:
        return planted
    for part in kept:
        live = live.unionByName(part)
    live = table(live)
    every = live.groupBy("vec_id").agg(F.collect_list("leaf").alias("all"))
    return table(live.join(every, "vec_id").select("vec_id", "v", "copies", "all", "leaf"))


def _earlier(every: pd.Series, leaf: int) -> np.ndarray:
    """Each row's leaves (longs, or their bytes) before `leaf`, as bits: two rows that share one have met before."""
    lists = [np.frombuffer(b, "<i8") for b in every]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate(lists)
    row, flat = row[flat < leaf], flat[flat < leaf]
    known, column = np.unique(flat, return_inverse=True)
    bits = np.zeros((len(lists), len(known) // 8 + 1), np.uint8)
    np.bitwise_or.at(bits, (row, column >> 3), (1 << (column & 7)).astype(np.uint8))
    return bits


def _joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of each row's group (kept flat) once the pairs a, b are joined."""
    while True:
        lo, hi = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        if (lo == hi).all():
            return up
        np.minimum.at(up, hi, lo)
        while (up[up] != up).any():
            up = up[up]


def _compare(dim: int, at_least: float):
    """Links between the rows of one leaf (or of two blocks of a large one): for each row the number of linked
    vectors, and a spanning set of edges. A pair that shares several leaves counts in the first of them."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = key
        frame = frame.sort_values("vec_id", kind="stable")
        ids, copies = frame["vec_id"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64)
        x, block = V.rows(frame["v"].tolist(), dim), frame["block"].to_numpy()
        earlier = _earlier(frame["all"], leaf)
        n = len(ids)
        links, up = np.zeros(n, np.int64), np.arange(n)
        for lo in range(0, n, 512):
            hi = min(lo + 512, n)
            near = x[lo:hi] @ x[lo:].T
            r, c = np.nonzero(near >= at_least - 1e-9)
            r, c = r + lo, c + lo
            keep = (r < c) & (ids[r] != ids[c])
            if i != j:
                keep &= block[r] != block[c]
            r, c = r[keep], c[keep]
            for at in range(0, len(r), 65536):
                a, b = r[at : at + 65536], c[at : at + 65536]
                linked = np.einsum("ij,ij->i", x[a], x[b]) >= at_least
                a, b = a[linked], b[linked]
                first = ~(earlier[a] & earlier[b]).any(axis=1)
                np.add.at(links, a[first], copies[b[first]])
                np.add.at(links, b[first], copies[a[first]])
                up = _joined(up, a, b)
        keep = (links > 0) | (up != np.arange(n))
        return pd.DataFrame({"vec_id": ids[keep], "links": links[keep], "root": ids[up[keep]] if n else ids})

    return run


def rp_forest_duplicates(vectors: DataFrame, cosine: float = 0.95, dim: int | None = None, trees: int = 12, leaf: int = 400, spill: float = 0.02, sample: int = 20_000, block_rows: int = 1500, fit_rows: int = 512, seed: int = 11) -> DataFrame:
    """Links between vectors of cosine >= `cosine` (double precision), and the groups that they form.

    vectors: vec_id long, embedding array of numbers. Equal vectors are one row with a count throughout,
    so copies are never paired with each other. The forest is fitted on about `sample` rows (those of least hash);
    its trees deepen until a leaf holds about `leaf` vectors, spilled ones included, and no less than 16 sampled rows. Under a leaf
    that still has over `block_rows` rows, as all have once the table is large, a tree of its own grows, fitted on about `fit_rows` of
    them, and so on. Only leaves whose rows lie too close for a split stay larger: they are compared in pairs of blocks, each a
    task of its own. Returns vec_id, n_links (other vectors linked), component_id (smallest
    vec_id reachable), kept. Vectors that are null, zero, of another length, or with null or non-finite
    components link with nothing. Rows without vec_id are left out. Repeated rows are one. An empty table
    gives an empty result.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    if dim is None:
        dim = V.usual_length(vectors)
    unit = table(vectors.mapInArrow(_unit(dim), "vec_id long, v binary").distinct())
    classes = table(unit.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    n = classes.count()
    picked = classes.where((F.xxhash64(F.lit(seed), "first") / 2.0**64 + 0.5) < sample / max(n, 1)).orderBy("first")
    rows = V.rows(picked.select("v").toPandas()["v"].tolist(), dim)
    rng = np.random.default_rng(seed)
    depth = _depth(rows, n, leaf, spill, rng)
    forest = [Tree(rows, depth, spill, rng) for _ in range(trees)]
    planted = table(classes.select(F.col("first").alias("vec_id"), "v", "copies").mapInArrow(_plant(forest, dim), "vec_id long, v binary, copies long, all binary, leaf long"))
    planted = _grown(planted, dim, leaf, spill, block_rows, fit_rows, seed)
    held = planted.groupBy("leaf").agg(F.count("*").alias("held")).where("held > 1")
    blocks = F.ceil(F.col("held") / block_rows).cast("int")
    planted = planted.join(held, "leaf").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = planted.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = table(paired.select("leaf", "i", "j", "vec_id", "v", "copies", "all", "block").groupBy("leaf", "i", "j").applyInPandas(_compare(dim, cosine), "vec_id long, links long, root long"))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    groups = components(found.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    members = unit.join(classes, "v").select("vec_id", "first", "copies")
    members = members.join(links.withColumnRenamed("vec_id", "first"), "first", "left").join(groups.withColumnRenamed("node", "first"), "first", "left")
    members = members.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    out = vectors.select("vec_id").distinct().join(members, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op6_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest_duplicates(read(spark, sf_dir, "embeddings"))
