"""Operators 11 to 13 against brute force, with nulls, ties, repeats, several blocks and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import hard_negatives as H
from traceloom.llm import norm_buckets as N
from traceloom.llm.merkle_manifest import merkle_manifest

VECTORS = "vec_id long, embedding array<double>, label int, score double, rank int, v int"


def vectors(n=400, dim=8, seed=3):
    """Lengths from short to long, clusters, copies, zero vectors, and rows that take no part."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dim))
    rows = []
    for i in range(n):
        x = centres[i % 4] + 0.15 * r.normal(size=dim)
        x *= float(np.exp(r.normal())) / np.linalg.norm(x)
        rows.append((i, x.tolist(), int(r.integers(0, 3)), 1.0, 2, 3))
    for i in range(n, n + 40):
        rows.append((i, rows[20][1], i % 3, 1.0, 2, 3))
    at = n + 40
    rows += [(at, [0.0] * dim, 1, 1.0, 2, 3), (at + 10, None, 1, 1.0, 2, 3), (at + 20, [1.0] * (dim - 1) + [None], 1, 1.0, 2, 3), (at + 30, [float("nan")] * dim, 1, 1.0, 2, 3)]
    rows += [(at + 40, [float("inf")] + [0.0] * (dim - 1), 0, 1.0, 2, 3), (at + 50, [], 0, 1.0, 2, 3), (at + 60, [1.0], 0, 1.0, 2, 3), (None, [1.0] * dim, 0, 1.0, 2, 3), (at + 70, [1.0] * dim, None, 1.0, 2, 3)]
    return [*rows, rows[40], rows[40]]


def whole(rows, dim=8):
    out = {}
    for i, x, label, *_ in rows:
        if i is not None and x is not None and len(x) == dim and all(c is not None and np.isfinite(c) for c in x):
            out[i] = (label, [int(np.floor(256 * c)) for c in x])
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 37, "query_rows": 11, "sample": 100}])
def test_op11_equals_all_products(spark, sizes):
    rows = vectors()
    have = whole(rows)
    want = set()
    for q in have:
        if q % 10 == 0:
            ranked = sorted((-dot(have[q][1], v), i) for i, (_, v) in have.items() if i != q)[:5]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(ranked, 1)}
    got = N.largest_products(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, **sizes).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_op11_both_prunings_find_the_same():
    r = np.random.default_rng(5)
    x = r.integers(-300, 300, (3000, 12))
    x[:50] = x[50] + r.integers(-3, 3, (50, 12))
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    held = N.Bucket(np.arange(3000), x, norm)
    q, q_ids = x[40:60], np.arange(40, 60)
    every = q @ x.T
    every[np.arange(20), q_ids] = -(1 << 60)
    least = np.sort(every, axis=1)[:, -5]
    found = {}
    for share in (0.0, 1.0):  # length alone, and coordinates wherever they can
        place, row, score = held.search(q_ids, q, least, 5, share=share)
        found[share] = sorted(zip(place.tolist(), held.ids[row].tolist(), score.tolist(), strict=True))
    assert found[0.0] == found[1.0] and len(found[0.0]) == 100
    assert all(every[p, i] == s for p, i, s in found[0.0])
    low, high = N.near_range(np.full(1, 0.8), np.full(1, 0.95))
    assert 0.5 < low[0] < 0.8 < high[0] < 0.99


def test_op11_few_candidates_and_nothing(spark):
    some = spark.createDataFrame([(0, [1.0, -1.0], 0, 0.0, 0, 0), (1, [0.5, 0.5], 0, 0.0, 0, 0)], VECTORS)
    assert [tuple(x) for x in N.largest_products(some, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0)]
    assert N.largest_products(some.where("false"), F.col("vec_id") == 0).count() == 0
    assert N.largest_products(some.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    large = spark.createDataFrame([(0, [3e5, 1.0], 0, 0.0, 0, 0), (1, [3e5, 2.0], 0, 0.0, 0, 0), (2, [-3e5, 2.0], 0, 0.0, 0, 0)], VECTORS)
    assert [tuple(x) for x in N.largest_products(large, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 76_800_000**2 + 256 * 512), (0, 2, 2, -(76_800_000**2) + 256 * 512)]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 37, "anchor_rows": 7}])
def test_op12_equals_brute_force(spark, sizes):
    rows = vectors()
    have = {i: (label, v) for i, (label, v) in whole(rows).items() if label is not None}
    want = set()
    for a in have:
        if a % 10 == 0:
            ranked = sorted((-dot(have[a][1], v), i) for i, (_, v) in have.items() if i != a)
            for s, p in [(-s, i) for s, i in ranked if have[i][0] == have[a][0]][:5]:
                inside = [(-n, i) for n, i in ranked if have[i][0] != have[a][0] and 80 * s <= -100 * n <= 100 * s][:5]
                want |= {(a, p, k, i, s, n) for k, (n, i) in enumerate(inside, 1)}
    got = H.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, **sizes).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300


def test_op12_over_partitions_that_stay_apart(spark):
    rows = vectors()
    want = sorted(map(tuple, H.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        for sizes in ({}, {"block_rows": 37, "anchor_rows": 11}):
            got = H.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, **sizes).collect()
            assert sorted(map(tuple, got)) == want and len(want) > 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_op12_keys_and_nothing(spark):
    values = [(-5, 7, 0, 3), (-5, 7, 1, 2), (-5, -1, 0, -9), (4, 0, 1, 0), (4, -(1 << 62), 0, 1)]
    keys = [H.pack_keys(np.array([a]), np.array([s]), kind, np.array([o]))[0] for a, s, kind, o in values]
    assert [H.unpack_key(k) for k in sorted(keys[::-1])] == values
    assert H.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 0, 0.0, 0, 0), (1, [1.0], 0, 0.0, 0, 0), (2, [1.0], 1, 0.0, 0, 0), (3, [0.81], 2, 0.0, 0, 0), (4, [0.5], 2, 0.0, 0, 0)], VECTORS)
    assert sorted(map(tuple, H.hard_negatives(one, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 2, 65536, 65536), (0, 1, 2, 3, 65536, 207 * 256)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root of each row, built one node at a time."""

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, at):
        for level in levels[:-1]:
            run = at // 16 * 16
            yield level[run:at], level[at + 1 : run + 16]
            at //= 16

    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    top = up([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for at, (_, _, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            low = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                low = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node, proof = leaf(low), []
            for before, after in [*way(trees[s], at), *way(top, k)]:
                node = sha("".join([*before, node, *after]))
                proof += before + after
            yield r[0], own, trees[s][-1][0], top[-1][0], sha("".join(proof)), node, node == top[-1][0]


DOCS = "doc_id long, source string, lang string, n_chars long, text string, pos int, g string, block int"


@pytest.mark.parametrize("case", ["large", "sources", "odd", "one"])
def test_op13_equals_single_nodes(spark, case):
    r = random.Random(case)
    text = lambda: "".join(r.choices("aBcÄß\n é", k=r.randrange(12)))
    rows = {
        "large": [(i, r.choice(["s", "s", "s", "t", None, "Ä"]), "en", i, text()) for i in r.sample(range(5000), 1500)],
        "sources": [(i, f"s{r.randrange(400)}", None, None, text()) for i in range(900)],
        "odd": [(None, None, None, None, None), (None, "", "", 0, ""), (7, "a", "b", 1, "X" * 300_000), (5, "a", None, 2, "A"), (5, "a", None, 2, "A"), (5, "a", None, 2, "B"), (10, "-", "1:a", -3, None)] * 3,
        "one": [(3, "s", "en", 1, "Text")],
    }[case]
    frame = spark.createDataFrame([(*x, 1, "g", 2) for x in rows], DOCS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle_manifest(frame, hit).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = list(manifest(rows))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert case in ("odd", "one") or not all(x[-1] for x in want)


def test_op13_empty(spark):
    assert merkle_manifest(spark.createDataFrame([], DOCS), F.lit(True)).count() == 0
