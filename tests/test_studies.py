"""Exact selection, orders of reads, donors, fits and the disagreement study against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.operators import contamination, fits, orders, rank_tests, selection, studies


@pytest.mark.parametrize("n", [1, 2, 9, 500])
def test_cut_and_quantiles_are_exact(spark, n):
    r = random.Random(n)
    rows = [(g, round(r.random() * 20, r.choice([0, 1, 6])), i) for g in ("a", "b") for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    for row in selection.quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, 0.7).collect():
        want = np.percentile([v for g, v, _ in rows if g == row.g], [25, 50, 75])
        assert row.n == n and np.allclose([row.q1, row.q2, row.q3], want, rtol=0, atol=1e-12)
    ids = df.where("g = 'a'").select(F.md5(F.col("i").cast("string")).alias("h"), F.col("i").alias("n"))
    parts = selection.cut(ids, "h", F.substring("h", 1, 2), {"train": F.floor(F.col("n") * 0.8), "val": F.floor(F.col("n") * 0.9)}, "test", "part").orderBy("h").collect()
    k, m = math.floor(n * 0.8), math.floor(n * 0.9)
    assert [p.part for p in parts] == ["train"] * k + ["val"] * (m - k) + ["test"] * (n - m)
    assert selection.cut(ids.where("false"), "h", F.substring("h", 1, 2), {"train": F.col("n")}, "test", "part").count() == 0
    s = selection.starts(df.where("g = 'a'").withColumn("w", F.col("i") % 3), "i", "w", width=7).orderBy("i").collect()
    assert [x.start for x in s] == [sum(j % 3 for j in range(i)) for i in range(n)]


def test_read_orders_are_all_or_different(spark):
    clusters = [(n, list(range(1, n + 1))) for n in (0, 1, 2, 3, 4, 7, 20, 21, 30)]
    got = orders.read_orders(spark.createDataFrame(clusters, "cluster_id long, nos array<int>"), "p", 6).collect()
    for n, nos in clusters:
        mine = [tuple(x.order) for x in got if x.cluster_id == n]
        assert len(mine) == len(set(mine)) == min(6, math.factorial(n)) and all(sorted(o) == nos for o in mine)
        assert n not in (1, 2, 3) or set(mine) == set(itertools.permutations(nos))
    some = orders.read_orders(spark.createDataFrame([(c, [1, 2, 3, 4]) for c in range(200)], "cluster_id long, nos array<int>"), "p", 4)
    assert some.select("order").distinct().count() == 24


def test_every_place_is_one_order(spark):
    df = spark.range(24).select(F.col("id"), orders.unranked(F.array(*map(F.lit, "abcd")), F.col("id")).alias("o"))
    assert [tuple(x.o) for x in df.orderBy("id").collect()] == list(itertools.permutations("abcd"))


def test_donors_are_foreign_and_never_lack(spark):
    rows = [(c, k, f"{c}:{k}") for c, n in ((1, 40), (5, 1), (9000, 3), (9001, 60)) for k in range(1, n + 1)]
    df = spark.createDataFrame(rows, "cluster_id long, read_no int, read string")
    got = contamination.substitute(df, "s", "g").collect()  # every hash is below
    assert sorted((x.cluster_id, x.read_no, x.read) for x in got) == rows
    assert all(x.donor is not None and int(x.donor.split(":")[0]) != x.cluster_id for x in got)
    assert len({x.donor for x in got}) > 50
    assert all(x.donor is None for x in contamination.substitute(df, "s", "0").collect())
    assert all(x.donor is None for x in contamination.substitute(df.where("cluster_id = 1"), "s", "g").collect())


def test_tail_and_parabola(spark):
    zs = [0.0, 0.3, 1.0, 2.5, -4.0, 4.2, 4.3, 6.0, 12.0]
    for z, p in spark.createDataFrame([(z,) for z in zs], "z double").select("z", rank_tests.two_sided_p(F.col("z"))).collect():
        assert math.isclose(p, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-10)
    r = np.random.default_rng(1)
    rows = [(g, float(x), float(0.3 * x * x - g * x + 2 + 0.01 * r.normal())) for g in (1, 2) for x in r.uniform(6, 8, 200)] + [(3, 7.0, 1.0), (3, 7.5, 2.0), (4, None, 1.0)]
    for row in fits.quadratic(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], F.col("x"), F.col("y"), 7.0).collect():
        x, y = np.array([(x, y) for g, x, y in rows if g == row.g]).T
        if row.g == 3:
            assert row.c2 is None and row.n == 2
        else:
            assert np.allclose([row.c2, row.c1, row.c0], np.polyfit(x, y, 2), rtol=1e-7)


def test_disagreement_impact_is_the_plain_study(spark):
    r = random.Random(7)
    rows = [(n, (d := r.uniform(0, 14)), d * r.uniform(0.5, 2.5), int(d * r.uniform(0, 1.2))) for n in (2, 3) for _ in range(150)]
    rows += [(4, 1.0, 2.0, 0)] * 20 + [(5, 1.0, float(k), k) for k in range(9)] + [(6, 1.0, float(k), k) for k in range(12)]
    got = {(x.n, x.bin): x for x in studies.disagreement_impact(spark.createDataFrame(rows, "n int, d double, far double, err int")).collect()}
    want = {}
    for key in {(n, int(d // 5) * 5) for n, d, *_ in rows}:
        mine = [(far, err) for n, d, far, err in rows if (n, int(d // 5) * 5) == key]
        far = np.array([f for f, _ in mine])
        if len(mine) < 10 or far.std() / far.mean() < 0.2:
            continue
        q25, q75 = np.percentile(far, [25, 75])
        low, high = [e for f, e in mine if f <= q25], [e for f, e in mine if f >= q75]
        if len(low) < 5 or len(high) < 5:
            continue
        both = sorted(low + high)
        rank = {v: (both.index(v) + 1 + both.index(v) + both.count(v)) / 2 for v in both}
        n1, n2, n = len(low), len(high), len(both)
        u = sum(rank[v] for v in low) - n1 * (n1 + 1) / 2
        sd = math.sqrt(n1 * n2 / 12 * (n + 1 - sum(both.count(v) ** 3 - both.count(v) for v in set(both)) / (n * (n - 1))))
        z = max(abs(u - n1 * n2 / 2) - 0.5, 0) / sd
        pooled = math.sqrt((np.std(low) ** 2 + np.std(high) ** 2) / 2)
        want[key] = (len(mine), n1, n2, far.std() / far.mean(), (np.mean(high) - np.mean(low)) / pooled, np.mean([e == 0 for e in low]), math.erfc(z / math.sqrt(2)))
    assert set(got) == set(want) and len(want) >= 5 and (6, 0) not in got
    for k, w in want.items():
        g = got[k]
        assert np.allclose((g.total, g.low_n, g.high_n, g.cv, g.effect, g.low_perfect, g.p), w, rtol=1e-9)
