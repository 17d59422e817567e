"""Registered queries against their SQL twins, and golden rows of the sequence functions."""

import glob
import hashlib
from numbers import Number
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from traceloom.functions import sequence as S
from traceloom.operators import consensus as C
from traceloom.operators import errors as E
from traceloom.operators import joins as J
from traceloom.plans import registry
from traceloom.sources import fixture

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "null" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {Path(f).stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLES[name]).df())


def one(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column).first()[0]


def test_golden(spark):
    assert one(spark, S.strip_other(F.col("s")), s="ACTGNTACgTACG") == "ACTGTACTACG"
    assert one(spark, S.permute_packed(F.col("s"), [2, 0, 1]), s="ACGT|TGCA|GGCC:ACGTACGT") == "GGCC|ACGT|TGCA:ACGTACGT"
    assert one(spark, S.nest(F.split("s", "\\|")), s="ABC|DEF|GHI") == "ADGBEHCFI"
    assert one(spark, S.encode(F.col("s")), s="ACGT-|:#") == list(range(8))
    assert one(spark, S.hamming(F.col("a"), F.col("b")), a="ACGT", b="TCG") == 2


def test_gap_weighted_vote(spark):
    reads = spark.createDataFrame([(1, i, s) for i, s in enumerate(["ACGT-", "A-GT-", "T-G-G", "T-G-G"], 1)], "cluster_id int, read_no int, read string")
    assert C.gap_weighted_vote(reads).first()["consensus"] == "AGTG"
    assert E.homopolymers(spark.createDataFrame([(1, "CGAAAT")], "k int, s string"), "k", "s").collect() == [(1, 2, 5, "A")]


def test_edit_operations_are_as_many_as_the_distance(spark):
    r = fixture.reads(spark, SF).limit(300)
    wrong = E.edit_operations(r.select("cluster_id", "read_no", "gt", "read")).where(F.size("ops") != F.levenshtein("gt", "read"))
    assert wrong.count() == 0


def best_operations(gt, pred):
    """All least ways to turn gt into pred are tried from the ends; the one whose last step comes first among keep,
    replace, delete, insert wins."""
    from functools import cache

    @cache
    def cost(i, j):
        if not i or not j:
            return i + j
        return min(cost(i - 1, j - 1) + (gt[i - 1] != pred[j - 1]), cost(i - 1, j) + 1, cost(i, j - 1) + 1)

    out, i, j = [], len(gt), len(pred)
    while i + j:
        ways = []
        if i and j:
            ways.append((cost(i - 1, j - 1) + (gt[i - 1] != pred[j - 1]), 0, i - 1, j - 1))
        if i:
            ways.append((cost(i - 1, j) + 1, 1, i - 1, j))
        if j:
            ways.append((cost(i, j - 1) + 1, 2, i, j - 1))
        _, way, x, y = min(ways)
        if way == 0 and gt[x] != pred[y]:
            out.append(("sub", x, gt[x], pred[y]))
        elif way == 1:
            out.append(("del", x, gt[x], None))
        elif way == 2:
            out.append(("ins", x, None, pred[y]))
        i, j = x, y
    return out[::-1]


def test_edit_operations_against_brute_force(spark):
    import random

    rng = random.Random(8)
    pairs = [("", ""), ("", "AC"), ("ACG", ""), ("ACGT", "ACGT"), (None, "A"), ("A", None), ("AÄC", "AC")]
    for _ in range(300):
        gt = "".join(rng.choice("ACGT") for _ in range(rng.randrange(14)))
        pred = "".join(c for c in gt if rng.random() < 0.8) if rng.random() < 0.7 else "".join(rng.choice("ACG") for _ in range(rng.randrange(12)))
        pairs.append((gt, pred))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, gt string, read string").repartition(3)
    for r in E.edit_operations(df).collect():
        want = None if r.gt is None or r.read is None else best_operations(r.gt, r.read)
        assert want == (None if r.ops is None else [tuple(o) for o in r.ops]), (r.gt, r.read)
    lcs = lambda a, b: 0 if not a or not b else max(lcs(a[1:], b), lcs(a, b[1:])) if a[0] != b[0] else 1 + lcs(a[1:], b[1:])
    for r in E.common_subsequence(df.where("length(gt) < 8 or gt is null")).collect():
        assert r.lcs == (None if r.gt is None or r.read is None else lcs(r.gt, r.read))


def test_binomial_test_is_exact_at_every_size():
    from math import comb

    for n, p in ((1, 0.3), (20, 0.05), (57, 0.5), (200, 0.013), (300, 0.9)):
        mass = [comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(n + 1)]
        for k in range(0, n + 1, max(1, n // 25)):
            assert abs(E.binomial_p(k, n, p) - min(1, sum(m for m in mass if m <= mass[k] * (1 + 1e-7)))) < 1e-9
            assert abs(E.binomial_p(k, n, p, "greater") - sum(mass[k:])) < 1e-9
    from math import erfc, sqrt

    for n in (10**6, 10**9):
        k, spread = int(n * 0.01 + 3 * sqrt(n * 0.0099)), sqrt(2 * n * 0.0099)
        assert abs(E.binomial_p(k, n, 0.01) / erfc((k - 0.5 - n * 0.01) / spread) - 1) < 0.02
    assert E.binomial_p(0, 0, 0.5) == 1.0


def test_error_analytics(spark):
    rates = {r.op: r for r in registry.QUERIES["a29_operation_rates"](spark, SF).collect()}
    total = registry.QUERIES["a29_operation_counts"](spark, SF).first().operations
    assert sum(rates[o].n for o in ("sub", "del", "ins")) == total and abs(rates["match"].rate + rates["sub"].rate + rates["del"].rate - 1) < 1e-5
    places = registry.QUERIES["a24_position_profile"](spark, SF).toPandas()
    for _, f in places[places["op"] == "all"].groupby("scale"):
        assert f["n"].sum() == total
    kmers = registry.QUERIES["a25_kmer_enrichment"](spark, SF).toPandas()
    assert set(kmers["k"]) == {3, 5, 7} and set(kmers["op"]) == {"all", "sub", "del", "ins"} and kmers["p"].between(0, 1).all() and (kmers["p_adjusted"] >= kmers["p"] - 1e-9).all()
    three = kmers[(kmers["k"] == 3) & (kmers["op"] != "all")].groupby("kmer")["errors"].sum()
    assert three.to_dict() == kmers[(kmers["k"] == 3) & (kmers["op"] == "all")].set_index("kmer")["errors"].to_dict()
    hp = {r.op: r for r in registry.QUERIES["a26_homopolymer_errors"](spark, SF).collect()}
    assert sum(r.operations for r in hp.values()) == total and all(0 < r.share < 1 and r.touching <= r.operations for r in hp.values())
    lengths = registry.QUERIES["a26_homopolymer_lengths"](spark, SF).toPandas()
    assert lengths["n"].sum() == sum(r.touching for r in hp.values()) and lengths["length"].min() >= 3


def test_homopolymer_class(spark):
    runs = spark.createDataFrame([(1, 3, 6, "A")], "cluster_id int, start int, end int, base string")
    ops = [("ins", 6, None, "A", "hp_expansion"), ("ins", 4, None, "C", "hp_interruption"), ("ins", 2, None, "G", "hp_boundary"), ("del", 4, "A", None, "hp_contraction"), ("del", 2, "C", None, "non_hp"), ("sub", 5, "A", "T", "hp_interruption"), ("sub", 6, "C", "A", "hp_boundary"), ("sub", 9, "C", "A", "non_hp")]
    df = spark.createDataFrame([(1, 1, i, *o) for i, o in enumerate(ops)], "cluster_id int, read_no int, no int, op string, pos int, old string, new string, want string")
    got = {r["no"]: r["hp_class"] for r in E.homopolymer_class(df.drop("want"), runs).collect()}
    assert [got[i] for i in range(len(ops))] == [o[-1] for o in ops]


def test_common_subsequence(spark):
    r = fixture.reads(spark, SF).limit(300)
    wrong = E.common_subsequence(r.select("gt", "read")).where((F.length("gt") + F.length("read") - 2 * F.col("lcs") < F.levenshtein("gt", "read")) | (F.col("lcs") < F.length("gt") - F.levenshtein("gt", "read")))
    assert wrong.count() == 0
    assert E.common_lengths(["ACGT", "", "AGGTAB", "A"], ["AGT", "A", "GXTXAYB", ""]).tolist() == [3, 0, 4, 0]


def test_prefixes_are_found_anywhere_in_the_read(spark):
    truths = [(i, random_bases(i)) for i in range(30)]
    reads = []
    for i, g in truths:
        k = g[:20]
        off = {0: k, 1: k[:7] + ("A" if k[7] != "A" else "C") + k[8:], 2: k[:12] + k[13:] + "A", 3: k[:5] + "G" + k[5:]}[i % 4]
        reads.append((1, i, random_bases(100 + i)[: 3 * i] + off + random_bases(200 + i)[: 90 - 3 * i]))
    reads.append((1, 99, "ACGT"))
    r, t = spark.createDataFrame(reads, "cluster_id int, read_no int, s string"), spark.createDataFrame(truths, "gt_id int, gt string")
    exact = {(n, g): s.find(gt[:20]) for _, n, s in reads for g, gt in truths if gt[:20] in s}
    assert {(x.read_no, x.gt_id): x.pos for x in J.prefix_hits(r, t, 20).collect()} == exact and max(exact.values()) > 80
    near = {}
    for _, n, s in reads:
        for g, gt in truths:
            at = [p for p in range(len(s) - 19) if len(s) >= 20 and distance(s[p : p + 20], gt[:20]) <= 1]
            if at:
                near[n, g] = at[0]
    assert {(x.read_no, x.gt_id): x.pos for x in J.approximate_hits(r, t, 20, 1).collect()} == near and len(near) > len(exact) and max(near.values()) > 80


@pytest.mark.parametrize(("k", "most"), [(20, 0), (20, 1), (20, 2), (20, 3), (30, 2), (12, 3), (6, 5)])
def test_approximate_hits_at_any_distance(spark, k, most):
    """First window and its distance, against all windows of all prefixes; pieces in pairs where single ones are short."""
    import random

    rng = random.Random(k * 10 + most)
    truths = [(i, random_bases(i)[:40]) for i in range(12)] + [(98, "ACG")]
    reads = [(1, 990, "ACGT"), (1, 991, ""), (1, 992, truths[0][1][:k])]
    for i, g in truths[:12]:
        for edits in range(most + 2):
            r = list(g[:k])
            for _ in range(edits):
                at = rng.randrange(len(r))
                r[at : at + 1] = rng.choice([[], [r[at], rng.choice("ACGT")], [rng.choice("ACGT")]])
            reads.append((1, 10 * i + edits, random_bases(100 + i)[: 3 * i] + "".join(r) + random_bases(200 + i)[:25]))
    want = {}
    for _, n, s in reads:
        for g, gt in truths:
            for p in range(len(s) - k + 1) if len(gt) >= k else ():
                if (d := distance(s[p : p + k], gt[:k])) <= most:
                    want[n, g] = (p, d)
                    break
    r, t = spark.createDataFrame(reads, "cluster_id int, read_no int, s string"), spark.createDataFrame(truths, "gt_id int, gt string")
    got = {(x.read_no, x.gt_id): (x.pos, x.edit_dist) for x in J.approximate_hits(r, t, k, most).collect()}
    assert got == want and len(want) >= 12 and len({d for _, d in want.values()}) > min(most, 1)
    best = {x.read_no: (x.gt_id, x.pos, x.edit_dist, x.hits, x.status) for x in J.best_match(r, J.approximate_hits(r, t, k, most)).collect()}
    for _, n, _ in reads:
        hits = sorted((d, p, g) for (m, g), (p, d) in want.items() if m == n)
        assert best[n] == ((hits[0][2], hits[0][1], hits[0][0], len(hits), "mapped" if len(hits) == 1 else "mapped_ambiguous") if hits else (None, None, None, 0, "unmapped"))


def test_sets_of_pieces_stay_in_every_window_within_the_edits():
    """All prefixes and windows of six bases of two symbols, and random ones of real lengths: a window within the edits has a set of pieces at its distances."""
    import random
    from itertools import product

    def met(prefix, window, k, most):
        size, sets = J.seeds(k, most)
        for own in sets:
            for off, least, late in J._layouts(size, own, most, most + len(own)):
                for p in range(own[0] * size + least, own[0] * size + late + 1):
                    if all(0 <= p + o and p + o + size <= k and window[p + o : p + o + size] == prefix[i * size : (i + 1) * size] for i, o in zip(own, off, strict=True)):
                        return True
        return False

    texts = ["".join(x) for x in product("AC", repeat=6)]
    assert all(met(a, b, 6, most) for most in (1, 2) for a in texts for b in texts if distance(a, b) <= most)
    rng, met_ones = random.Random(5), 0
    for k, most in ((30, 2), (20, 1), (20, 2), (20, 3)):
        for _ in range(1500):
            prefix = "".join(rng.choice("ACGT") for _ in range(k))
            w = list("TT" + prefix + "GG")
            for _ in range(rng.randrange(most + 1)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [w[at], rng.choice("ACGT")], [rng.choice("ACGT")]])
            at = rng.randrange(5)
            window = "".join(w)[at : at + k]
            if len(window) == k and distance(window, prefix) <= most:
                met_ones += 1
                assert met(prefix, window, k, most)
    assert met_ones > 1000


@pytest.mark.parametrize("bits", [1 << 31, 1 << 10])
@pytest.mark.parametrize(("k", "most"), [(30, 2), (20, 1)])
def test_reads_and_truths_seldom_meet_by_chance(spark, monkeypatch, k, most, bits):
    """Candidates don't grow with reads times ground truths, and a full filter lets no hit go."""
    monkeypatch.setattr(J, "SEED_BITS", bits)
    truths = spark.createDataFrame([(i, random_bases(i)[:60]) for i in range(1500)] + [(9000, "N" * 60), (9001, None)], "gt_id long, gt string")
    reads = spark.createDataFrame([(1, i, random_bases(5000 + i)[:50] + (random_bases(i)[:60] if i % 10 == 0 else "")) for i in range(300)] + [(2, 1, "AC" + "N" * 40), (2, 2, None)], "cluster_id long, read_no int, s string")
    pairs = J._candidates(reads, truths, k, most).select("cluster_id", "read_no", "gt_id").distinct().count()
    assert pairs == 31  # some 450,000 pairs; pieces of ten bases would meet in over a hundred
    got = {(x.cluster_id, x.read_no, x.gt_id): (x.pos, x.edit_dist) for x in J.approximate_hits(reads, truths, k, most).collect()}
    assert len(got) == 31 and got[2, 1, 9000] == (2 - most, most) and all(n == g for c, n, g in got if c == 1)


def test_within_distance_misses_no_pair(spark):
    import random

    rng = random.Random(11)
    truths = [random_bases(i)[:60] for i in range(12)] + [random_bases(77)[:16], random_bases(78)[:28], "ACGTAC", ""]
    reads = ["", "ACG", "ACGTTC", "NNNNNNN", random_bases(3)[:60].replace("A", "N", 9), None]
    for g in [*truths[:12], random_bases(77)[:16], random_bases(78)[:28]]:
        for edits in range(0, 20, 2):
            r = list(g)
            for _ in range(edits):
                at = rng.randrange(len(r))
                r[at : at + 1] = rng.choice([[], [r[at], rng.choice("ACGT")], [rng.choice("ACGT")]])
            reads.append("".join(r))
    r, t = spark.createDataFrame([(x,) for x in reads], "s string"), spark.createDataFrame([(x,) for x in truths], "g string")
    want = {s for s in reads if s is not None and any(5 <= distance(s, g) <= 13 for g in truths)}
    assert {x.s for x in J.within_distance(r, t, 5, 13).collect()} == want and 20 < len(want) < len(set(reads))


def random_bases(i):
    return hashlib.sha256(str(i).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")) * 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pointers(rs, length, window=2):
    out, p = "", [0] * len(rs)
    show = lambda r, i: r[i : i + 1]

    def majority(shown):
        n = [(sum(c == b for c in shown), -k, b) for k, b in enumerate("ACGT")]
        return max(n)[2] if max(n)[0] else ""

    while len(out) < length and (won := majority([show(r, i) for r, i in zip(rs, p, strict=True)])):
        ahead = [majority([show(r, i + j) for r, i in zip(rs, p, strict=True) if show(r, i) == won]) for j in range(1, window + 1)]
        for k, r in enumerate(rs):
            if show(r, p[k]) == won:
                p[k] += 1
            elif show(r, p[k]):
                agree = lambda shift, n: sum(ahead[j] != "" and show(r, p[k] + j + shift) == ahead[j] for j in range(n))  # noqa: B023, E731
                scores = [(agree(1, window), 1), (agree(0, window), 0), ((show(r, p[k] + 1) == won) + agree(2, window - 1), 2)]
                p[k] += max(scores, key=lambda s: s[0])[1]
        out += won
    return out


def test_lookahead_vote_is_the_plain_loop(spark):
    import random

    rng = random.Random(3)
    clusters = {}
    for i in range(60):
        gt = "".join(rng.choice("ACGT") for _ in range(40))
        noisy = lambda g: "".join(x if (u := rng.random()) > 0.15 else rng.choice("ACGT") if u < 0.05 else "" if u < 0.1 else x + rng.choice("ACGT") for x in g)
        clusters[i] = [noisy(gt) for _ in range(rng.randrange(1, 8))]
    df = spark.createDataFrame([(i, k, r) for i, rs in clusters.items() for k, r in enumerate(rs, 1)], "cluster_id long, read_no int, read string")
    got = {r.cluster_id: r.consensus for r in C.lookahead_vote(df, 40).collect()}
    assert got == {i: pointers(rs, 40) for i, rs in clusters.items()}


def test_clusters_of_any_size_reach_the_kernels_whole(spark):
    """A cluster of 20,000 reads spans batches; odd symbols, null keys and empty reads."""
    import random

    rng = random.Random(4)
    gt = random_bases(5)[:40]
    rows_ = [(7, k, gt[: rng.randrange(35, 41)] if k % 3 else gt[:9] + "N" + gt[10:]) for k in range(20_000)] + [(None, 1, "ACG"), (None, 2, "ACGT"), (8, 1, ""), (9, 1, "né"), (9, 2, "nA"), (10, 1, "Aé"), (10, 2, "AéG")]
    df = spark.createDataFrame(rows_, "cluster_id long, read_no int, read string")
    got = {r.cluster_id: r.consensus for r in C.lookahead_vote(df, 40).collect()}
    want = {c: pointers([r for d, _, r in rows_ if c == d and r], 40) for c in (None, 9, 10)}
    assert got == want | {7: gt}
    said = {r.cluster_id: (r.consensus, r.error) for r in C.plug_in(lambda rs, n: f"{len(rs)}{rs[-1]}" if len(rs) > 1 else [][n])(df, 40).collect()}
    assert said[7] == (f"20000{rows_[19_999][2]}", None) and said[None] == ("2ACGT", None) and said[8] == (None, "IndexError: list index out of range")


def test_plain_vote_of_hot_clusters(spark, monkeypatch):
    """Clusters over the bound are counted another way, with the same winners."""
    r = fixture.reads(spark, SF).select("cluster_id", "read_no", "read")
    r = r.unionByName(spark.createDataFrame([(-1, 1, ""), (-1, 2, "AC"), (-2, 1, "ACG"), (-2, 2, "AT")], r.schema))
    want = rows(C.plain_vote(r).toPandas())
    monkeypatch.setattr(C, "HOT", 3)
    assert rows(C.plain_vote(r).toPandas()) == want and rows(C.gap_weighted_vote(r).toPandas()) == rows(C.gap_weighted_vote(r.repartition(3)).toPandas())
    assert ("-2", "AT") not in want and "-1" not in {w[0] for w in want}


def test_sub_clusters_keep_their_bounds(spark):
    sizes = registry.QUERIES["p8_sub_clusters"](spark, SF).select(F.size("reads").alias("n")).agg(F.min("n"), F.max("n")).first()
    assert 1 <= sizes[0] and sizes[1] <= 4


def test_partitioning_does_not_change_results(spark):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(registry.QUERIES["v3_plain_vote"](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_close_windows_are_the_nearest_ones():
    import random

    import numpy as np

    from traceloom.operators import demux as D

    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    primers = [some(12) for _ in range(5)]
    texts = ["", "ACG"]
    for _ in range(200):
        p = list(rng.choice(primers))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(p))
            p[at : at + 1] = rng.choice([[], [p[at], "A"], ["C"]])
        texts.append(some(rng.randrange(20)) + "".join(p) + some(rng.randrange(30)))
    letters, n = D._letters(texts)
    patterns = D._letters(primers)[0]
    first, last = np.zeros(len(n), np.int64), n - 12
    d, at = D.nearest_windows(letters, first, last, patterns)
    near = d <= 2
    d2, at2 = D.close_windows(letters, first, last, patterns)
    assert (near == (d2 <= 2)).all() and (d2[near] == d[near]).all() and (at2[near] == at[near]).all() and near.sum() > 100
    for k in (5, 17, 80):
        i = int(d[k].argmin())
        if n[k] >= 12:
            assert d[k, i] == min(distance(texts[k][p : p + 12], primers[i]) for p in range(n[k] - 11))
