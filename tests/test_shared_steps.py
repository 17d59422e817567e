"""Steps that many queries share: what they move, and that their batch forms equal plain loops."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from traceloom.operators import consensus as C
from traceloom.operators import demux as D
from traceloom.operators import errors as E
from traceloom.operators import joins as J
from traceloom.sources import fixture, scans
from traceloom.sources.fixture import reads

SF = "/root/testdata/sf0.001"


def test_reads_shuffle_and_sort_keys_alone(spark):
    plan = reads(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and "md5" not in plan[plan.index("Window") :]


def test_tasks_of_reads_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(fixture, "TASK_ROWS", 250)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for of in (reads(spark, SF).select("cluster_id", "read_no"), fixture.ground_truth(spark, SF).select("gt_id")):
        assert of.rdd.getNumPartitions() == n // 250 + 1
        assert of.count() == spark.read.parquet(f"{SF}/{'lineitem' if 'read_no' in of.columns else 'orders'}.parquet").count()


def test_single_steps_equal_the_alignment():
    r, gts, preds = random.Random(1), [], []
    for _ in range(3000):
        a = [r.choice("AC") for _ in range(r.randrange(9))]
        b = list(a)
        for _ in range(r.choice([0, 1, 1, 2])):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "A", "C", "é"])
        gts.append("".join(a))
        preds.append("".join(b))
    near, steps = E.single_steps(pa.array([*gts, None]), pa.array([*preds, "A"]))
    by_pair = lambda s: {p: [x for x in zip(*(c.tolist() for c in s), strict=True) if x[0] == p] for p in set(s[0].tolist())}
    got, want = by_pair(steps), by_pair(E.edit_steps(gts, preds))
    assert not near[-1]
    for p in range(len(gts)):
        assert near[p] == (len(want.get(p, [])) < 2) and (not near[p] or got.get(p) == want.get(p))


def test_streamed_counts_equal_loops_and_hot_clusters_too(spark, monkeypatch):
    r = random.Random(2)
    rows = [(c, i, None if r.random() < 0.05 else "".join(r.choice("ACGTNé") for _ in range(r.randrange(7)))) for c in range(40) for i in range(r.randrange(1, 7))]
    df, truths = spark.createDataFrame(rows, "cluster_id long, read_no int, read string"), spark.createDataFrame([(c, "ACGTAC") for c in range(0, 40, 2)], "cluster_id long, gt string")
    count, size = {}, Counter(c for c, *_ in rows)
    for c, _, t in rows:
        for p, x in enumerate(t or "", 1):
            count.setdefault((c, p), Counter())[x] += 1
    freq = sorted((c, p, sum(k.values()), *(k[b] for b in "ACGT")) for (c, p), k in count.items())
    best = {}
    for (c, p), k in count.items():
        if c % 2 == 0:
            ranked = sorted(k.items(), key=lambda y: (-y[1], y[0]))
            best[c, p] = (ranked[0][0], ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0), ranked[0][1] / size[c], size[c], ranked[0][0] == "ACGTAC"[p - 1])
    for hot in (C.HOT, 3):
        monkeypatch.setattr(C, "HOT", hot)
        assert sorted(map(tuple, C.base_counts(df).collect())) == freq
        assert {(m[0], m[1]): tuple(m[2:]) for m in C.position_metrics(df, truths).collect()} == best
    plain = df.where(F.col("cluster_id") < 30).where("read not like '%é%'")
    monkeypatch.undo()
    assert sorted(map(tuple, C.plain_vote(plain).collect())) == sorted(map(tuple, C._counted_vote(plain.where("read is not null"), "cluster_id").collect()))


def test_windows_of_no_prefix_are_not_shuffled_and_hits_equal_a_loop(spark, monkeypatch):
    r = random.Random(3)
    reads_ = [(c, 1, None if c == 5 else "".join(r.choice("ACé" if c % 9 == 0 else "AC") for _ in range(r.randrange(30)))) for c in range(200)]
    truths = [(g, None if g == 7 else "".join(r.choice("AC") for _ in range(r.randrange(3, 9)))) for g in range(60)]
    want = sorted((c, i, g, s.find(t[:6]), 0) for c, i, s in reads_ if s is not None for g, t in truths if t is not None and (len(t) >= 6 and len(s) >= 6 and t[:6] in s or s == t[:6]))
    for bits in (J.FILTER_BITS, 1 << 6):
        monkeypatch.setattr(J, "FILTER_BITS", bits)
        found = J.prefix_hits(spark.createDataFrame(reads_, "cluster_id long, read_no int, s string"), spark.createDataFrame(truths, "gt_id long, gt string"), 6)
        assert sorted(map(tuple, found.collect())) == want
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_a_search_are_never_broadcast(spark):
    few = J.within_distance(spark.createDataFrame([("ACGT" * 27,)], "s string"), spark.createDataFrame([("ACGA" * 27,)], "g string"), 5, 13)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan


def test_a_truth_that_holds_its_reverse_primer_is_not_cut(spark):
    p = J.primers(spark).where("exp = 3").first()
    gt = "ACGT" * 15 + p["r"] + "ACGTT" * 8
    turned = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[x] for x in reversed("CAT" + p["f"] + gt + p["r"] + "A"))
    rows = [(1, 3, f"CAT{p['f']}{gt}{p['r']}"), (2, 3, f"{p['f']}{gt}{p['r']}"), (3, 3, turned)]
    got = D.truth_payloads(spark.createDataFrame(rows, "gt_id long, exp long, s string"), J.primers(spark)).collect()
    assert sorted(map(tuple, got)) == [(1, 3, gt, False), (2, 3, gt, True), (3, 3, gt, False)]


def test_pairs_of_whole_primers_equal_a_loop():
    r = random.Random(4)
    k, known = 12, [("".join(r.choice("ACGT") for _ in range(12)), "".join(r.choice("ACGT") for _ in range(12))) for _ in range(5)]
    texts = ["", "A" * 23, *(f + r_ for f, r_ in known), known[0][1] + "ACGT" * 9 + known[0][0]]
    for _ in range(300):
        (f, _), (_, g), (x, y) = r.choice(known), r.choice(known), r.choice(known)
        texts.append("".join(r.choice("ACGN") for _ in range(r.randrange(6))) + r.choice([f, x]) + "ACGTTG" * r.randrange(12) + r.choice(["", x, y]) + r.choice([g, y]) + "A" * r.randrange(4))
    want = []
    for t in texts:
        half, best = len(t) // 2, (-1, -1, -1)
        for e, (f, g) in enumerate(known):
            p, q = t.find(f, 0, half + 1), t.find(g, half)
            if best[0] < 0 and p >= 0 and q > p + k:
                best = (e, p, q)
        want.append(best)
    rows = lambda x: D.letters(pa.array(x))
    got = D.whole_pairs(*rows(texts), rows([f for f, _ in known])[0], rows([g for _, g in known])[0])
    assert list(map(tuple, got.tolist())) == want and 50 < sum(w[0] >= 0 for w in want) < len(texts)


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_distances_of_many_pairs_equal_a_loop(spark):
    r = random.Random(5)
    sizes = [0, 1, 63, 64, 65, 128, 129, 190]
    text = lambda s: "".join(r.choice(s) for _ in range(r.choice([*sizes, r.randrange(40)])))
    a, b = [text("ACG") for _ in range(200)], [text("ACGé") for _ in range(200)]
    b[::3] = [x[:30] + x[31:] for x in a[::3]]
    for cells in (1 << 16, 50):
        assert E.edit_distances(D.letters(pa.array(a)), D.letters(pa.array(b)), cells).tolist() == list(map(_lev, a, b))
    df = spark.createDataFrame([*zip(a, b, strict=True), (None, "A"), ("A", None)], "a string, b string")
    assert sorted(map(str, (x.d for x in E.edit_distance(df, "a", "b").collect()))) == sorted([*map(str, map(_lev, a, b)), "None", "None"])
    ham = lambda x, y: sum(i != j for i, j in zip(x, y, strict=False)) + abs(len(x) - len(y))
    assert sorted(map(str, (x.d for x in E.differing_symbols(df, "a", "b").collect()))) == sorted([*map(str, map(ham, a, b)), "None", "None"])
    assert "levenshtein" not in E.edit_distance(df, "a", "b")._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_within_clusters_equal_loops_and_hot_clusters_too(spark, monkeypatch):
    from itertools import combinations
    from statistics import mean, pstdev

    r = random.Random(6)
    rows = [(c, i, None if r.random() < 0.05 else "".join(r.choice("ACG-é") for _ in range(r.randrange(6))), "ACGTAC") for c in range(40) for i in range(1, r.randrange(2, 7))]
    df = spark.createDataFrame(rows, "cluster_id long, read_no int, read string, gt string")
    ham = lambda x, y: sum(i != j for i, j in zip(x, y, strict=False)) + abs(len(x) - len(y))
    near = lambda x, y: x == y or x is not None and y is not None and abs(x - y) < 1e-9
    of = {c: [t for k, _, t, _ in rows if k == c] for c, *_ in rows}
    for hot in (C.HOT, 2):
        monkeypatch.setattr(C, "HOT", hot)
        monkeypatch.setattr(C, "MANY", hot)
        far = {x.cluster_id: x for x in C.pairwise_hamming(df).collect()}
        dist = {x.cluster_id: x for x in C.cluster_distances(df).collect()}
        vote = {x.cluster_id: x for x in C.ensemble_vote(df, keys=df).collect()}
        for c, texts in of.items():
            known = [t for t in texts if t is not None]
            d = [ham(x, y) for x, y in combinations(known, 2)]
            assert (c in far) == bool(d) and (not d or near(far[c]["mean"], mean(d)) and near(far[c]["std"], pstdev(d)) and (far[c]["most"], far[c]["least"]) == (max(d), min(d)))
            own, two = [_lev(t, "ACGTAC") for t in known], [_lev(x, y) for x, y in combinations(known, 2)]
            assert dist[c].n == len(texts) and dist[c].err == (None if texts[0] is None else own[0])
            assert near(dist[c].d, mean(own) if own else None) and near(dist[c].far, mean(two) if two else None)
            longest, made, shares = max(map(len, known), default=0), "", []
            for p in range(longest):
                column = [t.ljust(longest, "-")[p] for t in known]
                best = max(column, key=column.count)
                made, shares = made + best, [*shares, column.count(best) / len(texts)]
            assert (c in vote) == (longest > 0)
            if longest:
                v = vote[c]
                assert (v.n, v.consensus, v["first"]) == (len(texts), made.rstrip("-"), texts[0]) and near(v.mean_agreement, mean(shares)) and near(v.min_agreement, min(shares))
                assert near(v.diversity_mean, mean(d) if d else None) and near(v.diversity_std, pstdev(d) if d else None)


def test_texts_of_clusters_are_made_of_keys_after_the_keys_are_dealt(spark):
    keys, texts, gt = fixture.cluster_keys(spark, SF)
    assert "md5" not in keys._jdf.queryExecution().optimizedPlan().toString()
    made = {r.idx: (r.gt, list(r.texts)) for r in keys.select("idx", gt.alias("gt"), texts.alias("texts")).collect()}
    want = {r.cluster_id: (r.gt, list(r.reads)) for r in fixture.clusters(spark, SF).collect()}
    assert {k: v for k, v in made.items() if v[1]} == want and len(made) == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_records_of_a_file_are_read_by_eight_tasks(spark, tmp_path):
    rows = [(f"r{i}", "ACGT" * (i % 9), "I" * (4 * (i % 9))) for i in range(999)]
    scans.write_fastq(spark.createDataFrame(rows, "read_id string, seq string, qual string").coalesce(1), str(tmp_path / "f"), gzip=True)
    back = scans.fastq(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, back.collect())) == sorted(rows) and back.rdd.getNumPartitions() == 8
