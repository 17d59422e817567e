"""What streams by in whole clusters: results equal plain loops, clusters over the limit too, and reads dealt by cluster aren't shuffled again."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from traceloom.functions import sequence as S
from traceloom.operators import consensus as C
from traceloom.operators import errors as E
from traceloom.plans import registry

SF = "/root/testdata/sf0.001"



def test_votes_equal_loops_and_hot_clusters_too(spark, monkeypatch):
    r = random.Random(8)
    # Gap votes know N, the others D and I; é is known to none.
    rows = [(c, i, None if r.random() < 0.05 else "".join(r.choice("ACGT-Né" if c < 30 else "ACGT-DIé") for _ in range(r.randrange(7))), r.choice([1, 2, 3])) for c in range(60) for i in range(1, r.randrange(2, 7))]
    df = spark.createDataFrame(rows, "cluster_id long, read_no int, read string, w long")
    of = {c: [(t, w) for k, _, t, w in rows if k == c and t is not None] for c, *_ in rows}

    def columns(texts):
        for p in range(max(map(len, (t for t, _ in texts)), default=0)):
            yield p + 1, [(t[p], w) for t, w in texts if len(t) > p]

    def spelled(pick, texts):
        return {c: s for c, x in of.items() if (s := "".join(pick(c, p, col) for p, col in columns(texts(x))))}

    rank = lambda b, order: -(order.find(b) + 1)
    weigh = lambda col, own: Counter({b: sum(w if own else 1 for x, w in col if x == b) for b in dict(col)})

    def gap(own):
        def pick(c, p, col):
            n = weigh(col, own)
            b = max(n, key=lambda b: (n[b] * (0.4 if b == "-" else 1.0), rank(b, "ACGT-N")))
            return "" if b == "-" else b

        return spelled(pick, lambda x: x)

    padded = lambda x: [((t + "#" * 5)[:5], w) for t, w in x]
    first = lambda col, b: next(i for i, (x, _) in enumerate(col) if x == b)

    def seen(c, p, col):
        n = weigh(col, False)
        return max(n, key=lambda b: (b not in "#-", n[b], -first(col, b)))

    def tie(deletions):
        def pick(c, p, col):
            n = weigh(col, False)
            key = lambda b: (n[b], b != "-", -first(col, b))
            b = max(n, key=key)
            if deletions and b == "D":
                bases = [x for x in n if x in "ACGT"]
                b = max(bases, key=key) if bases else "ACGT"[int(hashlib.md5(f"{c}:{p}".encode()).hexdigest()[0], 16) % 4]
            return b

        return spelled(pick, padded)

    def marked(c, p, col):
        n = weigh(col, False)
        key = lambda b: (n[b], rank(b, "ACGT-DI"))
        bases = [x for x in n if x in "ACGT"]
        return "-" if "I" in n else (max(bases, key=key) if bases else "-") if "D" in n else max(n, key=key)

    want = [gap(False), gap(True), spelled(seen, padded), tie(False), tie(True), spelled(marked, lambda x: x)]
    for hot in (C.HOT, 3):
        monkeypatch.setattr(C, "HOT", hot)
        made = [C.gap_weighted_vote(df), C.gap_weighted_vote(df, weight="w"), C.first_seen_vote(df, 5), C.gap_tie_vote(df, 5), C.gap_tie_vote(df, 5, deletions=True), C.marked_vote(df)]
        for no, (got, w) in enumerate(zip(made, want, strict=True)):
            known = range(30) if no < 2 else range(30, 60) if no == 5 else range(60)
            assert {x.cluster_id: x.consensus for x in got.collect() if x.cluster_id in known} == {c: t for c, t in w.items() if c in known}, no


def test_votes_neither_explode_places_nor_shuffle_reads_again(spark):
    for name in ("v1_gap_weighted_vote", "v2_first_seen_vote", "v3_plain_vote", "v4_gap_tie_vote", "v4_gap_tie_vote_deletions", "v5_marked_vote", "v6_weighted_vote"):
        df = registry.QUERIES[name](spark, SF)
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString(), name
        assert df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 2, name  # the keys of reads, and of orders


def test_distances_of_reads_equal_loops(spark):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("ACé") for _ in range(r.randrange(8))), "".join(r.choice("ACé") for _ in range(r.randrange(8)))) for i in range(300)] + [(300, None, "A"), (301, "A", None)]
    got = {x.i: (x.lev, x.ham) for x in E.both_distances(spark.createDataFrame(rows, "i long, gt string, read string"), "gt", "read").collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    ham = lambda a, b: sum(x != y for x, y in zip(a, b.ljust(len(a), "\1"), strict=False))
    assert got == {i: (None, None) if a is None or b is None else (lev(a, b), ham(a, b)) for i, a, b in rows}
    for name in ("m1_m2_distances", "a42_cluster_quality", "t4_worst_share_by_size", "k12_worst_tsv"):
        assert "levenshtein" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString(), name


def test_the_worst_are_ranked_from_a_kept_table(spark):
    plan = registry.QUERIES["t4_worst_share_by_size"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "l_orderkey" not in plan


def test_one_hot_text_equals_the_rows(spark):
    rows = [("",), ("ACGT",), ("ANé-TT",), ("A" * 9,), ("T" * 12,), (None,)]
    shown = lambda hot: F.array_join(F.transform(hot, lambda r: F.array_join(F.transform(r, lambda v: v.cast("int").cast("string")), "")), " ")
    for both in (False, True):
        got = spark.createDataFrame(rows, "s string").select(S.one_hot_text(F.col("s"), 9, both).alias("a"), shown(S.pad_rows(S.one_hot(F.col("s")), 9, both)).alias("b")).collect()
        assert all(x.a == x.b for x in got) and len(got[1].a) == 44
    assert "lambda" not in registry.QUERIES["m11_one_hot"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_encoded_pairs_and_their_text_equal_the_column_functions(spark):
    from traceloom.operators.encoding import shifted_pairs, shown

    rows = [(i, t) for i, t in enumerate(["", "ACGT-|:#", "Aé", "T" * 9, None, "ACG:ACN"])]
    df = spark.createDataFrame(rows, "i long, s string")
    x, y = S.shift_pair(S.encode(S.pad(F.col("s"), 9)))
    want = sorted(df.where("s is not null and s <> ''").select("i", x.alias("x"), y.alias("y")).collect())
    made = shifted_pairs(df, "s", 9)
    assert sorted(r for r in made.collect() if r.x is not None and r.i) == want and made.where("x is null").select("i").collect() == [(4,)]
    assert made.where("i = 0").first().x == [7] * 8
    text = {r.i: r.x for r in shown(made, "x").collect()}
    assert text == {r.i: None if r.x is None else ",".join(map(str, r.x)) for r in made.collect()}
    assert "lambda" not in registry.QUERIES["k14_encoded_dataset"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_repeated_traces_are_written_compressed(spark):
    files = registry.QUERIES["s9_k8_prediction_tsv"](spark, SF).inputFiles()
    assert files and all(f.endswith(".csv.gz") for f in files)


def noisy_rows(seed, clusters):
    r = random.Random(seed)
    return [(c, i, None if r.random() < 0.05 else "".join(r.choice("ACGTN") for _ in range(r.randrange(8))), "ACGTACG"[: 5 + c % 3]) for c in range(clusters) for i in range(1, r.randrange(2, 7))]


def test_errors_of_frequencies_and_entropies_equal_loops(spark, monkeypatch):
    from math import log

    rows = noisy_rows(10, 40)
    df = spark.createDataFrame(rows, "cluster_id long, read_no int, read string, gt string")
    near = lambda x, y: all(a == b if isinstance(a, (int, str)) else abs(a - b) < 1e-9 for a, b in zip(x, y, strict=True))
    whole, single, entropy = {}, {}, {}
    for c in range(40):
        texts, gt = [t for k, _, t, _ in rows if k == c and t], next(g for k, _, _, g in rows if k == c)
        each = []
        for p in range(max(map(len, texts), default=0)):
            column = [t[p] for t in texts if len(t) > p]
            d, share = len(column), {b: column.count(b) / len(column) for b in "ACGT"}
            each.append(-sum((column.count(b) + 0.5) / (d + 2) * log((column.count(b) + 0.5) / (d + 2)) for b in "ACGT"))
            if p >= 6:
                continue
            true = gt[p : p + 1]
            right = share.get(true, share["T"])
            add = (1, (sum(s * s for s in share.values()) - 2 * right + 1) / 4, (2 - 2 * right) / 4, -log(max(right, 1e-12)), float(right == max(share.values())))
            whole[d] = tuple(map(sum, zip(whole.get(d, (0,) * 5), add, strict=True)))
            for b in "ACGT":
                e = share[b] - (b == true)
                single[d, b] = tuple(map(sum, zip(single.get((d, b), (0,) * 3), (1, e * e, abs(e)), strict=True)))
        if each:
            entropy[c] = (sum(k == c for k, *_ in rows), sum(each) / len(each))
    for hot in (C.HOT, 3):
        monkeypatch.setattr(C, "HOT", hot)
        got = {x.depth: tuple(x)[1:] for x in C.frequency_errors(df, 6).groupBy("depth").agg(*(F.sum(c) for c in ("positions", "mse", "mae", "kl", "agreement"))).collect()}
        assert got.keys() == whole.keys() and all(near(got[d], whole[d]) for d in got)
        got = {(x.depth, x.base): tuple(x)[2:] for x in C.base_errors(df, 6).groupBy("depth", "base").agg(*(F.sum(c) for c in ("positions", "mse", "mae"))).collect()}
        assert got.keys() == single.keys() and all(near(got[d], single[d]) for d in got)
        got = {x.cluster_id: tuple(x)[1:] for x in C.mean_entropy(df).collect()}
        assert got.keys() == entropy.keys() and all(near(got[c], entropy[c]) for c in got)


def test_concentration_of_clusters_equals_that_of_examples(spark, monkeypatch):
    from traceloom.operators.attention import cluster_concentration, example_concentration

    r = random.Random(12)
    rows = [(c, i, [0.0 if r.random() < 0.3 else r.randrange(16) / 16.0 for _ in range(5)]) for c in range(40) for i in range(1, r.randrange(2, 9))]
    df = spark.createDataFrame(rows, "cluster_id long, read_no int, weights array<double>")
    long = df.select(F.col("cluster_id").alias("example"), "read_no", F.posexplode("weights").alias("token", "weight"))
    names = ("reads", "tokens", "reads_90", "concentration", "entropy", "consistency", "normalized")
    want = {x.example: [x[c] for c in names] for x in example_concentration(long).collect()}
    for hot in (C.HOT, 3):
        monkeypatch.setattr(C, "HOT", hot)
        step = C.Derived(df, tuple(F.col(c) for c in df.columns), lambda batches: (b.drop_columns(["_no"]) if "_no" in b.schema.names else b for b in batches), "cluster_id long, read_no int, weights array<double>")
        got = {x.cluster_id: [x[c] for c in names] for x in cluster_concentration(step).collect()}
        assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for c in got for a, b in zip(got[c], want[c], strict=True))


def test_homopolymer_counts_equal_the_join_of_runs(spark):
    r = random.Random(13)
    rows = [(i, 1, "".join(r.choice("AC") for _ in range(r.randrange(14))), "".join(r.choice("AC") for _ in range(r.randrange(14)))) for i in range(400)]
    for i, (_, _, gt, _) in enumerate(rows[::2]):
        at = r.randrange(len(gt) + 1)
        rows[2 * i] = (2 * i, 1, gt, gt[:at] + r.choice(["", "A", "C"]) + gt[at + r.randrange(2) :])
    df = spark.createDataFrame([*rows, (400, 1, None, "A"), (401, 1, "AAA", None)], "cluster_id long, read_no int, gt string, read string")
    runs = E.homopolymers(df.where("gt is not null"), "cluster_id", "gt")
    ops = E.edit_operations(df).select("cluster_id", "read_no", F.posexplode("ops").alias("no", "o")).select("cluster_id", "read_no", "no", "o.*")
    want = {("operation", x.op, x.hp_class, x.hp_length): x.n for x in E.homopolymer_class(ops, runs).groupBy("op", "hp_class", "hp_length").agg(F.count("*").alias("n")).collect()}
    want |= {("run", None, None, x.length): x.n for x in runs.groupBy((F.col("end") - F.col("start")).alias("length")).agg(F.count("*").alias("n")).collect()}
    want["bases", None, None, None] = sum(len(g) for _, _, g, _ in rows) + 3
    assert {tuple(x)[:4]: x.n for x in E.homopolymer_counts(df).collect()} == want and len({k[2] for k in want}) == 6


def test_a_sweep_counts_what_single_windows_find(spark):
    from traceloom.operators import joins as J

    r = random.Random(14)
    rows = [(c, 1, None if c == 3 else "".join(r.choice("ACGT") for _ in range(r.randrange(9))) + r.choice(["ACAAC", "ACATC", "AAAAC", "ACNAC"]) + "".join(r.choice("ACGTé" if c % 7 == 0 else "ACGT") for _ in range(r.randrange(5, 14)))) for c in range(300)]
    df, valid = spark.createDataFrame(rows, "cluster_id long, read_no int, s string"), spark.range(16384).where("id % 3 <> 0").withColumnRenamed("id", "v")
    settings = [(0, 30, 0), (0, 30, 2), (3, 18, 1), (25, 26, 1)]
    found = {(x.start, x.end, x.most): (x.clusters, x.found) for x in J.index_clusters(df, valid, settings).groupBy("start", "end", "most").agg(F.count_distinct("v").alias("clusters"), F.count("*").alias("found")).collect()}
    got = J.index_sweep(df, valid, settings)
    assert {(x.start, x.end, x.most): (x.clusters, x.found, x.total, x.failed) for x in got.collect()} == {s: (*found.get(s, (0, 0)), 300, 300 - found.get(s, (0, 0))[1]) for s in settings}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_of_a_search_find_what_one_finds(spark, monkeypatch):
    from traceloom.operators import joins as J

    r = random.Random(15)
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    truths = [text(40) for _ in range(30)] + [text(33), "ACGTé" * 6, "ACG"]
    reads_ = ["", None, "ACGTT", "AC"]
    for g in truths:
        for edits in range(0, 12, 2):
            t = list(g)
            for _ in range(edits):
                at = r.randrange(len(t) + 1)
                t[at : at + r.randrange(2)] = r.choice(["", r.choice("ACGTNé")])
            reads_.append("".join(t))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {s for s in reads_ if s is not None and any(3 <= lev(s, g) <= 7 for g in truths)}
    a, b = spark.createDataFrame([(x,) for x in reads_], "s string"), spark.createDataFrame([(x,) for x in truths], "g string")
    for bits in (J.ROUND_BITS, 1 << 16):  # in one round, and in eight
        monkeypatch.setattr(J, "ROUND_BITS", bits)
        assert {x.s for x in J.within_distance(a, b, 3, 7).collect()} == want and 20 < len(want) < len(set(reads_))


def test_windows_that_no_segment_can_be_are_not_shuffled(spark):
    from traceloom.operators import joins as J

    r = random.Random(16)
    text = lambda: "".join(r.choice("ACGT") for _ in range(110))
    g, s = J._packed_texts(spark.createDataFrame([(text(),) for _ in range(20)], "g string")), J._packed_texts(spark.createDataFrame([(text(),) for _ in range(50)], "s string"))
    keys = J._segment_keys(g, tuple(range(7)), 7, 0, 1)
    n = keys.count()
    assert J._window_keys(s, [15], tuple(range(7)), 7, 13, 0, 1, J.seed_filter(keys, n)).count() < 50 and n > 7 * 20 * 100
