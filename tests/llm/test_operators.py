"""The ten operators and the pipeline against brute force, with nulls, empty texts, ties, repeats and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from traceloom.llm import registry
from traceloom.llm._shared import table
from traceloom.llm._graph import components
from traceloom.llm.dp_bpe import bpe_decode, bpe_round_trip, byte_vocabulary, encoder
from traceloom.llm.gam_quality import gam_quality
from traceloom.llm.kmeans_tree import kmeans_tree_search
from traceloom.llm.lpf_dedup import lpf_dedup
from traceloom.llm import mixing_lm as LM
from traceloom.llm.mixing_lm import mixing_scores
from traceloom.llm.order_minhash import near_duplicates, similarity
from traceloom.llm.pattern_packing import pack_documents, plan, word_vocabulary
from traceloom.llm.rp_forest import rp_forest_duplicates
from traceloom.llm.stratified_shards import shuffle_key, stratified_shards
from traceloom.llm.suffix_tree_dedup import suffix_tree_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, copies, a long word, extra columns with names that operators use."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n "), (4, passage), (5, "x " + passage + " y"), (6, passage), (7, "z" * 3000), (8, "ab"), (9, "<|endoftext|> a's ü😀  b"), (10, "")]
    return spark.createDataFrame([(i, t, None if i == 3 else "s", 0, 0) for i, t in rows], "doc_id long, text string, source string, doc int, score int")


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def removed(texts, window, later_only):
    first, count = {}, collections.Counter()
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_op1_recall_and_scores(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), float)
    got = registry.QUERIES["op1_kmeans_tree"](spark, SF).toPandas()
    hits = total = 0
    for q, f in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        hits, total = hits + len(best & set(f["vec_id"])), total + 20
        assert list(f["rank"].sort_values()) == list(range(1, 21))
    assert hits / total >= 0.9


def test_op1_op6_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in kmeans_tree_search(v, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 1.0), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 5, 0.0)]
    links = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rp_forest_duplicates(v).collect()}
    assert links[0] == (1, 0, True) and links[5] == (1, 0, False) and links[1] == (0, 1, True) and len(links) == 7
    empty = v.where("false")
    assert kmeans_tree_search(empty, F.col("vec_id") % 20 == 0).count() == 0 and rp_forest_duplicates(empty).count() == 0


def test_op1_recall_with_grown_trees_and_split_queries(spark):
    """Recall against brute force where leaves, buckets, blocks and splits are many, with clusters and copies."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(2000, 16)), rng.normal(size=(40, 16)).repeat(50, axis=0) + 0.05 * rng.normal(size=(2000, 16)), np.tile(rng.normal(size=16), (700, 1))])
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    got = kmeans_tree_search(v, F.col("vec_id") % 5 == 0, leaf_rows=16, block_rows=300, query_rows=100).toPandas()
    hits = 0
    for q, f in got.groupby("query_id"):
        f = f.sort_values("rank")
        s = (x * x[q]).sum(axis=1)
        assert len(f) == 20 and np.allclose(f["score"], s[f["vec_id"]]) and (np.diff(f["score"]) <= 0).all() and q not in set(f["vec_id"])
        s[q] = -np.inf
        hits += (f["score"] >= np.sort(s)[-20] - 1e-9).sum()
    assert got["query_id"].nunique() == len(range(0, len(x), 5)) and hits / len(got) >= 0.9


def test_op1_op6_repeated_rows_are_one(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.9, 0.0]), (2, [0.9, 0.0]), (3, [0.0, 1.0])]
    v = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, leaf string")
    got = kmeans_tree_search(v, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2), (3, 3)]
    links = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest_duplicates(v).collect()}
    assert links == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3)}


def test_op6_grows_under_full_leaves(spark):
    """A first forest of a few leaves, so that several rounds split them: near copies are found, each pair is counted once, no other
    pair is linked, and a group too close to split, larger than a block, keeps all its links."""
    rng = np.random.default_rng(16)
    near = rng.normal(size=(400, 48)).repeat(3, axis=0) + 0.12 * rng.normal(size=(1200, 48))
    group = rng.normal(size=48) + 0.1 * rng.normal(size=(300, 48))
    x = np.concatenate([rng.normal(size=(3000, 48)), near, group])
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    got = rp_forest_duplicates(v, leaf=60, sample=100, block_rows=150, fit_rows=128).orderBy("vec_id").toPandas()
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert len(got) == len(x) and want[3000:4200].sum() > 1500 and want[4200:].sum() > 80_000
    assert (got["n_links"].to_numpy() <= want).all() and (got["n_links"][:3000] == 0).all()
    assert got["n_links"][3000:4200].sum() >= 0.97 * want[3000:4200].sum() and got["n_links"][4200:].sum() >= 0.99 * want[4200:].sum()
    assert set(got["component_id"][4200:]) == {4200}


def test_op6_links_at_exactly_the_threshold(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "vec_id long, embedding array<double>")
    for cosine, want in ((0.6, [(1, 1), (1, 1)]), (float(np.nextafter(0.6, 1)), [(0, 1), (0, 2)])):
        assert [(r.n_links, r.component_id) for r in rp_forest_duplicates(v, cosine=cosine).orderBy("vec_id").collect()] == want


def test_op6_links_are_those_of_brute_force(spark):
    """Planted near copies, some close to the threshold, among unlike vectors."""
    rng = np.random.default_rng(6)
    x = [rng.normal(size=32) for _ in range(900)]
    for i in range(300):
        base = x[int(rng.integers(600))]
        x.append(base + rng.normal(size=32) * np.linalg.norm(base) / np.sqrt(32) * rng.choice([0.05, 0.2, 0.3, 0.4]))
    x += [x[7] * 2.0] * 40 + [x[8]] * 3
    x = np.array(x)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    up = np.arange(len(x))
    while True:
        new = np.array([min(up[i], up[linked[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == up).all():
            break
        up = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rp_forest_duplicates(v).collect()}
    want = {i: (int(linked[i].sum()), int(up[i]), bool(up[i] == i)) for i in range(len(x))}
    assert sum(w[0] for w in want.values()) > 1500
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 0.01 * sum(w[0] > 0 for w in want.values())


def test_op1_returns_all_candidates_of_small_tables(spark):
    x = np.random.default_rng(3).normal(size=(60, 8))
    for n in (21, 60):
        v = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "vec_id long, embedding array<double>")
        got = kmeans_tree_search(v, F.lit(True), recall=0.2, calibration=8).toPandas()
        assert (got.groupby("query_id").size() == 20).all() and got["query_id"].nunique() == n


def test_op1_op6_one_longer_vector(spark):
    rows = [(i, [1.0, i / 100, 0.5]) for i in range(5)] + [(9, [1.0, 0.0, 0.5, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kmeans_tree_search(v, F.col("vec_id") < 5).toPandas()
    assert (got.groupby("query_id").size() == 4).all() and got["query_id"].nunique() == 5
    links = {r.vec_id: r.n_links for r in rp_forest_duplicates(v).collect()}
    assert links == {i: 4 for i in range(5)} | {9: 0}


def test_op2_held_out_accuracy(spark, odd):
    got = registry.QUERIES["op2_gam_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    labels = spark.createDataFrame([(2, 0), (4, 1), (6, 1), (8, None)], "doc_id long, quality int")
    assert gam_quality(odd, labels).where("score between 0 and 1").count() == 10
    assert gam_quality(odd.where("false"), labels).count() == 0


def test_op3_packs_whole(spark, odd):
    for d in (docs(spark), odd):
        got = pack_documents(d, word_vocabulary()).toPandas().sort_values(["sequence_id", "offset"])
        assert set(got["doc_id"]) == {r[0] for r in d.select("doc_id").collect()}
        ends = got.groupby("sequence_id").apply(lambda f: ((f["offset"] == f["length"].cumsum() - f["length"]).all(), f["length"].sum()))
        assert all(ok and n <= 4096 for ok, n in ends)
    assert pack_documents(odd.where("false"), word_vocabulary()).count() == 0


def test_op3_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    h = collections.Counter(np.minimum(rng.lognormal(6.3, 1, 20_000).astype(int) + 1, 4096).tolist())
    slots = plan(dict(h), 4096)
    assert sum(s[2] for s in slots) == 20_000
    sequences = 1 + max(s[3] + (s[2] - 1) // s[4] for s in slots)
    assert sequences <= 1.005 * sum(n * c for n, c in h.items()) / 4096 + 1


def test_op4_shards_match_the_mixture(spark, odd):
    got = registry.QUERIES["op4_stratified_shards"](spark, SF).join(docs(spark).select("doc_id", "source"), "doc_id").toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(f["slot"]) == list(range(len(f))) for _, f in got.groupby("shard"))
    by = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (by.max(axis=1) - by.min(axis=1)).max() <= 2
    crc = {r.doc_id: r.text_crc32 for r in stratified_shards(odd).collect()}
    assert crc[1] == 0 and crc[8] == zlib.crc32(b"ab") and len(crc) == 10
    assert stratified_shards(odd.where("false")).count() == 0


def test_op4_equals_ranks_by_hand(spark):
    """Ranks, fractions and cuts over a plain list, with many rows without doc_id, many copies and null sources."""
    plain = [(i, f"text {i}", "abc"[i % 3]) for i in range(200)] + [(None, f"t{i % 40}", "a") for i in range(300)] + [(7, "same", "b")] * 150 + [(8, None, None)] * 3
    d = spark.createDataFrame(plain, "doc_id long, text string, source string")
    got = collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in stratified_shards(d, bucket_rows=16).collect())
    seen: collections.Counter = collections.Counter()
    rows = []
    for i, t, s in plain:
        row = (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s)
        rows.append((*row, seen[row]))
        seen[row] += 1
    keyed = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long, source string, copy long").withColumn("key", shuffle_key(17)).collect()
    by = collections.defaultdict(list)
    for r in keyed:
        by["" if r.source is None else "s" + r.source].append((r.key, r.doc_id, r.size, r.text_crc32))
    order = sorted(((k + 0.5) / len(group), s, k, row) for s, group in by.items() for k, row in enumerate(sorted(group)))
    n, want = len(order), collections.Counter()
    for place, (_, _, _, row) in enumerate(order):
        shard = place * 8 // n
        want[(*row[1:], shard, place - -(-shard * n // 8))] += 1
    assert got == want and len(rows) == sum(got.values())


def test_op5_classes(spark, odd):
    base = [f"t{i}" for i in range(200)]
    near = base[:100] + ["new"] + base[101:]
    far = [f"u{i}" for i in range(200)]
    rows = [(1, base), (2, near), (3, far), (4, base), (5, base[:90] + far[:110])]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    assert {r.doc_id: r.component_id for r in near_duplicates(odd).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9, 10: 2}
    assert near_duplicates(d.where("false")).count() == 0
    x = np.arange(100, dtype=np.uint64)
    assert similarity(x, x, 0.8) == 1.0 and similarity(x, x[::-1].copy(), 0.8) == 0.0


def test_op7_op8_remove_repeats(spark, odd, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_tree_dedup(docs(spark)).collect()}
    assert got == removed(texts, 50, True)
    small = {r.doc_id: (r.n_words, r.n_removed) for r in suffix_tree_dedup(odd).collect()}
    assert small[1] == (0, 0) and small[4] == (60, 0) and small[5] == (62, 60) and small[6] == (60, 60)
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in lpf_dedup(odd, window=100).collect()}
    size = len(" ".join(f"w{i}" for i in range(60)))
    assert cut[4] == (size, size, 1) and cut[5] == (size + 4, size, 1) and cut[7] == (3000, 3000, 1) and cut[8] == (2, 0, 0)
    first = {r.doc_id: r.n_removed for r in lpf_dedup(odd, window=100, keep_first=True).collect()}
    assert first[4] == 0 and first[5] == size and first[6] == size
    assert suffix_tree_dedup(odd.where("false")).count() == 0 and lpf_dedup(odd.where("false")).count() == 0


def test_op9_is_exact(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_vocabulary())
    t.no_truncation()
    t.no_padding()
    for r, text in zip(bpe_round_trip(odd, byte_vocabulary()).orderBy("doc_id").collect(), [x[0] for x in odd.orderBy("doc_id").select("text").collect()], strict=True):
        assert r.ids == t.encode(text or "", add_special_tokens=False).ids and r.decoded == (text or "")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {}
    for r in d.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op9_dp_bpe"](spark, "/root/testdata/sf0.01").collect()} == want


def test_op9_white_space_and_marks():
    import random

    from tokenizers import Tokenizer

    e, t, rng = encoder(byte_vocabulary()), Tokenizer.from_file(byte_vocabulary()), random.Random(5)
    parts = ["a", "b", "The", "  ", " ", "\n", "\t", "\u2003", "é", "日本", "😀", "123", "'s", "'ll", "!!", "<|endoftext|>", " \n", "ing", "aaaa", ".", ",", "\r\n", "zz" * 20, "\x1c", "\x85"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        csv = e.document(text)
        assert [int(i) for i in csv.split(b",") if i] == t.encode(text, add_special_tokens=False).ids and e.decode(csv) == text, repr(text)


def test_op9_decodes_any_ids(spark):
    """Ids in any order, most of which are no UTF-8 together, give the library's text."""
    import random

    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(byte_vocabulary()), random.Random(6)
    rows = [(i, [rng.randrange(t.get_vocab_size()) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(20))]) for i in range(3000)]
    got = {r.doc_id: r.text for r in bpe_decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), byte_vocabulary()).collect()}
    assert got == {i: t.decode(ids, skip_special_tokens=False) for i, ids in rows}
    odd = spark.createDataFrame([(1, None, 7), (None, [], 7), (3, [None, 64], 7), (3, [99999999, 64], 7), (3, [64, 64], 7)], "doc_id long, ids array<int>, text int")
    one = t.decode([64], skip_special_tokens=False)
    assert sorted(map(tuple, bpe_decode(odd, byte_vocabulary()).collect()), key=str) == sorted([(1, None), (None, ""), (3, one), (3, one), (3, one * 2)], key=str)
    assert bpe_decode(odd.where("false"), byte_vocabulary()).count() == 0


def test_op10_base_and_model(spark, odd, texts):
    got = registry.QUERIES["op10_mixing_lm"](spark, SF).toPandas()
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""] for i, t in texts.items()}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    for r in got.itertuples():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[r.doc_id])
        assert abs(base - r.base_score) < 1e-6 * abs(base) and r.n_known == sum(count[w] > 0 for w in tokens[r.doc_id]) and r.score < 0
    assert mixing_scores(odd).count() == 10
    assert mixing_scores(odd.where("false")).count() == 0


def test_op10_rare_tokens_of_null_and_repeated_ids(spark):
    texts = [(None, "a b c d d"), (None, "e f"), (None, None), (7, "a a g"), (7, "h"), (8, "b d e")]
    got = mixing_scores(spark.createDataFrame(texts, "doc_id long, text string"), slice_bytes=3).toPandas()
    train = [(t or "").split() + [""] for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for ws in train for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in (t or "").split() + [""]) for _, t in texts)
    assert np.allclose(sorted(got["base_score"]), want) and (got["n_known"] <= got["n_tokens"]).all()


def test_op10_counts_of_contexts_are_those_of_all_training_texts(spark, texts):
    """Codes and counts that blocks get back against dictionaries of words."""
    rows = [(i, (texts[i] or "").encode(), zlib.crc32(str(i).encode()) % 5 == 1) for i in sorted(texts)] + [(10**6, b"a of the end a of the end b", False)]
    df = spark.createDataFrame(rows, "doc_id long, text binary, held boolean").repartition(5)
    blocks = table(df.mapInArrow(LM._blocks, LM._BLOCK))
    answers = blocks.mapInArrow(LM._ask(7), LM._QUESTION).groupBy("slice").applyInPandas(LM._answer, LM._ANSWER)
    asked = blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("slice", "pairs", "words")).alias("answers")), "block").toArrow().to_batches()

    def contexts(words):
        for i, w in enumerate(words):
            back = [words[i - k] if i >= k else k for k in range(1, 5)]
            short = sum(isinstance(x, bytes) and len(x) <= 3 for x in back[:2])
            yield tuple(back[: 2 + short]), w

    split = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.lower()) + [b""] for i, t, _ in rows}
    held = {i: h for i, _, h in rows}
    follow, count = collections.defaultdict(collections.Counter), collections.Counter()
    for i, words in split.items():
        if not held[i]:
            count.update(words)
            for c, w in contexts(words):
                follow[c][w] += 1
    seen = 0
    for batch in asked:
        for i, tokens, _, _ in LM._opened(batch):
            ids, marks = batch.column(batch.schema.get_field_index("doc_id"))[i].as_py(), np.array(batch.column(batch.schema.get_field_index("held"))[i].as_py())
            codes, counts, _ = LM._answered(batch, i, tokens, marks, 7)
            want, words = [], []
            for d in ids:
                own = not held[d]
                for c, w in contexts(split[d]):
                    f = follow[c]
                    want.append((f[w] - own, sum(f.values()) - own, sum(v > 0 for v in f.values()) - (own and f[w] == 1)))
                    words.append(count[w])
                    seen += 1
            m, n, k = np.array(want).T
            assert (codes == LM._codes(m, n, k)).all() and (counts == words).all()
    assert seen == sum(map(len, split.values()))


def test_op10_scores_word_order_and_known_passages(spark):
    rng = np.random.default_rng(2)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    passage = some(200)
    rows = [(i, " ".join(some(60))) for i in range(300) if i not in held] + [(4001, " ".join(passage)), (4002, "x " + " ".join(passage))]
    rows += [(held[0], " ".join(passage)), (held[1], " ".join(rng.permutation(passage)))]
    assert {4001, 4002} & {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    got = {r.doc_id: r for r in mixing_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(got[held[0]].base_score - got[held[1]].base_score) < 1e-6
    assert got[held[0]].score > got[held[1]].score + 150 and got[held[0]].score < 0
    assert abs(got[held[0]].bits_per_byte + got[held[0]].score * math.log2(10) / len(" ".join(passage))) < 1e-9


def test_op10_bits_add_up_to_one():
    m = LM.Mixer((16, 8), 4, 2)
    rng = np.random.default_rng(0)
    draw = lambda n: ([rng.integers(0, 16, n), rng.integers(0, 8, n)], rng.integers(0, 4, n), rng.integers(0, 2, n))
    for _ in range(50):
        slots, gate, place = draw(400)
        m.learn(slots, gate, place, (slots[0] < 5).astype(np.int64))
        m.count()
    slots, gate, place = draw(1000)
    one, zero = (m.log10(slots, gate, place, np.full(1000, b)) for b in (1, 0))
    assert np.allclose(10**one + 10**zero, 1) and (10**one)[slots[0] < 5].min() > 0.9 and (10**one)[slots[0] >= 5].max() < 0.1
    a, b = LM.Model(), LM.Model()
    a.byte.learnt[:], a.byte.weights[:] = 2, 0.5
    assert np.allclose(b.load(a.cells() * 3).byte.weights, 0.5)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100}


def test_pipeline(spark):
    import corpus_pipeline as P

    d = docs(spark)
    names = d.columns
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == names and out.count() <= d.count()
        d = spark.createDataFrame(out.toPandas(), out.schema)
    packed = {r[0] for r in P.STAGES[-1][1](spark, d, SF).select("doc_id").collect()}
    assert packed == {r[0] for r in d.select("doc_id").collect()}


def test_pipeline_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    texts = {r.doc_id: r.text for r in docs(spark).select("doc_id", "text").collect()}
    score = {r.doc_id: r.predicted for r in gam_quality(docs(spark), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    good = [texts[i] for i in sorted(score) if score[i] and len((texts[i] or "").split()) > 120]
    bad = next(texts[i] for i in sorted(score) if not score[i] and texts[i])
    schema = docs(spark).schema
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    shown = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())
    # Labels are those of other documents' ids: none of these rows teaches more than the table's own rows.
    few = [(None, good[0]), (None, bad), (10**7, good[1]), (10**7, bad)]
    scored = gam_quality(docs(spark).unionByName(frame(few)), spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1 and (doc_id is null or doc_id = 10000000)").count()
    got = P.quality(spark, docs(spark).unionByName(frame(few)), SF).where("doc_id is null or doc_id = 10000000")
    assert scored == 2 and shown(got) == [(False, 10**7, good[1]), (True, 0, good[0])]
    a, b, c = (" ".join(f"{p}{i}" for i in range(120)) for p in "abc")
    got = P.near_dedup(spark, frame([(None, a), (None, a), (1, a), (2, a), (2, b), (3, c), (3, c), (4, c)]), SF)
    assert shown(got) == [(False, 1, a), (False, 2, b), (False, 3, c), (True, 0, a), (True, 0, a)]
    got = P.substring_dedup(spark, frame([(1, a), (2, "x " + a), (2, b), (None, a)]), SF)
    assert shown(got) == [(False, 1, a), (False, 2, b), (False, 2, "x"), (True, 0, a)]
