"""Packing, near duplicates and the pipeline's stages against brute force, and cases that every operator must stand."""

import collections
import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from traceloom.llm.dp_bpe import bpe_round_trip, byte_vocabulary
from traceloom.llm.gam_quality import gam_quality
from traceloom.llm.kmeans_tree import kmeans_tree_search
from traceloom.llm.lpf_dedup import lpf_dedup
from traceloom.llm.mixing_lm import mixing_scores
from traceloom.llm.order_minhash import near_duplicates
from traceloom.llm.pattern_packing import pack_documents, word_vocabulary
from traceloom.llm.rp_forest import rp_forest_duplicates
from traceloom.llm.stratified_shards import stratified_shards
from traceloom.llm.suffix_tree_dedup import suffix_tree_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def pieces(text, tokenizer):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    return [(k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_op3_pieces_are_those_of_the_library(spark, texts):
    t = tokenizer()
    odd = {1001: None, 1002: "", 1003: "A B, c. 'S don't 42 x1 <|endoftext|> Äü z\n\n", 1004: "word " * 9000, 1005: "Q." * 3000, 1006: "é   ﬁ"}
    every = texts | odd
    got = collections.defaultdict(list)
    d = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(3)
    for r in pack_documents(d, word_vocabulary()).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {i: sorted(p) for i, p in got.items()} == {i: pieces(x, t) for i, x in every.items()}


def labelled(text, k=5):
    w = text.encode().split()
    grams = [tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))]
    seen = collections.Counter()
    out = []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def alike(x, y, least=0.8):
    """Shingles in one order over all shingles, by the longest ascending chain of common ones."""
    at = {g: j for j, g in enumerate(y)}
    chain = []
    for g in x:
        if g in at:
            v = at[g]
            p = bisect_left(chain, v)
            chain[p : p + 1] = [v]
    n = len(x) + len(y) - len(chain)
    return len(chain) >= least * n - 1e-9 if n else False


def classes(texts):
    """Smallest id of each document's class, by all pairs."""
    ids = sorted(i for i in texts if texts[i] is not None)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    first = {}
    for i in ids:
        j = first.setdefault(texts[i], i)
        up[max(root(i), root(j))] = min(root(i), root(j))
    grams = {t: labelled(t) for t in first}
    keys = sorted(first.values())
    for a, i in enumerate(keys):
        x = grams[texts[i]]
        own = set(x)
        for j in keys[a + 1 :]:
            y = grams[texts[j]]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(y) and len(own.intersection(y)) >= 0.8 * max(len(x), len(y)) * 0.99 - 1 and alike(x, y):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def copies(texts):
    """The table's documents with near copies of some at several distances, and a group of many."""
    rng = np.random.default_rng(9)
    out = {i: t for i, t in texts.items() if t}
    long = [t for t in out.values() if 150 < len(t.split()) < 900][:25]
    for n, t in enumerate(long):
        for c, share in enumerate((0.003, 0.01, 0.015, 0.06)):
            w = t.split()
            for p in rng.integers(0, len(w), max(1, int(share * len(w)))):
                w[p] = f"x{rng.integers(10**6)}"
            out[10_000 + 10 * n + c] = " ".join(w)
    w = [f"h{x}" for x in rng.integers(0, 10**6, 300)]
    for n in range(120):
        v = list(w)
        v[int(rng.integers(300))] = f"n{n}"
        out[20_000 + n] = " ".join(v)
    return out


def test_op5_classes_are_those_of_all_pairs(spark, copies):
    d = spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(d).collect()}
    want = classes(copies)
    assert len({want[i] for i in range(20_000, 20_120)}) == 1 and sum(want[i] != i for i in want) > 170
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, len(wrong)


def words_left(texts, window=50):
    first = {}
    for i in sorted(texts):
        w = texts[i].split()
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, t in texts.items():
        w = t.split()
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = True
        out[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if gone.any() else t
    return out


def test_pipeline_stages_against_brute_force(spark, copies):
    import corpus_pipeline as P

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in copies.items()], schema)
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    scores = {r.doc_id: r.score for r in gam_quality(frame, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    good = read(P.quality(spark, frame, SF))
    assert good == {i: t for i, t in copies.items() if scores[i] >= 0.7} and 0 < len(good) < len(copies)
    kept = read(P.near_dedup(spark, frame, SF))
    one = classes(copies)
    assert kept == {i: t for i, t in copies.items() if one[i] == i}
    rest = P.substring_dedup(spark, frame, SF)
    want = words_left(copies)
    assert read(rest) == want and {r.doc_id: r.n_chars for r in rest.collect()} == {i: len(t) for i, t in want.items()}
    packed = P.packing(spark, frame, SF).toPandas().sort_values(["doc_id", "piece"])
    t = tokenizer()
    expected = [(i, *p) for i in sorted(copies) for p in pieces(copies[i], t)]
    assert list(zip(*(packed[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), strict=True)) == expected
    used = packed.groupby("sequence_id")["length"].sum()
    least = max(packed["length"].sum() / 4096, (packed["length"] > 2048).sum())  # no two of over half a sequence share one
    assert used.max() <= 4096 and len(used) <= 1.02 * least + 1


def test_pipeline_runs_on_nulls_and_empty_tables(spark):
    import corpus_pipeline as P

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, 0), (2, "", None, None, 0)]):
        d = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, d, SF)
            assert out.columns == d.columns and out.count() <= len(rows)
        assert P.packing(spark, d, SF).count() == len(rows)
    assert sorted((r.doc_id or 0, r.text) for r in P.near_dedup(spark, d, SF).select("doc_id", F.coalesce("text", F.lit("none")).alias("text")).collect()) == [(0, "none"), (1, "none"), (2, "")]


CLASHES = ["n", "key", "rank", "length", "held_out", "score", "doc", "tag", "block", "slice", "copies", "row", "component_id"]


def operators(spark, d):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    yield "op2", gam_quality(d, labels)
    yield "op3", pack_documents(d, word_vocabulary())
    yield "op4", stratified_shards(d)
    yield "op5", near_duplicates(d)
    yield "op7", suffix_tree_dedup(d)
    yield "op8", lpf_dedup(d)
    yield "op9", bpe_round_trip(d, byte_vocabulary(), keep=False)
    yield "op10", mixing_scores(d)


def test_clashing_columns_null_ids_and_repeats(spark):
    """Columns named as those that operators use, rows without id, one id with two texts, equal rows."""
    passage = " ".join(f"w{i}" for i in range(120))
    rows = [(1, passage), (1, passage), (2, "a " + passage), (2, "another text"), (None, passage), (None, None), (3, None), (4, "")]
    d = spark.createDataFrame([(i, t, *range(len(CLASHES)), "s") for i, t in rows], ", ".join(["doc_id long, text string", *(f"{c} int" for c in CLASHES), "source string"]))
    plain = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    shown = lambda df: sorted(map(str, df.collect()))
    for (name, got), (_, want) in zip(operators(spark, d), operators(spark, plain), strict=True):
        if name == "op4":  # null and repeated ids: counts alone
            assert got.count() == want.count() == len(rows)
            continue
        got, want = shown(got), shown(want)
        assert got == want, name
        assert len(got) == {"op5": 6}.get(name, len(rows)), name
    cut = sorted((r.n_words, r.n_removed) for r in suffix_tree_dedup(plain).where("doc_id = 2").collect())
    assert cut == [(2, 0), (121, 120)]


def test_a_very_long_text(spark):
    """Ten megabytes in one row, half of which is its other half again."""
    rng = np.random.default_rng(1)
    half = " ".join(f"w{x}" for x in rng.integers(0, 200_000, 700_000))
    text = f"{half} {half}"
    d = spark.createDataFrame([(1, text), (2, "short text"), (3, half[:5000])], "doc_id long, text string")
    got = {r.doc_id: r for r in lpf_dedup(d).drop("kept").collect()}
    assert got[1].n_bytes == len(text) > 9_000_000 and got[1].n_removed == len(text) - 1 and got[3].n_removed == 5000
    got = {r.doc_id: (r.n_words, r.n_removed) for r in suffix_tree_dedup(d).drop("rest").collect()}
    assert got[1] == (1_400_000, 0) and got[2] == (2, 0) and got[3][1] >= got[3][0] - 1
    sha = {r.doc_id: r.decoded_sha256 for r in bpe_round_trip(d, byte_vocabulary(), keep=False).collect()}
    assert sha[1] == hashlib.sha256(text.encode()).hexdigest()
    assert pack_documents(d, word_vocabulary()).where("doc_id = 1").agg(F.sum("length")).first()[0] > 1_400_000
    scored = {r.doc_id: r for r in mixing_scores(d).collect()}
    assert scored[1].n_tokens == 1_400_001 and scored[1].score < 0
    assert near_duplicates(d).count() == 3 and gam_quality(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 3


def test_vectors_with_clashing_columns_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.0, 1.0])]
    v = spark.createDataFrame([(*r, *range(5)) for r in rows], "vec_id long, embedding array<double>, rank int, leaf int, bucket int, v int, n_links int")
    got = [(r["rank"], r.vec_id) for r in kmeans_tree_search(v, F.col("vec_id") == 5).orderBy("rank").collect()]
    assert got == list(enumerate([i for i in range(30) if i != 5][:20], 1))
    links = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest_duplicates(v).collect()}
    assert links == {i: (29, 0) for i in range(30)} | {100: (0, 100)}


def test_op3_ids_of_odd_words():
    """Words that go through the model alone have the library's ids, and so have those that can't."""
    import random

    from traceloom.llm.pattern_packing import token_ids

    t, rng = tokenizer(), random.Random(2)
    signs = list("abzAZéÉüßñçœŒæøåİıſKǺ̈ﬁΩω日本語аБ") + [" ", ",", ".", "'s", "1", "!", "<|endoftext|>", " ", "　", "ª", "º", "ⅷ", "Ⅷ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 14))) for _ in range(5000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_ids([x.encode() for x in texts], word_vocabulary())]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_op3_ids_of_letters_with_marks():
    """Each letter that has a lower case or composes, before each combining mark, alone and inside a word; and all
    single characters that aren't above the basic plane."""
    import unicodedata

    from traceloom.llm.pattern_packing import token_ids

    t = tokenizer()
    marks = [chr(c) for c in range(0x300, 0x370)] + list("゙゚्֑")
    letters = [chr(c) for c in [*range(0x41, 0x250), *range(0x386, 0x3D0), *range(0x400, 0x482), *range(0x1E00, 0x1F00)] if chr(c).isalpha()]
    texts = [" ".join(f"{a}{m} x{a}{m}y" for m in marks) for a in letters]
    texts += [" ".join(f"{chr(c)} a{chr(c)}b A{chr(c)}." for c in range(n, n + 256) if not 0xD800 <= c < 0xE000) for n in range(0, 1 << 16, 256)]
    assert any(unicodedata.normalize("NFC", x) != x for x in texts)
    got = [np.frombuffer(x, "<u4").tolist() for x in token_ids([x.encode() for x in texts], word_vocabulary())]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    bad = [x for x, g, w in zip(texts, got, want, strict=True) if g != w]
    assert not bad, [x[:80] for x in bad[:3]]


def test_op3_ids_of_documents(texts):
    from traceloom.llm.pattern_packing import token_ids

    all_ = [x or "" for x in texts.values()]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_ids([x.encode() for x in all_], word_vocabulary())]
    assert got == [e.ids for e in tokenizer().encode_batch(all_, add_special_tokens=False)]


def test_pipeline_stages_keep_columns_of_any_name(spark, copies):
    """Each stage gives the same rows with and without columns named as those it works with, and these keep their values."""
    import corpus_pipeline as P

    names = [*CLASHES, "kept_id", "kept_hash", "kept", "text_hash", "own_text", "own_n_chars", "rest", "n_removed", "predicted", "id", "hash"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", len(t)) for i, t in copies.items()]
    plain = spark.createDataFrame(rows, schema)
    wide = spark.createDataFrame([(*r, *(f"{r[0]}:{c}" for c in names)) for r in rows], ", ".join([schema, *(f"{c} string" for c in names)]))
    shown = lambda df: sorted(map(str, df.select("doc_id", "text", "n_chars").collect()))
    for name, stage in P.STAGES[:-1]:
        want, got = stage(spark, plain, SF), stage(spark, wide, SF)
        assert got.columns == wide.columns and shown(got) == shown(want) and got.count() > 0, name
        assert all(r[c] == f"{r.doc_id}:{c}" for r in got.collect() for c in names), name
