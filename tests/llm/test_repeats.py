"""Substring removal against brute force where one passage stands in very many surroundings."""

import collections
import hashlib

import numpy as np
import pytest

from traceloom.llm._repeats import repeated_spans
from traceloom.llm.lpf_dedup import lpf_dedup
from traceloom.llm.lpf_dedup import match as lpf_match
from traceloom.llm.suffix_tree_dedup import match as tree_match
from traceloom.llm.suffix_tree_dedup import suffix_tree_dedup


def words_left(texts: dict[int, str], window: int) -> dict[int, tuple]:
    first: dict[tuple, int] = {}
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
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def bytes_left(texts: dict[int, str], window: int) -> dict[int, tuple]:
    count = collections.Counter()
    raw = {i: t.encode() for i, t in texts.items()}
    for t in raw.values():
        count.update(t[j : j + window] for j in range(len(t) - window + 1))
    out = {}
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - window + 1):
            if count[t[j : j + window]] > 1:
                gone[j : j + window] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.fixture(scope="module")
def crowded():
    """A passage in 2,000 surroundings, some of them shared in part, and copies."""
    rng = np.random.default_rng(4)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    passage, tail = some(130), some(20)
    texts = {}
    for i in range(2000):
        before = some(int(rng.integers(0, 40)))
        after = tail + " " + some(30) if i % 7 == 0 else some(int(rng.integers(0, 60)))
        texts[i] = f"{before} {passage} {after}".strip()
    for i in range(40):
        texts[3000 + i] = texts[i]
    return texts


def test_op7_passage_in_many_surroundings(spark, crowded):
    d = spark.createDataFrame(list(crowded.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_tree_dedup(d).collect()}
    assert got == words_left(crowded, 50)


def test_op8_passage_in_many_surroundings(spark, crowded):
    d = spark.createDataFrame(list(crowded.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in lpf_dedup(d).collect()}
    assert got == bytes_left(crowded, 400)


def test_op8_passages_of_over_fifty_words_go_from_400_bytes_on(spark):
    """Passages planted in two documents each, with other bytes right before and after them."""
    rng = np.random.default_rng(8)
    texts, planted = {}, {}
    for k, (size, letter) in enumerate([(300, "a"), (399, "a"), (400, "a"), (401, "a"), (399, "é"), (400, "é")]):
        passage = " ".join(f"{letter}{x}" for x in rng.integers(10, 99, 52))
        passage += "z" * (size - len(passage.encode()))
        for j in range(2):
            texts[10 * k + j] = "".join(f" b{x}" for x in rng.integers(0, 10**9, 30)) + "<>"[j] + passage + "[]"[j] + "".join(f" c{x}" for x in rng.integers(0, 10**9, 30))
            planted[10 * k + j] = size if size >= 400 else 0
    texts[99], planted[99] = "".join(f" d{x}" for x in rng.integers(0, 10**9, 60)), 0
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in lpf_dedup(d).collect()}
    assert got == bytes_left(texts, 400)
    assert {i: x[1] for i, x in got.items()} == planted


@pytest.mark.parametrize("unit", ["word", "byte"])
def test_deep_levels_find_what_the_first_finds(spark, crowded, unit):
    """With room for hardly a segment in a group, all is found in the cells' last levels."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, crowded[i]) for i in range(150)], "doc long, text string").withColumn("tag", F.lit(0).cast("long"))
    word = unit == "word"
    args = (d, unit, 50 if word else 400, 10 if word else 64, tree_match(50) if word else lpf_match(400, False), lambda doc, pos, first, place: doc > first if word else F.lit(True))

    def covered(spans):
        return {r.doc: sorted({x for a, b in r.spans for x in range(a, b)}) for r in spans.collect()}

    assert covered(repeated_spans(*args, core_bytes=1500)) == covered(repeated_spans(*args)) != {}
