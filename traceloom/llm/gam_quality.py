"""Operator 2: a quality classifier as a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T
from ._shared import read, tidy

#: Byte classes that are counted.
_KIND = np.full(256, 7, np.int64)  # other symbols
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, 9, 11, 12, 13]] = 3
_KIND[10] = 4
_KIND[128:] = 5
_KIND[[44, 46, 59, 58, 39, 34, 45, 40, 41]] = 6  # punctuation of prose
_KINDS = 8

FEATURES = ["log_bytes", "log_words", "lower", "upper", "digit", "space", "line_end", "high", "prose_marks", "symbols", "word_bytes", "distinct_words", "distinct_pairs", "distinct_fives", "same_as_previous", "one_byte_words", "marked_words", "all_upper_words", "capital_words", "long_words", "top_word", "distinct_lines", "line_words", "short_lines"]


def _per_document(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(keys: np.ndarray, doc: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of each document, and the count of the most frequent one."""
    if not len(keys):
        return np.zeros(m), np.zeros(m)
    mixed = np.sort(T.mix(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) | (doc.astype(np.uint64) << np.uint64(44)))
    head = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
    of = (mixed[head] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(m)
    np.maximum.at(most, of, np.diff(np.append(head, len(mixed))))
    return np.bincount(of, minlength=m).astype(float), most


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each of the documents laid end to end."""
    m, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    out = np.zeros((m, len(FEATURES)))
    doc = np.repeat(np.arange(m), np.diff(offsets))
    kinds = np.bincount(doc * _KINDS + _KIND[data], minlength=m * _KINDS).reshape(m, _KINDS)
    starts, ends, at = T.words(offsets, data)
    n = np.diff(at)
    words = np.maximum(n, 1)
    out[:, 0], out[:, 1] = np.log1p(np.diff(offsets)), np.log1p(n)
    out[:, 2:10] = kinds / size[:, None]
    of = np.repeat(np.arange(m), n)
    hashes, length = T.word_hashes(starts, ends, data), ends - starts
    out[:, 10] = _per_document(length, at) / words
    one, most = _distinct(hashes, of, m)
    out[:, 11], out[:, 20] = one / words, most / words
    for k, column in ((2, 12), (5, 13)):
        if len(hashes) >= k:
            keys, inside = T.Rolling(hashes).windows(k), of[k - 1 :] == of[: len(of) - k + 1]
            out[:, column] = _distinct(keys[inside], of[: len(keys)][inside], m)[0] / np.maximum(n - k + 1, 1)
    if len(hashes):
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        first, last = data[starts], data[ends - 1]
        upper = np.concatenate([[0], np.cumsum(_KIND[data] == 1)])
        lower = np.concatenate([[0], np.cumsum((_KIND[data] == 0) | (_KIND[data] == 5))])
        shout = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
        for column, what in ((14, same), (15, length == 1), (16, (_KIND[last] == 7) & (length > 1)), (17, shout), (18, _KIND[first] == 1), (19, length > 14)):
            out[:, column] = _per_document(what, at) / words
    # Lines: spans between line ends and document borders.
    breaks = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    breaks = breaks[breaks <= len(data)]
    if len(breaks) > 1:
        a, b = breaks[:-1], breaks[1:]
        line_of = doc[a]
        n_lines = np.bincount(line_of, minlength=m)
        in_line = np.searchsorted(starts, b) - np.searchsorted(starts, a)
        out[:, 21] = _distinct(T.Rolling(T.BYTE_VALUES[data]).spans(a, b), line_of, m)[0] / np.maximum(n_lines, 1)
        out[:, 22] = n / np.maximum(n_lines, 1)
        out[:, 23] = np.bincount(line_of, weights=in_line < 4, minlength=m) / np.maximum(n_lines, 1)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [features(offsets, data) for _, offsets, data in T.pieces(batch.column(1))]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        carried = [batch.column(i) for i in range(2, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(FEATURES))), *carried], ["doc_id", *FEATURES, *batch.schema.names[2:]])


def _steps(gradient: np.ndarray, weight: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """A shallow regression tree over ordered bins: the value of each bin's leaf."""
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + smooth)
    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best, place = 1e-12, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                t = np.arange(a + 1, b)
                gain = worth(a, t) + worth(t, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, place = gain[k], int(t[k])
        if place is None:
            break
        cuts = sorted([*cuts, place])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + smooth)
    return out


def _steps2(gradient: np.ndarray, weight: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """A tree of depth two over a pair of ordered bins: a cut of one feature, then one of the other on each side."""
    best, out = 0.0, np.zeros_like(gradient)
    for turn in (False, True):
        g, w = (gradient.T, weight.T) if turn else (gradient, weight)
        below, wbelow = np.cumsum(g, axis=0), np.cumsum(w, axis=0)
        gain = np.zeros(max(len(g) - 1, 0))
        for part, wpart in ((below[:-1], wbelow[:-1]), (below[-1] - below[:-1], wbelow[-1] - wbelow[:-1])):
            c, wc = np.cumsum(part, axis=1), np.cumsum(wpart, axis=1)
            split = c**2 / (wc + smooth) + (c[:, -1:] - c) ** 2 / (wc[:, -1:] - wc + smooth)
            gain += split.max(axis=1) if len(split) else 0
        if len(gain) and gain.max() > best:
            best, cut = gain.max(), int(gain.argmax()) + 1
            out = np.zeros_like(g)
            for a, b in ((0, cut), (cut, len(g))):
                out[a:b] = _steps(g[a:b].sum(0), w[a:b].sum(0), 2, smooth)
            out = out.T if turn else out
    return out, best


class Additive:
    """Lookup tables by feature bin and by pairs of coarse bins; a score is the sum of the tables' entries."""

    def __init__(self, bins: int = 48, coarse: int = 12, rounds: int = 120, pairs: int = 10, rate: float = 0.15, smooth: float = 4.0):
        self.bins, self.coarse, self.rounds, self.n_pairs, self.rate, self.smooth = bins, coarse, rounds, pairs, rate, smooth

    def _bin(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        cut = lambda n: [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
        self.edges, self.edges2 = cut(self.bins), cut(self.coarse)
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not 0 < y.sum() < len(y):
            return self
        b, b2 = self._bin(x, self.edges), self._bin(x, self.edges2)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for k, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-score))
                step = self.rate * _steps(np.bincount(b[:, k], y - p, len(t)), np.bincount(b[:, k], p * (1 - p), len(t)), 3, self.smooth)
                t += step
                score += step[b[:, k]]
        p = 1 / (1 + np.exp(-score))
        width = [len(e) + 1 for e in self.edges2]
        at = lambda i, j: b2[:, i] * width[j] + b2[:, j]
        worth = lambda i, j, p: _steps2(np.bincount(at(i, j), y - p, width[i] * width[j]).reshape(width[i], -1), np.bincount(at(i, j), p * (1 - p), width[i] * width[j]).reshape(width[i], -1), self.smooth)
        gains = sorted(((worth(i, j, p)[1], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
        self.pairs = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in gains[: self.n_pairs]]
        for _ in range(self.rounds // 2):
            for i, j, t in self.pairs:
                step = self.rate * worth(i, j, 1 / (1 + np.exp(-score)))[0]
                t += step
                score += step[b2[:, i], b2[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b, b2 = self._bin(x, self.edges), self._bin(x, self.edges2)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for i, j, t in self.pairs:
            total += t[b2[:, i], b2[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _score(model: Additive, first: int):
    """Features and score of each text in one pass; the columns from `first` on come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(features(offsets, data)) for _, offsets, data in T.pieces(batch.column(1))]
            score = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), score, *batch.columns[first:]], ["doc_id", "score", *batch.schema.names[first:]])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, quality of about `most` labelled documents that aren't held out, those of least hash: the hash's
    threshold follows from the number of labels, so no task gathers more. An id that has both labels
    is left out; one that stands for several texts teaches by the one of least hash."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality")
    share = min(1.0, most / max(marks.count(), 1))
    marks = marks.where((F.xxhash64(F.lit(3), "doc_id") / 2.0**64 + 0.5) < share)
    texts = docs.join(F.broadcast(marks), "doc_id").withColumn("least", F.min(F.xxhash64("text")).over(Window.partitionBy("doc_id")))
    return texts.where(F.xxhash64("text") == F.col("least")).dropDuplicates(["doc_id"]).select("doc_id", "text", "quality")


def gam_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = 40_000, carry: dict[str, Column] | None = None, keep_text: bool = False) -> DataFrame:
    """Score every text of docs (doc_id long, text string); labels: doc_id long, quality 0/1.

    The model is fitted on about `most` labelled rows (those of least hash) whose crc32(doc_id) mod 4 isn't
    2; its inputs are counts over the whole text alone. Returns doc_id, held_out, score (0 to 1), predicted
    (score >= threshold). Null text: empty. Rows whose quality is null or not 0 or 1 teach nothing, nor do ids with both
    labels; without labels of both kinds every score is their smoothed share. Null doc_id: scored, not held out. Repeated
    rows are scored each; where ids repeat with different texts, one text teaches. An empty table gives an empty result. A
    very long text is worked in one numpy pass of its task. The columns `carry` (by name in the result) and, with
    keep_text, the text come back too, other columns are ignored.
    """
    carry = carry or {}
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("text"))
    sample = _sample(plain, labels, most).mapInArrow(_features, ", ".join(["doc_id long", *(f"{f} double" for f in FEATURES), "quality int"])).toPandas().sort_values("doc_id")
    model = Additive().fit(sample[FEATURES].to_numpy(float), sample["quality"].to_numpy(float))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"), *(c.alias(f"carried_{k}") for k, c in enumerate(carry.values())))
    first = 1 if keep_text else 2
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[first:]]
    scored = rows.mapInArrow(tidy(_score(model, first)), ", ".join(["doc_id long, score double", *kinds]))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["text"][: keep_text], *(F.col(f"carried_{k}").alias(name) for k, name in enumerate(carry)))


def op2_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
