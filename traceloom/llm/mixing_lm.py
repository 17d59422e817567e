"""Operator 10: language-model scoring by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._shared import buckets, read, table, tidy

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = 32
_K = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
#: Texts of about so many bytes are worked together.
BLOCK_BYTES = 1 << 20
MISS = 255
#: Bits of a token beside its context's.
_TOKEN = 31
#: Share codes count sixteenths of a bit.
_FINE = 16


# --- tokens and what they ask ---------------------------------------------------------------------------


class Tokens:
    """The tokens of a block of texts: words with A-Z in lower case, then an empty one at the end of each text.

    h: 64-bit hashes; s, e: bytes; doc and place of each; begin: where each text's tokens start. A token's
    context is the two words before it; each of them of up to three bytes takes in one word more."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.data = data = _LOWER[data]
        starts, ends, at = T.words(offsets, data)
        m = len(offsets) - 1
        n = len(starts) + m
        place = np.arange(len(starts)) + np.repeat(np.arange(m), np.diff(at))
        stop = at[1:] + np.arange(m)
        self.s, self.e, self.h = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, _U)
        self.s[place], self.e[place], self.h[place] = starts, ends, T.word_hashes(starts, ends, data)
        self.s[stop] = self.e[stop] = offsets[1:]
        self.begin = at + np.arange(m + 1)
        self.doc = np.repeat(np.arange(m), np.diff(self.begin))
        self.place = np.arange(n) - self.begin[:-1][self.doc]
        self.before = [np.where(self.place >= k, np.roll(self.h, k), _U(k)) for k in range(1, 5)]
        size = self.e - self.s
        short = sum((((np.roll(size, k) <= 3) & (self.place >= k)).astype(np.int64) for k in (1, 2)), np.zeros(n, np.int64))
        context = T.mix(self.before[0] * _K + T.mix(self.before[1] * _K + _U(1)))
        for k in (1, 2):
            context = np.where(short >= k, T.mix(context + T.mix(self.before[k + 1] * _K + _U(k + 1))), context)
        self.context = context
        #: Which token follows which context, in 63 bits: 32 of the context beside those that pick its slice, 31 of the token.
        self.pair = (context & _U(0xFFFFFFFF)) << _U(_TOKEN) | T.mix(self.h + _K) >> _U(64 - _TOKEN)


class Asked:
    """Different 63-bit keys of a block's tokens in the order of their slices, those that are `apart` for themselves, and how
    often each stands in training texts."""

    def __init__(self, keys: np.ndarray, of: np.ndarray, apart: np.ndarray, held: np.ndarray, slices: int):
        different, first, back = np.unique(keys << _U(1) | apart, return_index=True, return_inverse=True)
        part = ((of[first] >> _U(40)) % _U(slices)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.back, self.part = rank[back], part[order]
        self.bytes = (different[order] >> _U(1)).astype("<u8").view(np.uint8).reshape(-1, 8)
        self.count = np.bincount(self.back, ~held, len(order)).astype(np.int64)
        self.ends = np.searchsorted(self.part, np.arange(slices + 1))

    def blobs(self, k: int) -> tuple[bytes, bytes]:
        """Keys and counts of a slice."""
        a, b = self.ends[k], self.ends[k + 1]
        return self.bytes[a:b].tobytes(), packed(self.count[a:b])


def packed(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as all of them fit into."""
    return x.astype(np.uint8 if not len(x) or x.max() < 1 << 8 else np.uint32 if x.max() < 1 << 32 else np.uint64).tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, {0: np.uint8, 1: np.uint8, 4: np.uint32, 8: np.uint64}[len(blob) // max(n, 1)]).astype(np.int64)


def _questions(tokens: Tokens, held: np.ndarray, slices: int) -> tuple[Asked, Asked]:
    out = held[tokens.doc]
    words = T.mix(tokens.h + _U(5))
    return Asked(tokens.pair, tokens.context, out, out, slices), Asked(words & _U((1 << 63) - 1), words, np.zeros_like(out), out, slices)


def _bucket(n: np.ndarray, steps: float, most: int = 15) -> np.ndarray:
    """0 for none, then up to `most` by the logarithm."""
    return np.where(n > 0, np.minimum(most, 1 + np.floor(steps * np.log2(np.maximum(n, 1)))), 0).astype(np.uint16)


def _codes(m: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A token followed its context m of n times, with k different tokens in all: its share, rounded down (high byte; MISS:
    none), and buckets of n and k."""
    share = np.ceil(-np.log2(np.maximum(m, 1) / np.maximum(n, 1)) * _FINE)
    return np.where((m > 0) & (share < MISS), share, MISS).astype(np.uint16) << np.uint16(8) | _bucket(n, 2) << np.uint16(4) | _bucket(k, 1)


_BLOCK = "block long, size long, doc_id array<long>, held array<boolean>, offsets binary, data binary"
_QUESTION = "slice int, block long, pairs binary, pair_counts binary, words binary, word_counts binary"
_ANSWER = "slice int, block long, pairs binary, words binary, total long, kinds long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for first, offsets, data in T.pieces(batch.column(1), BLOCK_BYTES):
            m = len(offsets) - 1
            ids, held = batch.column(0).slice(first, m), batch.column(2).slice(first, m)
            one = pa.array([0, m], pa.int32())
            cols = [pa.array([number]), pa.array([len(data)]), *(pa.ListArray.from_arrays(one, pa.concat_arrays([c])) for c in (ids, held)), pa.array([offsets.tobytes()], pa.binary()), pa.array([pa.Codec("zstd", compression_level=3).compress(data.tobytes(), asbytes=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "size", "doc_id", "held", "offsets", "data"])
            number += 1


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Tokens, np.ndarray, np.ndarray]]:
    """Each block's number in the batch, tokens, marks of held-out texts and sizes of texts."""
    for i in range(batch.num_rows):
        get = lambda c, i=i: batch.column(batch.schema.get_field_index(c))[i]
        offsets, data = np.frombuffer(get("offsets").as_py(), np.int64), get("data").as_py()
        data = np.frombuffer(pa.decompress(data, int(offsets[-1]), "zstd", asbytes=True), np.uint8)
        yield i, Tokens(offsets, data), np.array(get("held").as_py(), bool), np.diff(offsets)


def _ask(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("block")).to_pylist()
            for i, tokens, held, _ in _opened(batch):
                pairs, words = _questions(tokens, held, slices)
                some = np.union1d(pairs.part, words.part)
                rows = [(int(k), blocks[i], *pairs.blobs(k), *words.blobs(k)) for k in some]
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["slice", "block", "pairs", "pair_counts", "words", "word_counts"])

    return run


def _summed(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Different keys with training counts, where each given key is among them, whether it came from a training text, and
    the ends of the given blobs."""
    ends = np.cumsum([0, *(len(k) // 8 for k in keys)])
    different, back = np.unique(np.frombuffer(b"".join(keys), "<u8"), return_inverse=True)
    given = np.concatenate([np.zeros(0, np.int64), *(unpacked(c, len(k) // 8) for k, c in zip(keys, counts, strict=True))])
    return different, np.bincount(back, given, len(different)).astype(np.int64), back, given > 0, ends


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts of one slice: for each pair its code (of training texts: with one occurrence, the token's own, left out),
    for each word its count."""
    different, m, back, train, ends = _summed(frame["pairs"].tolist(), frame["pair_counts"].tolist())
    context = different >> _U(_TOKEN)
    head = np.ones(len(context), bool)
    head[1:] = context[1:] != context[:-1]
    of = np.cumsum(head) - 1
    n, k = np.bincount(of, m)[of].astype(np.int64), np.bincount(of, m > 0)[of].astype(np.int64)
    codes = np.where(train, _codes(m - 1, n - 1, k - (m == 1))[back], _codes(m, n, k)[back])
    words, count, word_back, _, word_ends = _summed(frame["words"].tolist(), frame["word_counts"].tolist())
    cut = lambda a, ends, form: [form(a[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
    out = pd.DataFrame({"slice": frame["slice"], "block": frame["block"], "pairs": cut(codes, ends, np.ndarray.tobytes), "words": cut(count[word_back], word_ends, packed), "total": 0, "kinds": 0})
    out.loc[out.index[:1], ["total", "kinds"]] = [int(count.sum()), int((count > 0).sum())]
    return out


# --- the bit predictors ---------------------------------------------------------------------------------


class Mixer:
    """Binary events predicted from several hashed contexts. tables: counts of zeros and ones of each context's slots.
    weights: by gate and context. refined: what the bit was in fact, by a place and the mixed score."""

    BINS, RATE, FINE = 33, 0.02, 16

    def __init__(self, sizes: tuple[int, ...], gates: int, places: int):
        self.tables = [np.zeros((n, 2), np.float32) for n in sizes]
        self.weights = np.full((gates, len(sizes) + 1), 1.2 / len(sizes))
        self.weights[:, -1] = 0
        self.moment = np.full(self.weights.shape, 1e-2)
        self.refined = np.zeros((places, self.BINS, 2), np.float32)
        self.learnt = np.zeros(gates)
        self.waiting: list[list[np.ndarray]] = [[] for _ in sizes]
        self.ready: tuple | None = None

    def learn(self, slots: list[np.ndarray], gate: np.ndarray, place: np.ndarray, bit: np.ndarray) -> None:
        """One online step: predict by what was counted before, move the weights, and keep the bits to be counted."""
        if not len(bit):
            return
        x = np.full((len(slots) + 1, len(bit)), 0.3)
        for k, (t, s) in enumerate(zip(self.tables, slots, strict=True)):
            x[k] = _stretch(t[:, 0].take(s), t[:, 1].take(s))
            self.waiting[k].append(s * 2 + bit)
        score = np.clip(sum(x[k] * self.weights[:, k].take(gate) for k in range(len(x))), -11.9, 11.9)
        miss = bit - 1 / (1 + np.exp(-score))
        held = np.bincount(gate, minlength=len(self.learnt))
        self.learnt += held
        some = held > 0
        for k in range(len(x)):
            g = np.bincount(gate, miss * x[k], len(held))[some] / held[some]
            self.moment[some, k] += 0.1 * (g * g - self.moment[some, k])
            self.weights[some, k] += self.RATE * g / (np.sqrt(self.moment[some, k]) + 1e-2)
        bins = np.round((score + 12) / 24 * (self.BINS - 1)).astype(np.int64)
        self.refined += np.bincount((place * self.BINS + bins) * 2 + bit, minlength=self.refined.size).reshape(self.refined.shape)

    def count(self) -> None:
        """Count the bits of the steps since the last call."""
        for t, w in zip(self.tables, self.waiting, strict=True):
            if w:
                t += np.bincount(np.concatenate(w), minlength=t.size).reshape(t.shape)
                w.clear()

    def _frozen(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, int]:
        """Stretched tables, weights, and log10 of both bits by place and mixed score, finer than the refined bins."""
        score = np.linspace(-12, 12, (self.BINS - 1) * self.FINE + 1)
        near = np.round(np.arange(len(score)) / self.FINE).astype(int)
        prior, n = 1 / (1 + np.exp(-score)), self.refined[:, near].astype(float)
        one = np.clip(0.5 * prior + 0.5 * (n[:, :, 1] + 20 * prior) / (n.sum(axis=2) + 20), 1e-5, 1 - 1e-5)
        cost = np.log10(np.stack([1 - one, one], axis=2)).astype(np.float32).ravel()
        return [_stretch(t[:, 0], t[:, 1]) for t in self.tables], list(np.ascontiguousarray(self.weights.T.astype(np.float32))), cost, len(score)

    def log10(self, slots: list[np.ndarray], gate: np.ndarray, place: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 of the probability of each bit, refined."""
        if self.ready is None:
            self.ready = self._frozen()
        tables, weights, cost, width = self.ready
        score = np.float32(0.3) * weights[-1].take(gate)
        for w, t, s in zip(weights, tables, slots, strict=False):
            score += w.take(gate) * t.take(s)
        at = ((np.clip(score, -11.9, 11.9) + 12) * np.float32((width - 1) / 24) + np.float32(0.5)).astype(np.int64)
        return cost.take((place * width + at) * 2 + bit)


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.3)) / (n0 + np.float32(0.3)))


class Model:
    """Three mixers: whether a token is among those that followed its context, whether it is a known word, and the
    bits of the bytes of one that isn't."""

    def __init__(self):
        self.follows = Mixer((256, 256, 512, 1 << 16), 128, 16)
        self.known = Mixer((256, 1 << 16, 64), 32, 1)
        self.byte = Mixer((1 << 15, 1 << 17, 1 << 18, 1 << 18), 64, 256)

    def _arrays(self) -> list[np.ndarray]:
        return [a for m in (self.follows, self.known, self.byte) for a in (*m.tables, m.refined, m.learnt, m.weights)]

    def cells(self) -> np.ndarray:
        """All that was learnt, so that models of several partitions can be added; weights count by what they learnt from."""
        return np.concatenate([(a * b[:, None] if a.ndim == 2 and a.shape[0] == len(b) and b.ndim == 1 else a).ravel().astype(np.float32) for b, a in zip([np.zeros(0), *self._arrays()][:-1], self._arrays(), strict=True)])

    def load(self, cells: np.ndarray) -> Model:
        at = 0
        for m in (self.follows, self.known, self.byte):
            for a in (*m.tables, m.refined, m.learnt):
                a[...] = cells[at : at + a.size].reshape(a.shape)
                at += a.size
            got = cells[at : at + m.weights.size].reshape(m.weights.shape)
            at += m.weights.size
            m.weights = np.where(m.learnt[:, None] > 0, got / np.maximum(m.learnt, 1)[:, None], m.weights)
        return self

    def run(self, tokens: Tokens, codes: np.ndarray, known: np.ndarray, some: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """For the tokens `some` (whole texts): log10 of what was coded beside the shares, and which follow their context.
        codes: of each token; known: whether it is a word known without itself."""
        i = np.flatnonzero(some)
        code = codes[i].astype(np.int64)
        hit, n, k = code >> 8 < MISS, code >> 4 & 15, code & 15
        # How many tokens before it followed their contexts without a break, and which of the last four did.
        place, order = tokens.place[i], np.arange(len(i))
        broken = np.maximum.accumulate(np.where(hit, -1, order))
        broken = np.concatenate([[-1], broken[:-1]])
        run = np.minimum(np.minimum(order - 1 - broken, place), 15)
        flags = sum((np.where(place >= j, np.roll(hit, j), False).astype(np.int64) << (j - 1) for j in range(1, 5)), np.zeros(len(i), np.int64))
        last = (tokens.before[0][i] * _K >> _U(48)).astype(np.int64)
        out = np.zeros(len(i))

        a = np.flatnonzero(n > 0)
        events = [n[a] * 16 + k[a], run[a] * 16 + n[a], (flags[a] * 16 + n[a]) * 2 + (k[a] > 1), last[a]], np.minimum(run[a], 7) * 16 + n[a], n[a], hit[a].astype(np.int64)
        if learn:
            self.follows.learn(*events)
        else:
            out[a] += self.follows.log10(*events)

        b = np.flatnonzero(~hit)
        word = known[i[b]].astype(np.int64)
        events = [flags[b] * 16 + n[b], last[b], np.minimum(place[b], 63)], n[b] + 16 * (place[b] == 0), np.zeros(len(b), np.int64), word
        if learn:
            self.known.learn(*events)
        else:
            out[b] += self.known.log10(*events)

        new = i[b[word == 0]]
        where = b[word == 0]
        for row, slots, gate, node, bit in spelled(tokens.data, tokens.s[new], tokens.e[new]):
            if learn:
                self.byte.learn(slots, gate, node, bit)
            else:
                out += np.bincount(where[row], self.byte.log10(slots, gate, node, bit), len(i))
        for m in (self.follows, self.known, self.byte) if learn else ():
            m.count()
        return out, hit


def spelled(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[tuple]:
    """The bits of words' bytes, each word closed by a blank, one bit of all bytes at a time: word, slots of the contexts
    (the last one, two, three and five bytes), gate, node and bit."""
    size = e - s + 1
    row = np.repeat(np.arange(len(s)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    symbol = np.full(len(row), SPACE, np.int64)
    inside = at < size[row] - 1
    symbol[inside] = data[s[row[inside]] + at[inside]]
    back = [np.where(at >= k, np.roll(symbol, k), 0).astype(_U) for k in range(1, 6)]
    joined = lambda n: sum((back[k] << _U(8 * k) for k in range(n)), np.full(len(row), n, _U) << _U(48))
    contexts = [T.mix(joined(n) * _K) for n in (1, 2, 3, 5)]
    gate = np.minimum(at, 7) * 8
    for d in range(8):
        node, bit = 1 << d | symbol >> (8 - d), symbol >> (7 - d) & 1
        salt = node.astype(_U) * _U(0xD6E8FEB86659FD93)
        slots = [((c ^ salt) * _K >> _U(64 - b)).astype(np.int64) for c, b in zip(contexts, (15, 17, 18, 18), strict=True)]
        yield row, slots, gate + d, node, bit


def _answered(batch: pa.RecordBatch, i: int, tokens: Tokens, held: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's code, count in training texts, and whether it stands in one."""
    pairs, words = _questions(tokens, held, slices)
    codes, counts = np.zeros(len(pairs.bytes), np.uint16), np.zeros(len(words.bytes), np.int64)
    for a in batch.column(batch.schema.get_field_index("answers"))[i].as_py():
        k = a["slice"]
        codes[pairs.ends[k] : pairs.ends[k + 1]] = np.frombuffer(a["pairs"], np.uint16)
        counts[words.ends[k] : words.ends[k + 1]] = unpacked(a["words"], words.ends[k + 1] - words.ends[k])
    codes, counts = codes[pairs.back], counts[words.back]
    # What no training text has can't have followed there, whatever its bits.
    codes = np.where(counts > 0, codes, codes | np.uint16(MISS << 8))
    return codes, counts, ~held[tokens.doc]


_SLICE = 1 << 15


def _learn(slices: int, chunk: int = 16_384):
    """One model a partition, learnt online over its training texts, in slices of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, any_ = Model(), False
        for batch in batches:
            for i, tokens, held, _ in _opened(batch):
                codes, counts, train = _answered(batch, i, tokens, held, slices)
                for lo in range(0, len(held), step := max(1, chunk * len(held) // max(len(train), 1))):
                    some = train & (tokens.doc >= lo) & (tokens.doc < lo + step)
                    if some.any():
                        any_ = True
                        model.run(tokens, codes, counts > 1, some, learn=True)
        if any_:
            part = TaskContext.get().partitionId()
            for j, x in enumerate(np.array_split(model.cells(), range(_SLICE, len(model.cells()), _SLICE))):
                if x.any():
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([part], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["slice", "part", "cells"])

    return run


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slice": frame["slice"].iloc[:1], "part": frame["part"].iloc[:1], "cells": [np.sum([np.frombuffer(c, np.float32) for c in frame["cells"]], axis=0, dtype=np.float32).tobytes()]})


def _model(asked: DataFrame, slices: int, fan_in: int = 24) -> Model:
    """The partitions' models added up in a tree, so that no task gets a slice of every partition."""
    schema = "slice int, part long, cells binary"
    parts = table(asked.mapInArrow(tidy(_learn(slices)), schema))
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = table(parts.withColumn("part", F.floor(F.col("part") / fan_in).cast("long")).groupBy("slice", "part").applyInPandas(_added, schema))
    model = Model()
    cells = np.zeros(len(model.cells()), np.float32)
    for r in parts.toLocalIterator():
        x = np.frombuffer(bytes(r["cells"]), np.float32)
        cells[r["slice"] * _SLICE : r["slice"] * _SLICE + len(x)] = x
    return model.load(cells)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _score(shared, slices: int, total: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        norm = np.log10(total + 0.5 * (kinds + 1))
        for batch in batches:
            for i, tokens, held, size in _opened(batch):
                m = len(held)
                codes, counts, train = _answered(batch, i, tokens, held, slices)
                other = counts - train  # without the token itself
                score, hit = model.run(tokens, codes, other > 0, np.ones(len(codes), bool), learn=False)
                score -= np.where(hit, (codes >> 8) / _FINE * np.log10(2), 0)
                known = ~hit & (other > 0)
                score[known] += np.log10(other[known] / np.maximum(total - train[known], 1))
                of = lambda x, tokens=tokens, m=m: np.bincount(tokens.doc, x, m)
                score = of(score)
                bits = np.divide(-score * np.log2(10), size, out=np.zeros(m), where=size > 0)
                base = of(np.log10(counts + 0.5)) - np.diff(tokens.begin) * norm
                cols = [batch.column(batch.schema.get_field_index("doc_id"))[i].values, pa.array(held), pa.array(np.diff(tokens.begin)), pa.array(of(counts > 0).astype(np.int64)), pa.array(np.full(m, total)), pa.array(base), pa.array(score), pa.array(bits, mask=size == 0)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _SCORED.split(", ")])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 1, F.lit(False))


def mixing_scores(docs: DataFrame, slice_bytes: int = 4 << 20) -> DataFrame:
    """Score every text of docs (doc_id long, text string) with a model learnt from the rows not held out.

    Tokens are the text's words with A-Z in lower case, then one end. A token is coded by bits: first
    whether it is among the tokens that followed its context (the two words before it, up to four where those are
    short) in training texts, and then its share there; if not, whether it is a known word, and then its share
    of all; if not, the bits of its bytes. Each kind of bit is predicted from several hashed contexts (how often and
    with how many tokens the context was seen, the run of tokens before that followed theirs, the word
    before; for bytes the last one, two, three and five), mixed by weights that a gate picks, and refined by what such
    mixes met. For a training text (held_out tells) each token's own occurrence is left out of all counts. Words that
    both ways could code make the probabilities add up to a little less than one.

    All counts of words and contexts cover all training texts and live in slices whose number follows the
    bytes (`slice_bytes` of text each): blocks of texts send each slice their different keys, packed, with counts, and
    get the answers back in the same order. Weights, bit tables and refinement are learnt online in each
    partition over all training tokens and added up in a tree; their size is that of the hashed byte contexts (0.7 million
    slots) and is fixed. Only they and two totals reach the driver. Words stand for 63 bits of their hashes; a word and its context for 32 bits of the context's
    beside those that pick its slice, and 31 of the word's. A word that no training text has follows nothing.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte (of the
    UTF-8 text with white space, null without text). Null text: empty, one end token. Null doc_id:
    training, scored. Repeated rows count and are scored each. A very long text is a block of its own. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held"))
    blocks = table(rows.mapInArrow(tidy(_blocks), _BLOCK))
    slices = min(buckets(blocks.agg(F.sum("size")).first()[0] or 0, slice_bytes), 1 << 23)
    answers = table(blocks.mapInArrow(tidy(_ask(slices)), _QUESTION).groupBy("slice").applyInPandas(_answer, _ANSWER))
    total, kinds = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("slice", "pairs", "words")).alias("answers"))
    asked = table(blocks.join(by_block, "block"))
    shared = spark.sparkContext.broadcast(_model(asked, slices))
    return asked.mapInArrow(tidy(_score(shared, slices, int(total), int(kinds))), _SCORED)


def op10_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_scores(read(spark, sf_dir, "documents"))
