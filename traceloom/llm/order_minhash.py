"""Operator 5: near-duplicate documents by order MinHash, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._graph import components
from ._shared import read, table, tidy

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def labelled_shingles(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document in text order, each with the number of times that the
    document had it before, and where each document's shingles begin. A text of 1 to k-1 words is one shingle."""
    starts, ends, at = T.words(offsets, data)
    hashes = T.word_hashes(starts, ends, data)
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    first = at[:-1][doc] + np.arange(len(doc)) - begin[:-1][doc]
    if not len(doc):
        return np.zeros(0, np.uint64), begin
    made = T.Rolling(hashes).spans(first, np.minimum(first + k, at[1:][doc]))
    key = T.mix(made + doc.astype(np.uint64) * _GOLD)
    order = np.argsort(key, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    before = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    seen = np.empty(len(order), np.uint64)
    seen[order] = before
    return np.where(seen > 0, T.mix(made + seen * _GOLD), made), begin


def sketches(shingles: np.ndarray, begin: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n order-MinHash sketches of each document that has shingles, and the low bits of the minima behind them:
    two least labelled shingles under each permutation, put in text order and hashed together."""
    rng = np.random.default_rng(seed)
    some = np.flatnonzero(np.diff(begin))
    at, count = begin[:-1][some], np.diff(begin)[some]
    made, minima = np.zeros((len(begin) - 1, n), np.uint64), np.zeros((len(begin) - 1, 2 * n), np.uint16)
    if not len(some):
        return made, minima
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(n):
        flip, by = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        v = (shingles ^ flip) * (by | np.uint64(1))
        v ^= v >> np.uint64(31)
        one = np.minimum.reduceat(v, at)
        p1 = np.flatnonzero(v == np.repeat(one, count))
        v[p1] = top
        two = np.minimum.reduceat(v, at)
        p1 = p1[np.searchsorted(p1, at)]
        p2 = np.flatnonzero(v == np.repeat(two, count))
        p2 = p2[np.searchsorted(p2, at)]
        a, b = shingles[np.minimum(p1, p2)], shingles[np.maximum(p1, p2)]
        made[some, j] = T.mix(a * _GOLD + b + np.uint64(j))
        minima[some, 2 * j], minima[some, 2 * j + 1] = one >> np.uint64(48), two >> np.uint64(48)
    return made, minima


def _sign(k: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, offsets, data in T.pieces(batch.column(1)):
                m = len(offsets) - 1
                shingles, begin = labelled_shingles(offsets, data, k)
                made, minima = sketches(shingles, begin, bands * rows, seed)
                keys = made.reshape(m, bands, rows)
                key = np.zeros((m, bands), np.uint64)
                for j in range(rows):
                    key = T.mix(key * _GOLD + keys[:, :, j])
                key = T.mix(key + np.arange(bands, dtype=np.uint64))
                text_key = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m * bands + 1, bands, dtype=np.int32)), pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(row, m), batch.column(2).slice(row, m), pa.array(text_key, pa.binary()), pa.array(np.diff(begin).astype(np.int32)), flat, pa.array([x.tobytes() for x in minima], pa.binary()), pa.array([x.tobytes() for x in key], pa.binary())], ["doc_id", "text_hash", "text_key", "n", "bands", "minima", "all"])

    return run


def _shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in T.pieces(batch.column(1)):
                shingles, begin = labelled_shingles(offsets, data, k)
                raw = [shingles[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                keys = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(raw)), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["first", "text_key", "shingles"])

    return run


def similarity(x: np.ndarray, y: np.ndarray, least: float) -> float:
    """Shingles aligned in order over all shingles of both (aligned ones once), within the band that a similarity of `least` allows.

    Labelled shingles are unique in a document, so the alignment is the longest chain of matches that
    ascends in both, and each match stands at one place of the table. An alignment of `least` leaves at
    most `band` shingles out, so no match further off the diagonal is part of it. 0.0 if it can't be reached.
    """
    n = len(x) + len(y)
    need = int(np.ceil(least * n / (1 + least) - 1e-9))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(i) < need or not n:
        return 0.0
    near = np.abs(i - j) <= n - 2 * need
    i, j = i[near], j[near]
    chain: list[int] = []
    for v in j[np.argsort(i)].tolist():
        at = bisect_left(chain, v)
        chain[at : at + 1] = [v]
    return len(chain) / (n - len(chain)) if len(chain) >= need else 0.0


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            got = np.array([similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), least) for p, q in zip(x, y, strict=True)])
            keep = pa.array(got >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _likely(own: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the others share as many shingles with own as a similarity of `least` needs."""
    own = np.sort(own)
    size = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64) >= np.ceil(least * (size + len(own)) / (1 + least) - 1e-9)


def _partners(least: float, agree: float, most: int | None):
    """Pairs of different classes in each bucket, each pair once, in its first shared band. With `most`, a member's
    best partners by agreement of their minima, to be aligned elsewhere. Without, all other partners, aligned here
    (rows then bring their shingles), and the pairs are links; partners that a link has brought into the member's
    class are skipped. Rows come sorted by bucket."""

    def bucket(key: int, docs: np.ndarray, n: np.ndarray, cls: np.ndarray, block: np.ndarray, two: bool, minima: list[bytes], bands: list[bytes], shingles: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if len(docs) < 2 or (cls == cls[0]).all():
            return none, none
        sign = np.frombuffer(b"".join(minima), np.uint16).reshape(len(docs), -1)
        band = np.frombuffer(b"".join(bands), np.int64).reshape(len(docs), -1)
        band = band[:, : int(np.flatnonzero(band[0] == key)[0])]
        # A pair of two classes has a member outside the bucket's largest class; that one looks for the other.
        names, sizes = np.unique(cls, return_counts=True)
        seeks = cls != names[sizes.argmax()]
        xs, ys = [], []
        for lo in range(0, len(docs), 256):
            rows = slice(lo, lo + 256)
            same = np.zeros((len(docs[rows]), len(docs)), np.int16)
            for c in range(sign.shape[1]):
                same += sign[rows, c, None] == sign[None, :, c]
            ratio = np.minimum(n[rows, None], n[None, :]) >= least * np.maximum(n[rows, None], n[None, :])
            good = (same >= agree * sign.shape[1]) & ratio & (docs[rows, None] != docs[None, :])
            if two:
                good &= block[rows, None] != block[None, :]
            # Only members that have a partner of another class need an order.
            rows_left = np.flatnonzero((good & (cls[rows, None] != cls[None, :])).any(axis=1) & seeks[rows])
            for r in rows_left.tolist():
                c = np.flatnonzero(good[r])
                c = c[~(band[c] == band[lo + r]).any(axis=1)]  # met in an earlier band
                c = c[np.lexsort((docs[c], -same[r, c]))]
                if shingles is None:
                    c = c[:most]
                    c = c[cls[c] != cls[lo + r]]
                else:
                    c = c[cls[c] != cls[lo + r]]
                    if len(c):
                        mine, theirs = np.frombuffer(shingles[lo + r], np.uint64), [np.frombuffer(shingles[x], np.uint64) for x in c.tolist()]
                        links = []
                        for x in np.flatnonzero(_likely(mine, theirs, least)).tolist():
                            if cls[c[x]] != cls[lo + r] and similarity(mine, theirs[x], least) >= least:
                                links.append(c[x])
                                cls[cls == cls[lo + r]] = cls[c[x]]
                        c = np.array(links, np.int64)
                xs.append(np.full(len(c), docs[lo + r]))
                ys.append(docs[c])
        return (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _closed(batches):
            t = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks() if batch is not None else None
            if t is None:
                t = pa.Table.from_batches([rest]) if rest is not None else None
                if t is None or not t.num_rows:
                    return
                ends = None
            keys = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            head = np.ones(len(keys[0]), bool)
            head[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            ends = np.append(np.flatnonzero(head), len(head))
            if batch is not None:  # the last bucket may go on in the next batch
                rest = t.slice(int(ends[-2])).combine_chunks().to_batches()[0]
                ends = ends[:-1]
            docs, n, cls, block = (t.column(c).to_numpy() for c in ("doc", "n", "cls", "block"))
            cls = cls.copy()
            shingles = t.column("shingles").to_pylist() if most is None else None
            minima, bands = t.column("minima").to_pylist(), t.column("all").to_pylist()
            xs, ys = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                x, y = bucket(int(keys[0][a]), docs[a:b], n[a:b], cls[a:b], block[a:b], keys[1][a] != keys[2][a], minima[a:b], bands[a:b], shingles[a:b] if shingles else None)
                xs.append(x)
                ys.append(y)
            x, y = np.concatenate([*xs, np.zeros(0, np.int64)]), np.concatenate([*ys, np.zeros(0, np.int64)])
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def _round(each: DataFrame, classes: DataFrame | None, least: float, agree: float, most: int | None, shingles: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of the buckets that still hold several classes."""
    known = each.withColumn("cls", F.col("doc")) if classes is None else each.join(classes.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("cls", F.coalesce("component", "doc")).drop("component")
    several = known.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = known.join(several, "key").withColumn("other", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "n", "cls", "block", "minima", "all")
    if shingles is not None:
        spread = spread.join(shingles, "doc")
    return spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc").mapInArrow(tidy(_partners(least, agree, most)), "a long, b long")


def near_duplicates(docs: DataFrame, least: float = 0.8, k: int = 5, bands: int = 16, rows: int = 2, agree: float = 0.45, block_rows: int = 1024, most: int = 3, seed: int = 23) -> DataFrame:
    """Classes of documents joined by texts whose k-word shingles align to a similarity of `least`.

    docs: doc_id long, text string. Equal texts are one class from the start and never paired. Every other
    pair that shares a band of sketches, fits in length and agrees in the share `agree` of the minima (far
    below what a similar pair shows) is either in one class in the end or was aligned and found unlike. First
    each document is aligned with its `most` best partners of a bucket, which joins nearly all of a group of
    near copies. Then the members that are left outside meet all other partners inside the bucket, where a
    count of shared shingles precedes the alignment, and only links leave the task. Buckets over
    `block_rows` are compared in pairs of blocks. Returns doc_id, text_hash, component_id (smallest doc_id of the class), kept.
    Null text or null doc_id: alone (component_id is doc_id). Empty texts are copies of each other; texts without words
    have no other link. Repeated rows give one row; an id that stands for several texts has a row for each
    (text_hash: xxhash64 of the text), and one of them at most is kept. A very long text is worked in one numpy
    pass of its task. An empty table gives an empty result. Other columns are ignored.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    usable = text.where("doc_id is not null and text is not null")
    signed = table(usable.mapInArrow(tidy(_sign(k, bands, rows, seed)), "doc_id long, text_hash long, text_key binary, n int, bands array<long>, minima binary, all binary"))
    # One node for each different text, whatever the ids of its rows.
    members = table(signed.groupBy("doc_id", "text_key").agg(F.first("n").alias("n"), F.first("text_hash").alias("text_hash")))
    texts = table(members.groupBy("text_key", "n").agg(F.min("doc_id").alias("first")).withColumn("doc", F.monotonically_increasing_id()))
    one = texts.join(signed.select(F.col("doc_id").alias("first"), "text_key", "bands", "minima", "all"), ["first", "text_key"]).where("n > 0")
    each = one.dropDuplicates(["doc"]).select("doc", "n", "minima", "all", F.explode("bands").alias("key"))
    held = each.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    each = each.join(held, "key").withColumn("blocks", F.ceil(F.col("held") / block_rows).cast("int"))
    each = table(each.withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int")))
    candidates = texts.join(each.select("doc").distinct(), "doc").select("first", "text_key", "doc")
    shingles = usable.join(candidates.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    shingles = shingles.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text").mapInArrow(tidy(_shingle_rows(k)), "first long, text_key binary, shingles binary")
    shingles = table(shingles.join(candidates, ["first", "text_key"]).select("doc", "shingles").dropDuplicates(["doc"]))
    a, b = (shingles.select(F.col("doc").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")

    links = _round(each, None, least, agree, most).distinct()
    links = table(links.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(_verify(least)), "a long, b long"))
    classes = table(components(links))
    links = table(links.union(_round(each, classes, least, agree, None, shingles)))
    classes = components(links).withColumnRenamed("node", "doc")
    known = table(texts.join(classes, "doc", "left").select("text_key", "first", F.coalesce("component", "doc").alias("component")))
    least_id = known.groupBy("component").agg(F.min(F.struct("first", "text_key")).alias("least")).select("component", F.col("least.first").alias("component_id"), F.col("least.text_key").alias("kept_key"))
    known = known.join(least_id, "component").select("text_key", "component_id", "kept_key")
    out = members.join(known, "text_key").select("doc_id", "text_hash", "component_id", ((F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("kept_key"))).alias("kept"))
    alone = text.where("doc_id is null or text is null").select("doc_id").distinct().select("doc_id", F.lit(None).cast("long").alias("text_hash"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")
