"""Joins of reads with ground truths and primers, as equi-joins wherever the semantics allow."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, pairwise, product
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.letters import _DIGIT, cut_rows, letters, packed, packed_rows, texts, unpacked
from ..functions.sequence import index_value
from ..sources.scans import kept, shuffles_go
from .errors import edit_distances
from .ranks import rank_within


#: Bits of the filter that prefixes leave: 32 MB at most, however many prefixes there are.
FILTER_BITS = 1 << 28
_P = 0x9E3779B97F4A7C15


def window_hashes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's k-windows, a row a text, and how many it has; a text shorter than k is one window."""
    shown, size = letters(column)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(shown.shape[1] + 1, _P, np.uint64))
        back = np.cumprod(np.full(shown.shape[1] + 1, pow(_P, -1, 1 << 64), np.uint64))
        sums = np.zeros((len(size), max(shown.shape[1], k) + 1), np.uint64)
        sums[:, 1 : shown.shape[1] + 1] = np.cumsum(shown * power[:-1], axis=1, dtype=np.uint64)
        sums[:, shown.shape[1] + 1 :] = sums[:, shown.shape[1], None]
        h = _mix((sums[:, k:] - sums[:, :-k]) * back[: sums.shape[1] - k])
    return h, np.maximum(size - k + 1, 1)


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h & np.uint64(bits - 1)), (h >> np.uint64(32)) & np.uint64(bits - 1)]


def prefix_filter(texts: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Words of a Bloom filter of two hashes over the first k-window of each text (one column), and its bits: sixteen for each text up to
    FILTER_BITS. Set bits are joined word by word in Spark; the driver gets the words."""
    n = texts.count()
    bits = 1 << min(max((16 * n).bit_length(), 16), FILTER_BITS.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(np.concatenate(_places(window_hashes(batch.column(0), k)[0][:, 0], bits))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["word", "bit"])

    set_ = texts.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[set_["word"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    return words, bits


def prefix_hits(reads: DataFrame, truths: DataFrame, k: int) -> DataFrame:
    """Ground truths whose k-prefix stands in a read (column s), with the first place and edit distance 0. All prefixes have one
    length, so the containment test is a hash join on the read's k-mers. K-mers that no prefix can be, by a filter of
    bounded size, aren't shuffled; the join decides."""
    prefixes = truths.select("gt_id", F.substring("gt", 1, k).alias("kmer")).where("kmer is not null")
    words, bits = prefix_filter(prefixes.select("kmer"), k)
    shared = reads.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = window_hashes(batch.column(2), k)
            row, at = np.nonzero((np.arange(h.shape[1]) < n[:, None]) & np.asarray(batch.column(2).is_valid())[:, None])
            for i in range(2):
                places = _places(h[row, at], bits)[i]
                met = (shared.value[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1
                row, at = row[met], at[met]
            cut = [t[j : j + k] for t, j in zip(batch.column(2).take(pa.array(row)).to_pylist(), at.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(cut, pa.string())], ["cluster_id", "read_no", "pos", "kmer"])

    kind = lambda c: reads.schema[c].dataType.simpleString()
    kmers = reads.select("cluster_id", "read_no", "s").mapInArrow(run, f"cluster_id {kind('cluster_id')}, read_no {kind('read_no')}, pos int, kmer string")
    # Their number follows the data, which no estimate from the files' sizes shows: never broadcast.
    return kmers.hint("merge").join(prefixes, "kmer").groupBy("cluster_id", "read_no", "gt_id").agg(F.min("pos").alias("pos")).withColumn("edit_dist", F.lit(0))


def seeds(k: int, most: int) -> tuple[int, list[tuple[int, ...]]]:
    """Size of a piece, and the sets of pieces (by number) of which one stays whole in a k-prefix after `most` edits. An edit touches
    one piece only, so r of most + r pieces stay whole. r is the one whose whole pieces have the most bases together, with ten sets and four
    bases a piece (r = 1: any), so that sets meet by chance as seldom as can be."""
    able = [r for r in range(1, k - most + 1) if r == 1 or (comb(most + r, r) <= 10 and k // (most + r) >= 4)]
    r = max(able, key=lambda r: (r * (k // (most + r)), -r))
    return k // (most + r), list(combinations(range(most + r), r))


def _layouts(size: int, own: tuple[int, ...], most: int, total: int) -> list[tuple[tuple[int, ...], int, int]]:
    """Distances from the first piece of a set (of `total` pieces, `own`) to its pieces in a read, and the least and most places that the first
    one can be behind its own place in a window. Edits are counted to the pieces they touch (what is put in before a piece, to that piece),
    and a piece of several edits takes untouched neighbours along until no run of missing pieces has more edits than pieces. So pieces side by
    side stay so, and a run moves what follows by as many bases as it has pieces at most. A window is as long as the prefix, so all runs
    together move nothing."""
    runs = [b - a - 1 for a, b in pairwise((-1, *own, total))]
    found: dict = {}
    for moves in product(*(range(-n, n + 1) for n in runs)):
        if sum(moves) == 0 and sum(map(abs, moves)) <= most:
            off = (0, *accumulate((b - a) * size + m for (a, b), m in zip(pairwise(own), moves[1:], strict=False)))
            found.setdefault(off, []).append(moves[0])
    return [(off, min(x), max(x)) for off, x in found.items()]


def _mixed(h: np.ndarray, places: int) -> list[np.ndarray]:
    """Hashes of pieces as what they add to a set's key at each of its places."""
    return [h * np.uint64(pow(_P, 2 * t + 3, 1 << 64) | 1) for t in range(places)]


def _set_salt(no: int) -> np.uint64:
    return np.uint64((no + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)


#: Bits of the filter that sets of pieces leave: 256 MB at most, and a block of it that a task makes.
SEED_BITS, _BLOCK = 1 << 31, 1 << 15


def _marks(keys: np.ndarray) -> np.ndarray:
    """The bits, four at most, that a key sets in its word of the filter."""
    one = np.uint64(1)
    return one << (keys & np.uint64(63)) | one << (keys >> np.uint64(6) & np.uint64(63)) | one << (keys >> np.uint64(12) & np.uint64(63)) | one << (keys >> np.uint64(18) & np.uint64(63))


def seed_filter(keys: DataFrame, n: int) -> np.ndarray:
    """Words of a filter over n keys (column key, long): a key's first bits are its word, in which it sets `_marks`. It has 32 bits or more
    for each key, up to SEED_BITS. Spark makes it in blocks of 256 KB, which the driver puts side by side."""
    words = 1 << min(max((32 * n).bit_length(), 16), SEED_BITS.bit_length() - 1) - 6
    shift = np.uint64(64 - words.bit_length() + 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy().view(np.uint64)
            word = (k >> shift).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((word // _BLOCK).astype(np.int32)), pa.array((word % _BLOCK).astype(np.int32)), pa.array(_marks(k).view(np.int64))], ["block", "word", "marks"])

    def block(rows: pa.Table) -> pa.Table:
        out = np.zeros(min(_BLOCK, words), np.uint64)
        np.bitwise_or.at(out, rows["word"].to_numpy(), rows["marks"].to_numpy().view(np.uint64))
        return pa.table({"block": rows["block"][:1], "words": pa.array([out.tobytes()], pa.binary())})

    with shuffles_go(keys.sparkSession):
        made = keys.select("key").mapInArrow(dealt, "block int, word int, marks long").groupBy("block").applyInArrow(block, "block int, words binary").toArrow()
    out = np.zeros(words, np.uint64)
    for no, own in zip(made["block"].to_pylist(), made["words"], strict=True):
        own = np.frombuffer(own.as_buffer(), np.uint64)
        out[no * _BLOCK : no * _BLOCK + len(own)] = own
    return out


def _truth_keys(truths: DataFrame, k: int, most: int) -> DataFrame:
    """key, no, gt_id, prefix (packed): a row for each set of pieces of a ground truth of k bases or more."""
    size, sets = seeds(k, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = pc.utf8_slice_codeunits(batch.column(1), 0, k)
            long = pc.fill_null(pc.equal(pc.utf8_length(prefix), k), False)
            prefix, ids = prefix.filter(long), batch.column(0).filter(long)
            if len(ids):
                h = _mixed(window_hashes(prefix, size)[0], len(sets[0]))
                keys = np.stack([sum(h[t][:, i * size] for t, i in enumerate(own)) + _set_salt(no) for no, own in enumerate(sets)], axis=1)
                at = pa.array(np.repeat(np.arange(len(ids)), len(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(len(sets), dtype=np.int16), len(ids))), ids.take(at), packed(prefix).take(at)], ["key", "no", "gt_id", "prefix"])

    return truths.select("gt_id", "gt").mapInArrow(run, f"key long, no short, gt_id {truths.schema['gt_id'].dataType.simpleString()}, prefix binary")


def _candidates(reads: DataFrame, truths: DataFrame, k: int, most: int) -> DataFrame:
    """cluster_id, read_no, lo, near, no, prefix, gt_id: reads and ground truths that have a set of pieces (number no) in common, with the part of
    the read that the set's windows cover (packed) and where it begins."""
    size, sets = seeds(k, most)
    keys = _truth_keys(truths, k, most)
    words = seed_filter(keys, len(sets) * truths.count())
    shift, shared = np.uint64(64 - len(words).bit_length() + 1), reads.sparkSession.sparkContext.broadcast(words)
    layouts = [(no, own[0] * size, *x) for no, own in enumerate(sets) for x in _layouts(size, own, most, most + len(own))]

    def met(h: list[np.ndarray], n: int, length: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Row, key, first and last place of a window, of what the filter lets through. h: all rows' first places, all second ones ..."""
        rows = len(length)
        for no, first, off, least, late in layouts:
            lo, hi = max(first + least, 0), min(n - k + first + late, n - size - off[-1]) + 1
            if hi <= lo:
                continue
            key = h[0][lo * rows : hi * rows] + _set_salt(no)
            for t, o in enumerate(off[1:], 1):
                key += h[t][(lo + o) * rows : (hi + o) * rows]
            word = shared.value.take((key >> shift).view(np.int64))
            at = np.flatnonzero((word >> (key & np.uint64(63)) & np.uint64(1)).astype(bool))
            key, word = key[at], word[at]
            marks = _marks(key)
            at, key = at[(word & marks) == marks], key[(word & marks) == marks]
            at, row = at // rows + lo, at % rows
            a, b = np.maximum(at - first - late, 0), np.minimum(at - first - least, length[row] - k)
            keep = (a <= b) & (at + off[-1] + size <= length[row])
            yield row[keep], key[keep], a[keep], b[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                h, shown, length = window_hashes(part.column(2), size)[0].T, *letters(part.column(2))
                n = len(h) + size - 1
                if n < k:
                    continue
                row, key, a, b = (np.concatenate(x) for x in zip(*met(_mixed(h.ravel(), len(sets[0])), n, length), strict=True))
                near = packed_rows(*cut_rows(shown, row, a, b - a + k))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(a.astype(np.int32)), near], ["cluster_id", "read_no", "key", "lo", "near"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    ids = f"cluster_id {kind(reads, 'cluster_id')}, read_no {kind(reads, 'read_no')}"
    kmers = reads.select("cluster_id", "read_no", "s").mapInArrow(run, f"{ids}, key long, lo int, near binary")
    # Their number follows the data, which no estimate from the files' sizes shows: never broadcast.
    return kmers.hint("merge").join(keys, "key").select("cluster_id", "read_no", "lo", "near", "no", "prefix", "gt_id")


def approximate_hits(reads: DataFrame, truths: DataFrame, k: int, most: int) -> DataFrame:
    """Ground truths whose k-prefix is within `most` edits of one of a read's (column s) k-windows, with the first such place and
    its edit distance; ground truths and reads of fewer than k bases have none.

    Some of the prefix's pieces stand unchanged in the window (`seeds`, `_layouts`), so an equi-join on hashes of sets of pieces
    finds every candidate. A set has 18 bases for 30 and two edits, 16 for 20 and one: candidates by chance are some 2 (20 and one: 10) in 100 million
    pairs. Sets that no ground truth can have, by a filter of bounded size, aren't shuffled; the join and then the edit distance
    decide. Sets take the part of the read along that their windows can cover. `most` edits of which all pieces could be hit
    (k <= most) leave no seed and are refused."""
    if most >= k:
        raise ValueError("a prefix must be longer than the edits allowed")
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (near, wide), prefix, lo, no = unpacked(batch.column(3)), unpacked(batch.column(5)), batch.column(2).to_numpy(), batch.column(4).to_numpy()
            best, dist = np.full(batch.num_rows, -1), np.zeros(batch.num_rows, np.int32)
            for x in range(int(wide.max(initial=k)) - k, -1, -1):  # the first window counts
                row = np.flatnonzero(wide >= x + k)
                d = edit_distances((near[row, x : x + k], np.full(len(row), k)), (prefix[0][row], prefix[1][row]))
                best[row[d <= most]], dist[row[d <= most]] = x, d[d <= most]
            # An unchanged prefix has all sets, and its first one tells it.
            keep = np.flatnonzero((best >= 0) & ((dist > 0) | (no == 0)))
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(6).take(at), pa.array((lo[keep] + best[keep]).astype(np.int32)), pa.array(dist[keep])], ["cluster_id", "read_no", "gt_id", "pos", "edit_dist"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"cluster_id {kind(reads, 'cluster_id')}, read_no {kind(reads, 'read_no')}, gt_id {kind(truths, 'gt_id')}, pos int, edit_dist int"
    # Dealt by read, so that what follows of a read needs no other shuffle.
    found = _candidates(reads, truths, k, most).mapInArrow(decide, schema).repartition("cluster_id", "read_no").groupBy("cluster_id", "read_no", "gt_id").agg(F.min(F.struct("pos", "edit_dist")).alias("b"))
    return found.select("cluster_id", "read_no", "gt_id", "b.pos", "b.edit_dist")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_SYMBOLS = np.frombuffer(b"ACGTN", np.uint8)


def _told(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`letters` of packed texts with all symbols but ACGT as N, a byte each."""
    shown, size = unpacked(column)
    plain = np.where(np.isin(shown, _SYMBOLS[:4]), shown, ord("N")).astype(np.uint8)
    plain[np.arange(shown.shape[1]) >= size[:, None]] = 0
    return plain, size


def _edit_hashes(segment: np.ndarray) -> np.ndarray:
    """Hashes (as `window_hashes`) of all texts within one edit of each row of `segment`, some of them repeated."""
    n, size = segment.shape
    with np.errstate(over="ignore"):
        power = np.cumprod(np.array([1] + [_P] * (size + 1), np.uint64), dtype=np.uint64)
        back, one = np.uint64(pow(_P, -1, 1 << 64)), segment.astype(np.uint64)
        upto = np.zeros((n, size + 1), np.uint64)
        np.cumsum(one * power[:size], axis=1, out=upto[:, 1:])
        total = upto[:, -1:]
        gone = upto[:, :-1] + (total - upto[:, 1:]) * back
        changed = [total + (np.uint64(x) - one) * power[:size] for x in _SYMBOLS]
        more = [upto + np.uint64(x) * power[: size + 1] + (total - upto) * np.uint64(_P) for x in _SYMBOLS]
        return _mix(np.concatenate([gone, *changed, *more], axis=1))


def _part_salt(no: int, size: int) -> np.uint64:
    return np.uint64((no * 0x10000 + size + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)


def _in_part(keys: np.ndarray, part: int, of: int) -> np.ndarray:
    return ((keys >> np.uint64(24)) % np.uint64(of)) == part if of > 1 else np.ones(keys.shape, bool)


def _segment_keys(g: DataFrame, segments: tuple[int, ...], parts: int, part: int, of: int) -> DataFrame:
    """key, gid: a row for each text within one edit of one of these segments (by number) of a truth, of one part of all keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                some = batch.slice(begin, 1024)
                shown, length = _told(some.column(1))
                for size in np.unique(length // parts).tolist():
                    rows = np.flatnonzero(length // parts == size)
                    for no in segments if size > 1 else ():
                        keys = _edit_hashes(shown[rows, no * size : (no + 1) * size]) + _part_salt(no, size)
                        keys.sort(axis=1)
                        row, at = np.nonzero(_in_part(keys, part, of) & np.pad(keys[:, 1:] != keys[:, :-1], ((0, 0), (1, 0)), constant_values=True))
                        yield pa.RecordBatch.from_arrays([pa.array(keys[row, at].view(np.int64)), some.column(0).take(pa.array(rows[row]))], ["key", "gid"])

    return g.select("id", "p").mapInArrow(run, "key long, gid long")


def _window_keys(s: DataFrame, sizes: list[int], segments: tuple[int, ...], parts: int, most: int, part: int, of: int, words: np.ndarray) -> DataFrame:
    """key, rid: the windows of a read that can be a text within one edit of a truth's segment, by size and place, if the filter lets them through."""
    shift, shared = np.uint64(64 - len(words).bit_length() + 1), s.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                some = batch.slice(begin, 1024)
                shown, length = _told(some.column(1))
                told = texts(shown[np.arange(shown.shape[1]) < length[:, None]], length)
                hashes, rows, found = {}, [], []
                for size, no in product(sizes, segments):
                    for k in (size - 1, size, size + 1):
                        lo, hi = max(no * size - most, 0), min(no * size + most, shown.shape[1] - k) + 1
                        if hi <= lo:
                            continue
                        if k not in hashes:
                            hashes[k] = window_hashes(told, k)[0]
                        keys = hashes[k][:, lo:hi] + _part_salt(no, size)
                        row, at = np.nonzero(_in_part(keys, part, of) & (np.arange(lo, hi) + k <= length[:, None]))
                        keys = keys[row, at]
                        marks = _marks(keys)
                        met = (shared.value.take((keys >> shift).view(np.int64)) & marks) == marks
                        rows.append(row[met])
                        found.append(keys[met])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), some.column(0).take(pa.array(np.concatenate(rows)))], ["key", "rid"])

    return s.select("id", "p").mapInArrow(run, "key long, rid long")


#: Bits of the filter of a round of `within_distance`, of which each key has 32: some 33 million keys meet in a round.
ROUND_BITS = 1 << 30


def _packed_texts(column: DataFrame) -> DataFrame:
    """id, p (packed), n (length) of the different texts of a table of one column, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).drop_null()
            shown, size = letters(known)
            yield pa.RecordBatch.from_arrays([packed_rows(shown, size), pa.array(size.astype(np.int32))], ["p", "n"])

    return kept(column.mapInArrow(run, "p binary, n int").distinct().select(F.xxhash64("p").alias("id"), "p", "n"))


def within_distance(reads: DataFrame, truths: DataFrame, least: int, most: int) -> DataFrame:
    """Different reads (column s) that have a truth (column g) at an edit distance of `least` to `most`.

    A truth is cut into most // 2 + 1 equal segments. Within `most` edits one segment has one edit at most, and it begins in the
    read at most `most` places off its own. All texts within one edit of a segment meet the read's windows of about its
    size by hashes of segment number and text, so no pair is missed: chance candidates are a few in 100,000 pairs. Windows that no
    segment can be, by a filter of bounded size, aren't shuffled. Where the filter would be too small for all segments' texts, the search goes
    in rounds, by segment and then by part of the hashes, and a round's shuffles go before the next, so disk is that of one
    round. Texts join a round's candidates at its end and the edit distance decides. Symbols but ACGT are one for the search. A truth too short
    for segments of two bases has no seed: it meets the reads of any length that could do, and those are short as well."""
    parts = most // 2 + 1
    g, s = _packed_texts(truths.select("g")).withColumn("size", F.expr(f"n div {parts}")), _packed_texts(reads.select("s"))
    lengths = g.where("size >= 2").groupBy("size").agg(F.count("*").alias("n")).collect()  # a row for each length of a truth
    sizes, total = sorted(x["size"] for x in lengths), sum(x["n"] * (11 * x["size"] + 5) for x in lengths)  # keys of one segment
    of = -(-32 * total // ROUND_BITS)
    rounds = [(tuple(range(parts)), 0, 1)] if 32 * total * parts <= ROUND_BITS else [((no,), i, of) for no in range(parts) for i in range(of)]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = edit_distances(unpacked(batch.column(0)), unpacked(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array((d >= least) & (d <= most)))], ["p"])

    def decided(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(near, "p binary")

    def found(segments: tuple[int, ...], part: int, of: int) -> DataFrame:
        keys = _segment_keys(g, segments, parts, part, of)
        words = seed_filter(keys, max(total * len(segments) // of, 1))
        windows = _window_keys(s, sizes, segments, parts, most, part, of, words)
        # A truth makes over a thousand keys, which no estimate from the files' sizes shows: never broadcast.
        pairs = windows.join(keys.hint("merge"), "key").select("rid", "gid").distinct()
        pairs = pairs if len(rounds) == 1 else kept(pairs)
        own, other = s.select(F.col("id").alias("rid"), F.col("p").alias("s")), g.select(F.col("id").alias("gid"), F.col("p").alias("g"))
        return decided(pairs.join(own, "rid").join(other, "gid").select("s", "g"))

    short = g.where("size < 2").select(F.col("p").alias("g"), F.explode(F.sequence(F.lit(0), F.col("n") + most)).alias("n"))
    out = decided(s.select(F.col("p").alias("s"), "n").join(short, "n").select("s", "g"))
    for x in rounds:
        out = out.unionByName(found(*x) if len(rounds) == 1 else kept(found(*x).distinct()))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, size = unpacked(batch.column(0))
            made = texts(shown[np.arange(shown.shape[1]) < size[:, None]], size) if shown.dtype == np.uint8 else pa.array([r[:n].astype("<u4").tobytes().decode("utf-32-le") for r, n in zip(shown, size.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([made], ["s"])

    return out.distinct().mapInArrow(spelled, "s string")


def best_match(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """The hit with the least (edit_dist, pos, gt_id) of each read, the number of hits, and mapped / mapped_ambiguous / unmapped."""
    best = hits.groupBy("cluster_id", "read_no").agg(F.min(F.struct("edit_dist", "pos", "gt_id")).alias("b"), F.count("*").alias("hits"))
    out = reads.select("cluster_id", "read_no").join(best, ["cluster_id", "read_no"], "left")
    status = F.when(F.col("hits").isNull(), "unmapped").when(F.col("hits") == 1, "mapped").otherwise("mapped_ambiguous")
    return out.select("cluster_id", "read_no", "b.gt_id", "b.pos", "b.edit_dist", F.coalesce("hits", F.lit(0)).alias("hits"), status.alias("status"))


def shortest_unique_prefix(truths: DataFrame, column: str) -> DataFrame:
    """1 + the longest prefix that two neighbours in sorted order share: no length is tried out. Rows are sorted
    within ranges, and a range's first row meets the last of the range before through its own small table."""
    ranged = truths.select(column).repartitionByRange(column).sortWithinPartitions(column).select(column, F.spark_partition_id().alias("part"))
    edges = ranged.groupBy("part").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    inner = ranged.select("part", column)
    pairs = inner.withColumn("before", F.lag(column).over(Window.partitionBy("part").orderBy(column))).where("before is not null").select(F.col(column).alias("a"), F.col("before").alias("b"))
    cross = edges.withColumn("b", F.lag("hi").over(Window.orderBy("part"))).where("b is not null").select(F.col("lo").alias("a"), "b")
    same = F.aggregate(F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: x == y), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & F.coalesce(e, F.lit(False))).alias("on")), lambda s: s["n"])
    return pairs.union(cross).agg((F.max(same) + 1).alias("length"))


def primers(spark: SparkSession, n: int = 13, length: int = 12) -> DataFrame:
    """Primer pairs by experiment, derived from md5 (a stand-in dimension of fixed size)."""
    bases = lambda p: F.substring(F.translate(F.md5(F.concat(F.lit(p), F.col("exp").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, length)
    return spark.range(n).withColumnRenamed("id", "exp").select("exp", bases("f").alias("f"), bases("r").alias("r"))


MARKER, INDEX_BASES = "ACAAC", 7


def index_windows(reads: DataFrame, first: int, last: int) -> DataFrame:
    """cluster_id, read_no, at, off, v: each window of a read (column s) that begins at a place from `first` to `last` (from 0) and has
    marker and index in bases alone, with the marker's different symbols and the index as a number."""
    size = len(MARKER) + INDEX_BASES
    at = reads.select("cluster_id", "read_no", "s", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("at")).where(F.col("at") + size <= F.length("s"))
    w = at.withColumn("w", F.substring("s", F.col("at") + 1, F.lit(size))).where(F.col("w").rlike("^[ACGT]*$"))
    off = sum((F.substring("w", i + 1, 1) != b).cast("int") for i, b in enumerate(MARKER))
    return w.select("cluster_id", "read_no", "at", off.alias("off"), index_value(F.substring("w", len(MARKER) + 1, INDEX_BASES)).alias("v"))


def index_clusters(reads: DataFrame, valid: DataFrame, settings: list[tuple[int, int, int]]) -> DataFrame:
    """start, end, most, cluster_id, read_no, v: for each setting (first place, end of the last window, symbols of the marker that may
    differ) the first window of a read whose index is among `valid` (column v); no row where a read has none. All settings share
    one pass over the reads' windows. valid holds numbers of seven bases, 16,384 at most."""
    size = len(MARKER) + INDEX_BASES
    w = index_windows(reads, min(a for a, _, _ in settings), max(b for _, b, _ in settings) - size)
    known = w.where(F.col("off") <= max(m for *_, m in settings)).join(F.broadcast(valid.select("v").distinct()), "v", "left_semi")
    grid = reads.sparkSession.createDataFrame(settings, "start int, end int, most int")
    hits = known.crossJoin(F.broadcast(grid)).where((F.col("at") >= F.col("start")) & (F.col("at") + size <= F.col("end")) & (F.col("off") <= F.col("most")))
    return hits.groupBy("start", "end", "most", "cluster_id", "read_no").agg(F.min_by("v", "at").alias("v"))


def index_sweep(reads: DataFrame, valid: DataFrame, settings: list[tuple[int, int, int]]) -> DataFrame:
    """For each setting of `index_clusters`: clusters, reads found, reads that failed, and their share. A task counts its reads by setting and
    index, so that no window and no read becomes a row."""
    size, kinds = len(MARKER) + INDEX_BASES, 4**INDEX_BASES
    numbers = np.array([r.v for r in valid.select("v").distinct().collect()], np.int64)  # 16,384 at most
    known = np.zeros(kinds, bool)
    known[numbers[(numbers >= 0) & (numbers < kinds)]] = True
    first, last = max(min(a for a, _, _ in settings), 0), max(b for _, b, _ in settings) - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros((len(settings), kinds), np.int64)
        for batch in batches:
            shown, length = letters(batch.column(0))
            total += len(length)
            places = np.arange(first, min(last, shown.shape[1] - size) + 1)
            if not len(places):
                continue
            digit = np.where(shown < 128, _DIGIT[shown & 127], 4)
            fits = places + size <= length[:, None]
            off, v = np.zeros(fits.shape, np.int64), np.zeros(fits.shape, np.int64)
            for i in range(size):
                here = places + i
                fits &= digit[:, here] < 4
                if i < len(MARKER):
                    off += shown[:, here] != ord(MARKER[i])
                else:
                    v = v * 4 + (digit[:, here] & 3)
            fits &= known[v]
            for no, (start, end, most) in enumerate(settings):
                hit = fits & (places >= start) & (places + size <= end) & (off <= most)
                row = np.flatnonzero(hit.any(axis=1))
                counts[no] += np.bincount(v[row, hit[row].argmax(axis=1)], minlength=kinds)
        no, index = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(no, -1).astype(np.int32)), pa.array(np.append(index, 0)), pa.array(np.append(counts[no, index], total))], ["no", "v", "n"])

    each = reads.select("s").mapInArrow(run, "no int, v long, n long").groupBy("no", "v").agg(F.sum("n").alias("n"))
    of = each.groupBy("no").agg(F.count("*").alias("clusters"), F.sum("n").alias("found"))
    grid = reads.sparkSession.createDataFrame([(no, *x) for no, x in enumerate(settings)], "no int, start int, end int, most int")
    total = F.max(F.when(F.col("no") == -1, F.col("found"))).over(Window.partitionBy())  # a row a setting and one of all
    both = of.join(F.broadcast(grid), "no", "full").withColumn("total", total).where("no >= 0")
    out = both.select("start", "end", "most", F.coalesce("clusters", F.lit(0)).alias("clusters"), F.coalesce("found", F.lit(0)).alias("found"), "total")
    return out.withColumn("failed", F.col("total") - F.col("found")).withColumn("failed_share", F.col("failed") / F.col("total"))


def concatenated_pairs(clusters: DataFrame) -> DataFrame:
    """clusters: cluster_id, gt, reads (array). Consecutive clusters (by id) of as many reads in pairs: a, b, n, reads (the first's each
    with the second's at its place) and gt; the last of an odd number of clusters is left out."""
    ranked = rank_within(clusters.withColumn("n", F.size("reads")), ["n"], "cluster_id").withColumn("pair", F.expr("(k + 1) div 2"))
    row = F.struct("cluster_id", "gt", "reads")
    two = ranked.groupBy("n", "pair").agg(F.min_by(row, "k").alias("a"), F.max_by(row, "k").alias("b"), F.count("*").alias("m")).where("m = 2")
    return two.select(F.col("a.cluster_id").alias("a"), F.col("b.cluster_id").alias("b"), "n", F.zip_with("a.reads", "b.reads", lambda x, y: F.concat(x, y)).alias("reads"), F.concat("a.gt", "b.gt").alias("gt"))
