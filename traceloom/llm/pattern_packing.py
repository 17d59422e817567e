"""Operator 3: packing token sequences by non-negative least squares over length patterns."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import buckets, read, table, tidy
from .dp_bpe import byte_characters

#: Parts whose ids are remembered within a partition, and words within a worker; when full, the memory starts anew.
REMEMBERED = 1_000_000
_known: dict[str, _Words] = {}


#: What the vocabulary's splitter makes of plain text (see `_plain`): runs of letters, single digits, runs of other signs.
_SPLIT = re.compile(r"[^\W\d_]+|[0-9]|(?:[^\w]|_)+")
#: Code points from here on may compose or be marks.
_MARKS_FROM = "\u0250"


def _plain(word: str) -> str | None:
    """The word in lower case, if normalizer and splitter do no more than that and cut it by `_SPLIT`: letters below the first
    marks, which compose with nothing, and ASCII. No apostrophe (contractions) and no special token. Else None."""
    if "'" in word or "<|" in word:
        return None
    if word.isascii():
        return word.lower()
    low = "".join([c.lower() for c in word])
    return low if max(word) < _MARKS_FROM and max(low) < _MARKS_FROM and all(c < "\x80" or c.isalpha() for c in low) else None


class _Words:
    """Ids of white-space parts, remembered."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.shown = {c: b for c, b in enumerate(map({b: c for c, b in byte_characters().items()}.__getitem__, range(256)))}
        self.known: dict[bytes, bytes] = {}
        self.cut: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        """Ids of what the splitter gives as one, by the library's model alone."""
        found = self.cut.get(piece)
        if found is None:
            ids = [t.id for t in self.model.tokenize(piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.shown))]
            found = self.cut[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def learn(self, parts: set[bytes]) -> None:
        """Make sure that all parts are known."""
        new = parts.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = parts
        if len(self.cut) > REMEMBERED:
            self.cut.clear()
        other = []
        for part in new:
            low = _plain(part.decode())
            if low is None:
                other.append(part)
            elif low.isalpha():
                self.known[part] = self._ids(low)
            else:
                self.known[part] = b"".join(map(self._ids, _SPLIT.findall(low)))
        for part, e in zip(other, self.tokenizer.encode_batch_fast([p.decode() for p in other], add_special_tokens=False), strict=True):
            self.known[part] = np.array(e.ids, "<u4").tobytes()


def token_ids(texts: list[bytes], vocabulary: str) -> Iterator[bytes]:
    """Ids (little-endian uint32) of each text by the tokenizers library.

    ASCII white space is a border for this vocabulary's normalizer and splitter, so a text's ids are those
    of its white-space parts in a row, and a part that was seen before needn't be encoded again.
    """
    if vocabulary not in _known:
        _known[vocabulary] = _Words(vocabulary)
    words = _known[vocabulary]
    known = words.known
    for i in range(0, len(texts), 256):
        some = texts[i : i + 256]
        found = [list(map(known.get, t.split())) for t in some]
        if any(None in f for f in found):
            lost = [t.split() for t, f in zip(some, found, strict=True) if None in f]
            words.learn(set().union(*lost))
            for k, f in enumerate(found):
                if None in f:  # the memory may have begun anew
                    found[k] = [known.get(p) for p in some[k].split()]
                    if None in found[k]:
                        words.learn(set(some[k].split()))
                        found[k] = [known[p] for p in some[k].split()]
        yield from map(b"".join, found)


def _pieces(vocabulary: str, size: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(5)]
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), token_ids(texts, vocabulary), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    for c, v in zip(out, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if vocabulary in _known:  # words stay for the worker's next partition
            _known[vocabulary].known.clear()

    return run


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares a x = b with x >= 0 (active sets after Lawson and Hanson)."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        k = int(gain.argmax())
        if gain[k] <= scale:
            break
        free[k] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min(initial=0) >= 0:
                x = s
                break
            bad = free & (s < 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-9 * max(1.0, x.max(initial=0))
            x[~free] = 0
    return x


def patterns(classes: int, parts: int) -> list[tuple[int, ...]]:
    """Descending tuples of up to `parts` classes that sum to `classes`."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, done: tuple[int, ...]) -> None:
        if left == 0:
            out.append(done)
        elif len(done) < parts:
            for c in range(min(left, most), 0, -1):
                if c * (parts - len(done)) < left:
                    break
                grow(left - c, c, (*done, c))

    grow(classes, classes, ())
    return out


def plan(histogram: dict[int, int], size: int, step: int = 64, parts: int = 4) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for all pieces of a length histogram: (length, first rank, count, first sequence, slots of this
    length in a sequence, offset). Its cost depends on the number of lengths, not on their counts.

    Lengths fall into classes of `step` tokens. Few-piece patterns of classes that fill a sequence are
    enumerated, their repeats fitted to the class histogram by non-negative least squares and rounded down,
    and given the longest pieces of each class. What is left, and the room left in the patterns, is packed
    by best fit in descending length, again a whole count at a time.
    """
    left = dict(histogram)
    bins: list[tuple[int, tuple[tuple[int, int], ...], int]] = []  # room, (length, slots)..., how many sequences

    classes = size // step
    by_class: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        if n < size and -(-n // step) <= classes:
            by_class.setdefault(-(-n // step), []).append(n)
    usable = [p for p in patterns(classes, parts) if len(p) > 1 and set(p) <= set(by_class)]
    if usable:
        a = np.zeros((classes + 1, len(usable)))
        for k, p in enumerate(usable):
            for c in p:
                a[c, k] += 1
        b = np.array([float(sum(left[n] for n in by_class.get(c, ()))) for c in range(classes + 1)])
        repeats = np.floor(nnls(a, b) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            need = int(repeats[k])
            for c in set(usable[k]):
                need = min(need, sum(left[n] for n in by_class[c]) // usable[k].count(c))
            while need > 0:
                chosen, take = [], need
                held: dict[int, int] = {}
                for c in usable[k]:
                    n = next(n for n in by_class[c] if left[n] > held.get(n, 0))
                    held[n] = held.get(n, 0) + 1
                    chosen.append(n)
                take = min(take, *(left[n] // h for n, h in held.items()))
                for n, h in held.items():
                    left[n] -= take * h
                bins.append((size - sum(chosen), tuple(sorted(held.items(), reverse=True)), take))
                need -= take

    rooms: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    for room, held, count in bins:
        rooms.setdefault(room, []).append((held, count))
    for n in sorted((n for n in left if left[n]), reverse=True):
        count = left[n]
        for room in sorted(r for r in rooms if r >= n):
            fit = room // n
            while count and rooms.get(room):
                held, many = rooms[room].pop()
                full = min(many, count // fit)
                if full:
                    rooms.setdefault(room - fit * n, []).append(((*held, (n, fit)), full))
                    count -= full * fit
                if many > full:
                    if 0 < count < fit:
                        rooms.setdefault(room - count * n, []).append(((*held, (n, count)), 1))
                        count, many = 0, many - 1
                    if many > full:
                        rooms[room].append((held, many - full))
                        break
            if not count:
                break
        if count:
            fit = size // n
            if count >= fit:
                rooms.setdefault(size - fit * n, []).append((((n, fit),), count // fit))
            if count % fit:
                rooms.setdefault(size - count % fit * n, []).append((((n, count % fit),), 1))

    out, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for room in sorted(rooms):
        for held, many in rooms[room]:
            offset = 0
            for n, slots in held:
                out.append((n, rank[n], many * slots, sequence, slots, offset))
                rank[n] += many * slots
                offset += n * slots
            sequence += many
    return out


def _assign(slots: list[tuple[int, int, int, int, int, int]]):
    s = np.array(sorted(slots), np.int64).reshape(-1, 6)
    lengths, starts = np.unique(s[:, 0], return_index=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            at = np.zeros(len(n), np.int64)
            for k in np.unique(n):
                lo = starts[np.searchsorted(lengths, k)]
                hi = np.searchsorted(s[:, 0], k, "right")
                mine = n == k
                at[mine] = lo + np.searchsorted(s[lo:hi, 1], rank[mine], "right") - 1
            r = rank - s[at, 1]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s[at, 3] + r // s[at, 4]), pa.array(s[at, 5] + r % s[at, 4] * n)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1, salt_rows: int = 50_000) -> DataFrame:
    """Pack the tokens of docs (doc_id long, text string) into sequences of at most `size` tokens.

    A document's tokens are the tokenizer's ids without special tokens and then end_id; only longer ones are
    cut. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row a piece. Null or empty
    text: end_id alone. Repeated rows are packed once each. A null doc_id stays null. An empty table gives an
    empty result. Only the length histogram (at most `size` rows) and the plan over it reach the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("text"))
    pieces = table(rows.mapInArrow(tidy(_pieces(vocabulary, size, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    salts = buckets(sum(histogram.values()), salt_rows, 16)
    # Ranks within a length: any length may hold most rows, so each is dealt over salts and the counts of
    # the salts before are added.
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("own", own).join(counts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_assign(plan(histogram, size)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), word_vocabulary())
