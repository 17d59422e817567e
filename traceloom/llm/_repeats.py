"""Windows (of bytes or of words) that occur more than once in a corpus, found without moving all suffixes.

The two substring operators share this front end and differ in the matcher that works inside a group:

1. Every text is read once; each run of windows that share an anchor becomes one small row (anchor,
   document, place, length). No text moves.
2. Anchors seen once are dropped: their windows can't repeat. The texts that keep runs are joined with
   them and only the segments under the kept runs are cut out.
3. Equal segments under one anchor are counted together before they move (`copies`), so that a group of
   exact copies is one row. A lone segment with copies repeats as a whole.
4. The other segments meet by anchor in groups of bounded size, where the matcher finds the windows that
   occur in several segments.
5. A group over `core_bytes` isn't gathered. Its windows are dealt by how far the anchor is from their
   start, an eighth of the range each. All windows of one cell share a longer string around the anchor,
   the cell's core, and meet by it. Cores lengthen so, level by level, until their groups fit; cores that
   one segment alone has are dropped, and equal parts are counted together again. In the last level a
   core is a whole window. Each level has at most eight rows for a row of a group that didn't fit.
6. The runs found go back to the segments, and so to documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._shared import buckets, table, tidy

RUN = "array<struct<off:int,len:int,doc:long,pos:long>>"
#: symbols and match: values of a segment's symbols, and runs of repeated windows of a group's segments.
Matcher = Callable[["Segments"], list[list[tuple[int, int, int, int]]]]


class Segments:
    """The segments of a group laid end to end, in the order of their first occurrence."""

    def __init__(self, frame: pd.DataFrame, unit: str):
        self.unit = unit
        texts = frame["segment"].tolist()
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.texts = texts
        if unit == "word":
            starts, ends, self.offsets = T.words(offsets, data)
            self.values = T.word_hashes(starts, ends, data)
        else:
            self.offsets, self.values = offsets, data
        self.n, self.copies = frame["n"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64)
        self.doc, self.pos = frame["doc"].to_numpy(np.int64), frame["pos"].to_numpy(np.int64)
        #: For each window: its segment, and its place in the values.
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        self.off = np.arange(self.n.sum()) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.at = self.offsets[self.owner] + self.off

    def words(self) -> np.ndarray:
        """A number for each word, the same for equal words alone; values are hashes."""
        numbers: dict[bytes, int] = {}
        return np.array([numbers.setdefault(w, len(numbers)) for w in b" ".join(self.texts).split(b" ")], np.int64)

    def runs(self, repeated: np.ndarray, doc: np.ndarray | None = None, pos: np.ndarray | None = None) -> list[list[tuple[int, int, int, int]]]:
        """The repeated windows of each segment as runs that have one source; doc and pos: each window's first
        occurrence, where the rule asks for it."""
        doc = np.zeros(len(repeated), np.int64) if doc is None else doc
        origin = np.zeros(len(repeated), np.int64) if pos is None else pos - self.off
        i = np.flatnonzero(repeated)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in self.n]
        if len(i):
            new = np.ones(len(i), bool)
            new[1:] = (np.diff(i) != 1) | (np.diff(self.owner[i]) != 0) | (np.diff(doc[i]) != 0) | (np.diff(origin[i]) != 0)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(i)))
            j = i[first]
            at = np.zeros(len(j), np.int64) if pos is None else pos[j]
            for s, *run in zip(self.owner[j].tolist(), self.off[j].tolist(), size.tolist(), doc[j].tolist(), at.tolist(), strict=True):
                out[s].append(tuple(run))
        return out


def _symbols(unit: str, column: pa.Array) -> Iterator[tuple]:
    for row, offsets, data in T.pieces(column):
        if unit == "word":
            starts, ends, at = T.words(offsets, data)
            yield row, offsets, data, starts, ends, at, T.word_hashes(starts, ends, data)
        else:
            yield row, offsets, data, None, None, offsets, T.BYTE_VALUES[data]


def _find_runs(unit: str, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for row, _, _, _, _, at, values in _symbols(unit, batch.column(1)):
                doc, x0, n, dist, anchor = T.anchor_runs(values, at, window, gram)
                cols = [anchor, ids[row + doc].astype(np.int64), tags[row + doc].astype(np.int64), *(c.astype(np.int32) for c in (x0, n, dist))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "doc", "tag", "x0", "n", "dist"])

    return run


_SEGMENT = {"anchor": "long", "doc": "long", "tag": "long", "x0": "int", "n": "int", "dist": "int", "key": "binary", "segment": "binary"}
_CELL = {"anchor": "long", "key": "binary", "base": "int", "core": "long", "part": "binary", "n": "int", "dist": "int", "copies": "long", "doc": "long", "pos": "long", "segment": "binary"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _batch(columns: dict[str, str], rows: list[tuple]) -> pa.RecordBatch:
    lists = list(zip(*rows, strict=True)) if rows else [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(lists, columns.values(), strict=True)], list(columns))


def _cut(unit: str, window: int):
    """Segments of the runs of each text, under a key of their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, runs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            flat, ends = runs.values, np.asarray(runs.offsets)
            fx, fn, fd, fa = (flat.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(4))
            out, size = [], 0
            for row, offsets, data in T.pieces(batch.column(2)):
                starts, stops, at = T.words(offsets, data) if unit == "word" else (None, None, offsets)
                for k in range(len(offsets) - 1):
                    for j in range(ends[row + k], ends[row + k + 1]):
                        x, n = fx[j], fn[j]
                        a, b = at[k] + x, at[k] + x + n - 1 + window
                        segment = b" ".join(data[starts[i] : stops[i]].tobytes() for i in range(a, b)) if unit == "word" else data[a:b].tobytes()
                        out.append((fa[j], ids[row + k], tags[row + k], x, n, fd[j], xxhash.xxh3_128_digest(segment, seed=n), segment))
                        size += len(segment)
                if size > 4 << 20:
                    yield _batch(_SEGMENT, out)
                    out, size = [], 0
            yield _batch(_SEGMENT, out)

    return run


def _match_group(unit: str, match: Matcher):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc", "pos"], kind="stable")
        runs = match(Segments(frame, unit))
        out = pd.DataFrame({"core": frame["core"].to_numpy(), "part": frame["part"].to_numpy(), "runs": [[dict(zip(("off", "len", "doc", "pos"), r, strict=True)) for r in x] for x in runs]})
        return out[[bool(x) for x in runs]]

    return run


def _deal(unit: str, window: int, step: int):
    """The windows of each segment in cells of `step` by their distance to the anchor. A cell's core is what all
    windows of that distance share: from the anchor less the greatest distance of the cell to the end of
    the window of the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = batch.column(batch.schema.get_field_index("segment"))
            given = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("anchor", "key", "base", "n", "dist", "copies", "doc", "pos")]
            out, size = [], 0
            for row, offsets, data in T.pieces(segments):
                starts, stops, at = T.words(offsets, data) if unit == "word" else (None, None, offsets)

                def text(a: int, b: int, starts=starts, stops=stops, data=data) -> bytes:
                    return data[starts[a] : stops[b - 1]].tobytes() if unit == "word" else data[a:b].tobytes()

                for k in range(len(offsets) - 1):
                    anchor, key, base, n, dist, copies, doc, pos = (g[row + k] for g in given)
                    a = 0
                    while a < n:
                        cell = (dist - a) // step
                        b = min(n, dist - cell * step + 1)  # windows a to b-1 are in the cell
                        core = text(at[k] + dist - cell * step, at[k] + dist - (cell + 1) * step + 1 + window)
                        part = text(at[k] + a, at[k] + b - 1 + window)
                        out.append((anchor, key, base + a, xxhash.xxh3_64_intdigest(core, seed=cell) - (1 << 63), xxhash.xxh3_128_digest(part, seed=b - a), b - a, dist - a, copies, doc, pos + a, part))
                        size += len(part)
                        a = b
                if size > 4 << 20:
                    yield _batch(_CELL, out)
                    out, size = [], 0
            yield _batch(_CELL, out)

    return run


def _settled(parts: DataFrame, unit: str, match: Matcher, core_bytes: int, group_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """core, part, runs of the parts whose core's group can be decided, and the cores whose group doesn't fit."""
    kinds = table(parts.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("copies").alias("held"), F.sum(F.length("segment")).alias("bytes")).where("held > 1"))
    fits = (F.col("kinds") > 1) & (F.col("bytes") <= core_bytes)
    total, crowded = kinds.agg(F.sum(F.when(fits, F.col("bytes"))), F.count_if((F.col("kinds") > 1) & ~fits)).first()
    whole = parts.join(kinds, "core")
    lone = whole.where("kinds = 1").select("core", "part", F.array(F.struct(F.lit(0).alias("off"), F.col("n").alias("len"), "doc", "pos")).cast(RUN).alias("runs"))
    groups = buckets(total or 0, group_bytes)
    some = whole.where(fits).drop("kinds", "held", "bytes").withColumn("group", F.pmod(F.xxhash64("core"), F.lit(groups)))
    few = some.groupBy("group").applyInPandas(_match_group(unit, match), f"core long, part binary, runs {RUN}")
    return lone.unionByName(few), kinds.where((F.col("kinds") > 1) & ~fits).select("core") if crowded else None


def repeated_spans(docs: DataFrame, unit: str, window: int, gram: int, match: Matcher, rule: Callable[[Column, Column, Column, Column], Column], core_bytes: int = 1 << 19, group_bytes: int = 2 << 20, fan_out: int = 8) -> DataFrame:
    """doc, tag, spans: for each document of docs (doc, text, tag: what tells rows of one doc apart) the spans
    (a, b: symbols) covered by repeated windows.

    rule(doc, pos, first doc, first pos) says which occurrences of a repeated window count.
    """
    docs = docs.where(F.col("doc").isNotNull() & F.col("text").isNotNull()).select("doc", "text", "tag")
    found = table(docs.mapInArrow(tidy(_find_runs(unit, window, gram)), "anchor long, doc long, tag long, x0 int, n int, dist int"))
    seen = table(found.groupBy("anchor").agg(F.count("*").alias("seen")).where("seen > 1").select("anchor"))
    by_doc = found.join(seen, "anchor").groupBy("doc", "tag").agg(F.collect_set(F.struct("x0", "n", "dist", "anchor")).alias("cuts"))
    cut = docs.join(by_doc, ["doc", "tag"]).select("doc", "tag", F.encode("text", "utf-8").alias("text"), "cuts")
    segments = table(cut.mapInArrow(tidy(_cut(unit, window)), _ddl(_SEGMENT)))

    first = F.min(F.struct("doc", "pos")).alias("first")
    kept = ["n", "dist", "copies", "first.doc", "first.pos", "segment"]
    counted = [F.first("n").alias("n"), F.first("dist").alias("dist"), F.sum("copies").alias("copies"), first, F.first("segment").alias("segment")]
    each = segments.select(F.col("anchor").alias("core"), F.col("key").alias("part"), "n", "dist", F.lit(1).alias("copies"), "doc", F.col("x0").cast("long").alias("pos"), "segment")
    parts = table(each.groupBy("core", "part").agg(*counted).select("core", "part", *kept))
    decided, crowded = _settled(parts, unit, match, core_bytes, group_bytes)
    runs = decided.select(F.col("core").alias("anchor"), F.col("part").alias("key"), "runs")
    rows, step = parts.withColumn("anchor", F.col("core")).withColumn("key", F.col("part")).withColumn("base", F.lit(0)), window - gram + 1
    deeper = []
    while crowded is not None:
        step = -(-step // fan_out)
        rows = rows.join(crowded, "core").select("anchor", "key", "base", "n", "dist", "copies", "doc", "pos", "segment")
        rows = table(rows.mapInArrow(_deal(unit, window, step), _ddl(_CELL)))
        parts = table(rows.groupBy("core", "part").agg(*counted).select("core", "part", *kept))
        decided, crowded = _settled(parts, unit, match, core_bytes, group_bytes)
        moved = F.transform("runs", lambda r: F.struct((r["off"] + F.col("base")).alias("off"), r["len"].alias("len"), r["doc"].alias("doc"), r["pos"].alias("pos")))
        deeper.append(rows.select("anchor", "key", "base", "core", "part").join(decided, ["core", "part"]).select("anchor", "key", moved.cast(RUN).alias("runs")))
    if deeper:
        joined = functools.reduce(DataFrame.unionByName, deeper).groupBy("anchor", "key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        runs = runs.unionByName(joined)

    def spans(r: Column) -> Column:
        a = F.col("x0") + r["off"]
        return F.struct(a.alias("a"), (a + r["len"] - 1 + window).alias("b"))

    counts = lambda r: rule(F.col("doc"), F.col("x0") + r["off"], r["doc"], r["pos"])
    hits = segments.select("anchor", "key", "doc", "tag", "x0").join(runs, ["anchor", "key"])
    hits = hits.select("doc", "tag", F.transform(F.filter("runs", counts), spans).alias("spans")).where(F.size("spans") > 0)
    return hits.groupBy("doc", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))
