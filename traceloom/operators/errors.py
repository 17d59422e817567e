"""Edit operations and the statistics built on them."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.letters import letters

OPS = "array<struct<op:string,pos:int,old:string,new:string>>"


def homopolymers(seqs: DataFrame, key: str, seq: str, least: int = 3) -> DataFrame:
    """key, start, end (exclusive), base of runs of at least `least` equal bases (gaps and islands)."""
    b = seqs.select(key, F.posexplode(F.split(seq, "")).alias("pos", "base"))
    isle = F.col("pos") - F.row_number().over(Window.partitionBy(key, "base").orderBy("pos"))
    runs = b.withColumn("isle", isle).groupBy(key, "base", "isle").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).select(key, "start", "end", "base")


def homopolymer_class(ops: DataFrame, runs: DataFrame, key: str = "cluster_id") -> DataFrame:
    """ops (key, read_no, no, op, pos, old, new) with `hp_class`: the effect on the first run of the ground truth that
    the operation touches, non_hp where it touches none, and `hp_length`, that run's length. Beside a run counts for
    insertions and substitutions."""
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    beside = (F.col("pos") == F.col("start") - 1) | (F.col("pos") == F.col("end"))
    grows = (F.col("op") == "ins") & (F.col("new") == F.col("base")) & (inside | beside)
    effect = F.when(grows, "hp_expansion").when(inside & (F.col("op") == "del"), "hp_contraction").when(inside, "hp_interruption").when(beside & (F.col("op") != "del"), "hp_boundary")
    touched = ops.join(runs, key, "left").withColumn("effect", effect)
    first = lambda c: F.min_by(c, F.when(F.col("effect").isNotNull(), F.col("start")))
    return touched.groupBy(key, "read_no", "no", "op", "pos", "old", "new").agg(F.coalesce(first("effect"), F.lit("non_hp")).alias("hp_class"), first(F.col("end") - F.col("start")).alias("hp_length"))


def _padded(texts: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text in a row of its own, filled up at the end, and the lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(size.max(initial=0))), filler, np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return out, size


def _moves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all pairs of rows of a and b at once, the last step of the best alignment of each two prefixes, [i, pair, j]:
    0 keeps or replaces a base, 1 deletes, 2 inserts. Of equally good steps the first counts."""
    pairs, m = b.shape
    along = np.arange(m + 1, dtype=np.int32)
    above = np.broadcast_to(along, (pairs, m + 1))
    moves = np.empty((a.shape[1] + 1, pairs, m + 1), np.int8)
    moves[0], moves[:, :, 0] = 2, 1
    for i in range(a.shape[1]):
        kept = above[:, :-1] + (b != a[:, i : i + 1])
        row = np.empty((pairs, m + 1), np.int32)
        row[:, 0] = i + 1
        np.minimum(kept, above[:, 1:] + 1, out=row[:, 1:])
        # What insertions reach from the left is a running minimum of the row less its place.
        row = np.minimum.accumulate(row - along, axis=1) + along
        moves[i + 1, :, 1:] = np.where(kept == row[:, 1:], 0, np.where(above[:, 1:] + 1 == row[:, 1:], 1, 2))
        above = row
    return moves


def edit_steps(gts: list[str], preds: list[str]) -> tuple[np.ndarray, ...]:
    """Operations that turn each gt into its pred: pair, kind (0 sub, 1 del, 2 ins), place, old and new code point,
    by pair and place. Walked back from the ends; where several are best, a kept base comes before a replaced
    one, then deletion, then insertion. An insertion's place is that of the base of gt that it precedes."""
    (a, i), (b, j) = _padded(gts, 0xFFFFFFFF), _padded(preds, 0xFFFFFFFE)
    moves, found = _moves(a, b), []
    live = np.flatnonzero(i + j)
    while len(live):
        move = moves[i[live], live, j[live]]
        i[live] -= move < 2
        j[live] -= move != 1
        old = np.where(move < 2, a[live, np.minimum(i[live], a.shape[1] - 1)] if a.shape[1] else 0, 0)
        new = np.where(move != 1, b[live, np.minimum(j[live], b.shape[1] - 1)] if b.shape[1] else 0, 0)
        edit = (move > 0) | (old != new)
        found.append(np.stack([live[edit], move[edit], i[live][edit], old[edit], new[edit]]))
        live = live[i[live] + j[live] > 0]
    steps = np.concatenate(found[::-1], axis=1) if found else np.zeros((5, 0), np.int64)
    return tuple(steps[:, np.argsort(steps[0], kind="stable")])


def _chunks(gts: list[str], preds: list[str], cells: int = 2 << 20) -> Iterator[np.ndarray]:
    """Rows of pairs of like length, so many that their tables hold about `cells`."""
    n = np.array([(len(a) + 1) * (len(b) + 1) for a, b in zip(gts, preds, strict=True)])
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and n[order[end]] * (end + 1 - at) <= cells:
            end += 1
        yield order[at:end]
        at = end


def _different(gt: pa.Array, pred: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
    """For each row its place among the batch's different pairs (-1: a side is null), and these pairs."""
    places: dict[tuple[str, str], int] = {}
    at = [-1 if a is None or b is None else places.setdefault((a, b), len(places)) for a, b in zip(gt.to_pylist(), pred.to_pylist(), strict=True)]
    return np.array(at, np.int64), [a for a, _ in places], [b for _, b in places]


_KINDS = pa.array(["sub", "del", "ins"])
_OP = pa.struct([("op", pa.string()), ("pos", pa.int32()), ("old", pa.string()), ("new", pa.string())])


def _listed(at: np.ndarray, steps: tuple[np.ndarray, ...], pairs: int) -> pa.Array:
    """The operations of each row as a list of structs."""
    pair, kind, pos, old, new = steps
    begin = np.searchsorted(pair, np.arange(pairs + 1))
    size = np.where(at < 0, 0, np.diff(begin)[at] if pairs else 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(ends[-1]) - np.repeat(ends[:-1] - (begin[at] if pairs else 0), size)
    letters, spelled = np.unique(np.concatenate([old, new]), return_inverse=True)
    letters = pa.array([chr(x) if x else None for x in letters.tolist()], pa.string())
    letter = lambda w: letters.take(pa.array(w[take]))
    values = pa.StructArray.from_arrays([_KINDS.take(pa.array(kind[take])), pa.array(pos[take].astype(np.int32)), letter(spelled[: len(old)]), letter(spelled[len(old) :])], fields=list(_OP))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=pa.array(at < 0))


def single_steps(gt: pa.Array, pred: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs differ by one operation at most, and these operations as `edit_steps` gives them: a walk back from the ends keeps all
    that is equal there, so the operation stands before the equal end."""
    (a, i), (b, j) = letters(gt), letters(pred)
    wide = max(a.shape[1], b.shape[1], 1)
    kept = lambda x, y: np.where((z := x != y).any(axis=1), z.argmax(axis=1), wide)
    pad = lambda x, right: np.pad(x, ((0, 0), (wide - x.shape[1], 0) if right else (0, wide - x.shape[1])))
    least = np.minimum(i, j)
    head = np.minimum(kept(pad(a, False), pad(b, False)), least)
    tail = np.minimum(kept(pad(letters(gt, True)[0], True)[:, ::-1], pad(letters(pred, True)[0], True)[:, ::-1]), least)
    known = np.asarray(gt.is_valid()) & np.asarray(pred.is_valid())
    exact = known & (i == j) & (tail == i)
    sub = known & ~exact & (i == j) & (head + tail + 1 >= i)
    gone, more = known & (i == j + 1) & (head + tail >= j), known & (j == i + 1) & (head + tail >= i)
    row = np.flatnonzero(sub | gone | more)
    kind = np.where(sub, 0, np.where(gone, 1, 2))[row]
    pos = (i - tail - ~more)[row]
    old = np.where(kind < 2, pad(a, False)[row, np.minimum(pos, wide - 1)], 0)
    new = np.where(kind != 1, pad(b, False)[row, np.minimum(pos, wide - 1)], 0)
    return exact | sub | gone | more, np.stack([row, kind, pos, old.astype(np.int64), new.astype(np.int64)])


def edit_operations(pairs: DataFrame, gt: str = "gt", pred: str = "read") -> DataFrame:
    """pairs with `ops` (null where a side is null). No built-in gives an alignment: pairs of one operation at most are
    known from their equal ends, other different pairs of an Arrow batch are aligned together, where they are. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in (gt, pred))
            near, steps = single_steps(a, b)
            rest = np.flatnonzero(~near)
            at, (own, gts, preds) = np.arange(batch.num_rows), _different(a.take(pa.array(rest)), b.take(pa.array(rest)))
            at[rest] = np.where(own < 0, -1, own + batch.num_rows)
            parts = [steps]
            for rows in _chunks(gts, preds):
                pair, *more = edit_steps([gts[k] for k in rows], [preds[k] for k in rows])
                parts.append(np.stack([rows[pair] + batch.num_rows, *more]))
            steps = np.concatenate(parts, axis=1)
            steps = steps[:, np.argsort(steps[0], kind="stable")]
            yield pa.RecordBatch.from_arrays([*batch.columns, _listed(at, tuple(steps), batch.num_rows + len(gts))], [*batch.schema.names, "ops"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, *StructType.fromDDL(f"ops {OPS}").fields]))


_CLASSES = ["non_hp", "hp_boundary", "hp_interruption", "hp_contraction", "hp_expansion"]


def homopolymer_counts(pairs: DataFrame, gt: str = "gt", pred: str = "read", least: int = 3) -> DataFrame:
    """what, op, hp_class, length, n, several rows each: `operation`, the operations that turn gt into pred, by type, class (as
    `homopolymer_class`) and length of the run (null: none); `run`, the runs of gt by length; `bases`, gt's symbols. Runs are looked up where
    the operations are found, so neither is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in (gt, pred))
            near, steps = single_steps(a, b)
            rest = np.flatnonzero(~near & np.asarray(a.is_valid()) & np.asarray(b.is_valid()))
            gts, preds, parts = a.take(pa.array(rest)).to_pylist(), b.take(pa.array(rest)).to_pylist(), [steps]
            for rows in _chunks(gts, preds):
                pair, *more = edit_steps([gts[k] for k in rows], [preds[k] for k in rows])
                parts.append(np.stack([rest[rows[pair]], *more]))
            row, kind, pos, _, new = np.concatenate(parts, axis=1)
            shown, size = letters(a)
            n, wide = shown.shape
            # Where the run of each place begins and ends; places past a text's end are one run of no length that counts.
            place, other = np.arange(wide), shown[:, 1:] != shown[:, :-1]
            start = np.maximum.accumulate(np.where(np.pad(other, ((0, 0), (1, 0)), constant_values=True)[:, :wide], place, 0), axis=1)
            end = np.minimum.accumulate(np.where(np.pad(other, ((0, 0), (0, 1)), constant_values=True)[:, :wide], place + 1, wide)[:, ::-1], axis=1)[:, ::-1]
            length = np.where(place < size[:, None], end - start, 0)
            hp, code = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            # The first run that an operation touches: one that ends before it, one that it stands in, one that begins behind it.
            for beside, at in ((-1, pos - 1), (0, pos), (1, pos + 1)):
                inside = (at >= 0) & (at < size[row])
                p = np.where(inside, at, 0)
                is_run = inside & (length[row, p] >= least) if wide else inside
                if not is_run.any():
                    continue
                if beside:
                    is_run &= (end[row, p] == pos) if beside < 0 else (start[row, p] == at)
                grows = (kind == 2) & (new == shown[row, p])
                effect = np.where(grows, 4, np.where(kind == 1, 0, 1) if beside else np.where(kind == 1, 3, 2))
                first = is_run & (effect > 0) & (code == 0)
                code[first], hp[first] = effect[first], length[row, p][first]
            own, times = np.unique(np.stack([kind, code, hp]), axis=1, return_counts=True) if len(row) else (np.zeros((3, 0), np.int64), np.zeros(0, np.int64))
            runs, many = np.unique(length[(start == place) & (length >= least)], return_counts=True)
            op = ["sub", "del", "ins"]
            made = [("operation", op[k], _CLASSES[c], h or None, t) for (k, c, h), t in zip(own.T.tolist(), times.tolist(), strict=True)]
            made += [("run", None, None, x, t) for x, t in zip(runs.tolist(), many.tolist(), strict=True)] + [("bases", None, None, None, int(size.sum()))]
            kinds = pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], ["what", "op", "hp_class", "length", "n"])

    each = pairs.select(gt, pred).mapInArrow(run, "what string, op string, hp_class string, length int, n long")
    return each.groupBy("what", "op", "hp_class", "length").agg(F.sum("n").alias("n"))


def _distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, known: np.ndarray) -> np.ndarray:
    """edit_distances of rows of code points and their lengths; known: the symbols of a."""
    pairs, words = len(i), -(-max(a.shape[1], 1) // 64)
    order = np.argsort(-j, kind="stable")
    a, b, longest = a[order], b[order], j[order]
    wide = np.zeros((pairs, 64 * words), a.dtype)
    wide[:, : a.shape[1]] = a
    # For each symbol a bit where a shows it, 64 places a word; the last is any other symbol's.
    shows = np.zeros((words, len(known) + 1, pairs), np.uint64)
    for s, symbol in enumerate(known):
        shows[:, s] = np.packbits(wide == symbol, axis=1, bitorder="little").view("<u8").T
    code = np.searchsorted(known, b)
    code = np.where(known[np.minimum(code, len(known) - 1)] == b, code, len(known)) if len(known) else np.zeros(b.shape, np.int64)
    at = np.ascontiguousarray((code * pairs + np.arange(pairs)[:, None]).T)
    up, down = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64)
    live = np.searchsorted(-longest, -np.arange(b.shape[1]), side="left")  # pairs whose b goes on
    one, top = np.uint64(1), np.uint64(63)
    flat = shows.reshape(words, -1)
    for step in range(b.shape[1]):
        k = live[step]
        plus, minus = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for w in range(words):
            same, pv, mv = flat[w].take(at[step, :k]), up[w, :k], down[w, :k]
            xv = same | mv
            same |= minus
            xh = (((same & pv) + pv) ^ pv) | same
            ph, mh = mv | ~(xh | pv), pv & xh
            out = ph >> top, mh >> top
            ph, mh = (ph << one) | plus, (mh << one) | minus
            plus, minus = out
            np.bitwise_or(mh, ~(xv | ph), out=up[w, :k])
            np.bitwise_and(ph, xv, out=down[w, :k])
    # Steps down the last column add up to the distance.
    size, found = i[order], longest.astype(np.int64)
    for w in range(words):
        bits = np.clip(size - 64 * w, 0, 64)
        mask = np.where(bits == 64, ~np.uint64(0), (one << (bits % 64).astype(np.uint64)) - one)
        found += np.bitwise_count(up[w] & mask).astype(np.int64) - np.bitwise_count(down[w] & mask).astype(np.int64)
    back = np.empty(pairs, np.int64)
    back[order] = found
    return back


def edit_distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = 1 << 16) -> np.ndarray:
    """Edit distance of each row of a and b (`letters`): a column of 64 places is one number that holds the steps down it (Myers), and
    all pairs go on by a symbol of b together."""
    known = np.flatnonzero(np.bincount(a[0].ravel(), minlength=1)) if a[0].dtype == np.uint8 else np.unique(a[0])
    rows = max(cells // max(a[0].shape[1] // 64 + 1, len(known) // 8), 1)
    parts = [_distances(a[0][k : k + rows], a[1][k : k + rows], b[0][k : k + rows], b[1][k : k + rows], known) for k in range(0, len(a[1]), rows)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def edit_distance(pairs: DataFrame, a: str, b: str, out: str = "d") -> DataFrame:
    """pairs with the edit distance of their columns a and b (null where a side is null), measured in Arrow batches where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in (a, b))
            none = ~(np.asarray(x.is_valid()) & np.asarray(y.is_valid()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edit_distances(letters(x), letters(y)).astype(np.int32), mask=none)], [*batch.schema.names, out])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField(out, IntegerType())]))


def differing_places(gt: pa.Array, pred: pa.Array) -> np.ndarray:
    """Places of each gt that its pred doesn't show alike; those past a pred's end are among them."""
    (a, i), (b, j) = letters(gt), letters(pred)
    both = min(a.shape[1], b.shape[1])
    within = np.arange(both) < np.minimum(i, j)[:, None]
    return ((a[:, :both] != b[:, :both]) & within).sum(axis=1) + np.maximum(i - j, 0)


def both_distances(pairs: DataFrame, gt: str, pred: str) -> DataFrame:
    """pairs with `lev`, the edit distance, and `ham`, the places of gt that pred doesn't show alike (null where a side is null), measured in
    Arrow batches where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in (gt, pred))
            none = ~(np.asarray(x.is_valid()) & np.asarray(y.is_valid()))
            made = edit_distances(letters(x), letters(y)), differing_places(x, y)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(d.astype(np.int64), mask=none) for d in made)], [*batch.schema.names, "lev", "ham"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("lev", LongType()), StructField("ham", LongType())]))


def differing_symbols(pairs: DataFrame, a: str, b: str, out: str = "d") -> DataFrame:
    """pairs with the number of places at which their columns a and b differ, a longer one's rest included (null where a side is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in (a, b))
            none = ~(np.asarray(x.is_valid()) & np.asarray(y.is_valid()))
            (s, i), (u, j) = letters(x), letters(y)
            both = min(s.shape[1], u.shape[1])
            within = np.arange(both) < np.minimum(i, j)[:, None]
            d = ((s[:, :both] != u[:, :both]) & within).sum(axis=1) + np.abs(i - j)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.astype(np.int64), mask=none)], [*batch.schema.names, out])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField(out, LongType())]))


def common_lengths(gts: list[str], preds: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair: rows of all pairs together, the best along a row is a running maximum."""
    out = np.zeros(len(gts), np.int32)
    for rows in _chunks(gts, preds):
        (a, _), (b, _) = _padded([gts[k] for k in rows], 0xFFFFFFFF), _padded([preds[k] for k in rows], 0xFFFFFFFE)
        best = np.zeros((len(rows), b.shape[1] + 1), np.int32)
        for i in range(a.shape[1]):
            best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], best[:, :-1] + (b == a[:, i : i + 1])), axis=1)
        out[rows] = best[:, -1]
    return out


def common_subsequence(pairs: DataFrame, gt: str = "gt", pred: str = "read") -> DataFrame:
    """pairs with `lcs` (null where a side is null), compared in Arrow batches where they are. A pair of one operation at most shares all of
    its shorter side but a replaced symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in (gt, pred))
            near, steps = single_steps(a, b)
            lcs = np.minimum(letters(a)[1], letters(b)[1]).astype(np.int32)
            lcs[steps[0][steps[1] == 0]] -= 1
            rest = np.flatnonzero(~near)
            at, gts, preds = _different(a.take(pa.array(rest)), b.take(pa.array(rest)))
            lcs[rest] = common_lengths(gts, preds)[at] if gts else 0
            none = np.zeros(batch.num_rows, bool)
            none[rest] = at < 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lcs, pa.int32(), mask=none)], [*batch.schema.names, "lcs"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("lcs", IntegerType())]))


def benjamini_hochberg(df: DataFrame, p: str = "p", family: tuple[str, ...] = ()) -> DataFrame:
    """df (one row a test) with adjusted p among the tests of each family. The rows are tests, never the data."""
    of = lambda *order: Window.partitionBy(*family).orderBy(*order)
    m = F.count("*").over(Window.partitionBy(*family))
    ranked = df.withColumn("_r", F.row_number().over(of(p))).withColumn("_q", F.col(p) * m / F.col("_r"))
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_q").over(of(F.desc("_r"))))).drop("_r", "_q")


def _log_chance(k: float, n: int, p: float) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p)


def _tail(k: int, n: int, p: float) -> float:
    """Chance of k or more of n. Terms fall from the mode on, so the tail on the far side of k from the mode is summed
    term by term until the rest can't count; its cost grows with the square root of n."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    if k <= n * p:
        return 1.0 - _tail(n - k + 1, n, 1 - p)
    ratio, term, total = p / (1 - p), 1.0, 1.0
    for x in range(k, n):
        term *= (n - x) / (x + 1) * ratio
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, exp(_log_chance(k, n, p)) * total)


def binomial_p(k: int, n: int, p: float, side: str = "two") -> float:
    """Exact binomial test at every n. side: greater (k or more), or two: all outcomes as unlikely as k."""
    if n == 0 or not 0 < p < 1:
        return 1.0
    if side == "greater":
        return _tail(k, n, p)
    mode = min(n, int((n + 1) * p))
    if k == mode:
        return 1.0
    if k > mode:  # the same test of the other outcome
        k, p, mode = n - k, 1 - p, min(n, int((n + 1) * (1 - p)))
    limit = _log_chance(k, n, p) + 1e-7
    lo, hi = mode, n + 1  # the first outcome above the mode that is as unlikely
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if mid > n or _log_chance(mid, n, p) <= limit else (mid + 1, hi)
    return min(1.0, _tail(n - k, n, 1 - p) + _tail(lo, n, p))
