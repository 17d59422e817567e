"""Column functions on sequences (strings over ACGT, optionally with gaps). All stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token vocabulary in id order (fixed values).
VOCABULARY = "ACGT-|:#"


def seeded(seed: str, *parts: Column) -> Column:
    """The order key of every random choice: md5 of the seed and the row's key, so it depends on no partitioning."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts)))


def fraction(seed: str, *parts: Column) -> Column:
    """A uniform number in [0, 1) from the same key."""
    return F.conv(F.substring(seeded(seed, *parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def strip_other(s: Column) -> Column:
    return F.regexp_replace(s, "[^ACTG]", "")


def only_bases(s: Column) -> Column:
    return s.rlike("^[ACGT]*$")


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGT]", "N"), "ACGT", "TGCA"))


def digits(s: Column) -> Column:
    return F.translate(s, "ACGT", "0123")


def bases(s: Column) -> Column:
    return F.translate(s, "0123", "ACGT")


def index_value(s: Column) -> Column:
    """Base-4 value of up to 31 bases."""
    return F.conv(digits(s), 4, 10).cast("long")


def base2(s: Column) -> Column:
    return F.lpad(F.conv(digits(s), 4, 2), 2 * F.length(s), F.lit("0"))


def encode(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.instr(F.lit(VOCABULARY), c) - 1)


def decode(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.substring(F.lit(VOCABULARY), i + 1, F.lit(1))), "")


def pad(s: Column, block: int) -> Column:
    """Padded with '#' to the block size; longer input raises."""
    return F.when(F.length(s) <= block, F.rpad(s, block, "#")).otherwise(F.raise_error(F.lit("longer than the block")))


def shift_pair(tokens: Column) -> tuple[Column, Column]:
    return F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens) - 1)


def hamming(gt: Column, pred: Column) -> Column:
    """Mismatches over the ground truth's length; a missing position is a mismatch."""
    pairs = F.zip_with(F.split(gt, ""), F.split(F.substring(pred, F.lit(1), F.length(gt)), ""), lambda a, b: F.when(a == b, 0).otherwise(1))
    return F.when(F.length(gt) == 0, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0), lambda n, x: n + x))


def trim_trailing(s: Column, base: str = "C") -> Column:
    return F.regexp_replace(s, f"{base}+$", "")


def trailing_run(s: Column, base: str = "C") -> Column:
    return F.length(s) - F.length(trim_trailing(s, base))


def remove_gaps(s: Column) -> Column:
    return F.translate(s, "-", "")


def context(s: Column, pos: Column, k: int) -> Column:
    """The k-mer centred at pos (from 0); null where it doesn't fit."""
    h = k // 2
    return F.when((pos >= h) & (pos + h < F.length(s)), F.substring(s, pos - h + 1, F.lit(k)))


def relative_bin(pos: Column, length: Column, bins: int = 10) -> Column:
    return F.least(F.floor(F.least(pos, length - 1) * bins / length), F.lit(bins - 1)).cast("int")


def one_hot(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.array(*(F.when(c == b, 1.0).otherwise(0.0).cast("float") for b in "ACGT")))


def pad_rows(hot: Column, length: int, both_sides: bool = False) -> Column:
    """One-hot rows filled up to `length` with rows of zeros, at the end or on both sides (the odd one at the end)."""
    zeros = lambda n: F.array_repeat(F.array(*[F.lit(0.0).cast("float")] * 4), n)
    left = length - F.size(hot)
    head = F.floor(left / 2).cast("int") if both_sides else F.lit(0)
    return F.concat(zeros(head), hot, zeros(left - head))


def one_hot_text(s: Column, length: int, both_sides: bool = False) -> Column:
    """`pad_rows` of `one_hot` as text, rows of four digits with a blank between them: symbols are replaced by their rows, no array is made."""
    shown = F.when(F.length(s) == 0, "N").otherwise(F.regexp_replace(s, "[^ACGT]", "N"))
    left = F.greatest(length - F.length(shown), F.lit(0))
    head = F.floor(left / 2).cast("int") if both_sides else F.lit(0)
    out = F.concat(F.repeat(F.lit("N"), head), shown, F.repeat(F.lit("N"), left - head))
    for symbol, row in zip("ACGTN", ("1000 ", "0100 ", "0010 ", "0001 ", "0000 "), strict=True):
        out = F.replace(out, F.lit(symbol), F.lit(row))
    return F.rtrim(out)


def unnest(s: Column, parts: int) -> Column:
    """The sequences that were interleaved position by position: every parts-th symbol, from each of the first places on."""
    symbols = F.split(s, "")
    every = lambda k: F.array_join(F.filter(symbols, lambda _, i: i % parts == k), "")
    return F.array(*(every(k) for k in range(parts)))


def nest(parts: Column) -> Column:
    """Interleave sequences position by position up to the shortest; tails follow in order."""
    shortest = F.array_min(F.transform(parts, lambda p: F.length(p)))
    woven = F.array_join(F.transform(F.when(shortest > 0, F.sequence(F.lit(1), shortest)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.transform(parts, lambda p: F.substring(p, i, F.lit(1))), "")), "")
    return F.concat(woven, F.array_join(F.transform(parts, lambda p: F.substring(p, shortest + 1, F.length(p))), ""))


def pack(reads: Column, gt: Column) -> Column:
    return F.concat(F.array_join(reads, "|"), F.lit(":"), gt)


def permute_packed(packed: Column, order: list[int]) -> Column:
    reads = F.split(F.split_part(packed, F.lit(":"), F.lit(1)), "\\|")
    return F.concat(F.array_join(F.array(*(reads[i] for i in order)), "|"), F.lit(":"), F.split_part(packed, F.lit(":"), F.lit(2)))


def reorder_packed(packed: Column, key) -> Column:
    """The packed reads by the key of their places (from 0), ties by place."""
    reads = F.split(F.split_part(packed, F.lit(":"), F.lit(1)), "\\|")
    keyed = F.array_sort(F.transform(reads, lambda r, i: F.struct(key(i).alias("k"), i.alias("i"), r.alias("r"))))
    return F.concat(F.array_join(F.transform(keyed, lambda x: x["r"]), "|"), F.lit(":"), F.split_part(packed, F.lit(":"), F.lit(2)))


# The words of few-shot prompts.
ONE_EXAMPLE, SOME_EXAMPLES, CORRECT = "\nHere is an example:\n", "\nHere are some examples:\n", "\nCorrect output:\n"


def worked_example(packed: Column) -> Column:
    """A packed example `r1|r2:gt` as text: its reads as a numbered list, then the right output."""
    listed = F.transform(F.split(F.split_part(packed, F.lit(":"), F.lit(1)), "\\|"), lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))
    return F.concat(F.array_join(listed, "\n"), F.lit(CORRECT), F.split_part(packed, F.lit(":"), F.lit(2)))


def few_shot(examples: Column) -> Column:
    """Worked examples as one prompt, under a heading for one or for several."""
    return F.concat(F.when(F.size(examples) == 1, ONE_EXAMPLE).otherwise(SOME_EXAMPLES), F.array_join(examples, "\n"))


def answer(s: Column) -> Column:
    return F.regexp_extract(s, r"\*\*\*(.*?)\*\*\*", 1)
