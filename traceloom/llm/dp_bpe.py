"""Operator 9: exact byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import read, tidy

#: Bytes of parts and their ids that a worker remembers, over its partitions; when full, the memory starts anew.
REMEMBERED = 150_000_000
#: Bytes that a remembered part takes beside its characters.
_EACH = 150
#: White space as the vocabulary's splitter has it (fixed by Unicode's White_Space property).
_WS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The splitter of byte-level BPE vocabularies (fixed by the vocabulary).
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Coarser cuts at which the splitter always cuts too.
_PARTS = rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: White space and a blank: there, what the splitter does at the blank depends on more than what follows it.
_BEFORE_BLANK = [w + " " for w in _WS]
_open: dict = {}


def byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Automaton:
    """The vocabulary's tokens as one automaton over bytes with suffix links: after each byte its state is the longest
    suffix of what was read that begins a token, and `token` and `shorter` lead through all tokens that
    end there, the longest first. Every byte is a token, so there is always one."""

    def __init__(self, tokens: dict[bytes, int]):
        self.step: dict[int, int] = {}
        token = [-1]
        for raw, number in tokens.items():
            state = 0
            for byte in raw:
                key = state << 8 | byte
                state = self.step.get(key, 0)
                if not state:
                    state = self.step[key] = len(token)
                    token.append(-1)
            token[state] = number
        # States were numbered along each token; suffix links need them by depth.
        link, layer = [0] * len(token), [0]
        below: dict[int, list[tuple[int, int]]] = {}
        for key, state in self.step.items():
            below.setdefault(key >> 8, []).append((key & 255, state))
        shorter = [0] * len(token)
        while layer:
            deeper = []
            for state in layer:
                for byte, child in below.get(state, ()):
                    deeper.append(child)
                    if state:
                        back = link[state]
                        while back and back << 8 | byte not in self.step:
                            back = link[back]
                        link[child] = self.step.get(back << 8 | byte, 0)
                    shorter[child] = link[child] if token[link[child]] >= 0 else shorter[link[child]]
            layer = deeper
        self.token, self.link, self.shorter = token, link, shorter


class Encoder:
    """The last token of the encoding of each prefix is unique. A token that ends a prefix is that token if and
    only if it is compatible with the last token of the prefix before it, so one pass over the
    matches of the vocabulary's automaton and a walk back give the ids that merging gives."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_characters()
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(of[c] for c in t) for t, i in vocabulary.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        #: The same by ids as they are written in decimal.
        self.written = {str(i).encode(): raw for i, raw in self.bytes_of.items()}
        # Tokens are numbered by the order in which merging makes them: bytes first, then merges.
        number = {c: k for k, c in enumerate(of)}
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * len(number)
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a + b not in number:
                number[a + b] = len(self.halves)
                self.halves.append((number[a], number[b]))
            self.pair.setdefault((number[a], number[b]), number[a + b])
        self.id_of = [str(vocabulary[t]).encode() for t in number]
        self.automaton = Automaton({bytes(of[c] for c in t): k for t, k in number.items()})
        self.size = [len(t) for t in number]
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.split = regex.compile(_SPLIT).findall
        self.parts = regex.compile(_PARTS).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        #: Ids of words with the blank before them, and of other parts.
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.held = 0

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one side of `token` while it is made, each with the merge that takes it up."""
        known = self.edges[side]
        if token not in known:
            chain, by, at = [], 1 << 60, token
            while True:
                chain.append((at, by))
                if self.halves[at] is None:
                    break
                at, by = self.halves[at][side], at
            known[token] = chain
        return known[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the tokens a and b apart. Any merge across the border would join a token at the end
        of a with one at the start of b while both stand there: before the merges inside a and b take them up.
        Of one merge at several places the leftmost comes first, so one in a comes before one across, and
        one across before one in b."""
        for x, taken in self._edge(a, 1):
            for y, given in self._edge(b, 0):
                made = self.pair.get((x, y))
                if made is not None and made < taken and made <= given:
                    return False
        return True

    def encode(self, raw: bytes) -> list[int]:
        """Tokens of one split part."""
        fits, size, step = self.fits, self.size, self.automaton.step
        token, link, shorter = self.automaton.token, self.automaton.link, self.automaton.shorter
        last, state, end = [-1], 0, 0
        for byte in raw:
            end += 1
            to = step.get(state << 8 | byte)
            while to is None:
                state = link[state]
                to = step.get(state << 8 | byte)
            state = at = to
            while True:
                t = token[at]
                if t >= 0:
                    start = end - size[t]
                    if start == 0:
                        break
                    before = last[start]
                    good = fits.get(before << 20 | t)
                    if good is None:
                        if len(fits) > 1_000_000:
                            fits.clear()
                        good = fits[before << 20 | t] = self.compatible(before, t)
                    if good:
                        break
                at = shorter[at]
            last.append(t)
        out = []
        while end:
            out.append(last[end])
            end -= size[last[end]]
        return out[::-1]

    def _learn(self, part: str) -> bytes:
        """The ids of a part in decimal, joined by commas."""
        return b",".join([self.id_of[t] for piece in self.split(part) for t in self.encode(piece.encode())])

    def _known(self, memory: dict[str, bytes], items: list[str], blank: str) -> None:
        new = set(items).difference(memory)
        if new:
            if self.held > REMEMBERED:
                self.plain.clear()
                self.spaced.clear()
                self.held, new = 0, set(items)
            for item in new:
                ids = memory[item] = self._learn(blank + item)
                self.held += _EACH + len(item) + len(ids)

    def piece(self, text: str) -> bytes:
        """Ids of a text without special tokens. Where white space is never followed by a blank, the
        splitter cuts before each blank, so a text is its blank-separated items, each worked once."""
        if any(pair in text for pair in _BEFORE_BLANK):
            parts, items, csv = self.parts(text), [], []
        else:
            head, *items = text.split(" ")
            parts = self.parts(head)
        self._known(self.plain, parts, "")
        csv = list(map(self.plain.__getitem__, parts))
        self._known(self.spaced, items, " ")
        csv += map(self.spaced.__getitem__, items)
        return b",".join(csv)

    def document(self, text: str) -> bytes:
        """The ids of a text in decimal, joined by commas."""
        if not (self.cut and any(t in text for t in self.special)):
            return self.piece(text) if text else b""
        found = []
        for piece in self.cut(text):
            if piece in self.special:
                found.append(str(self.special[piece]).encode())
            elif piece:
                found.append(self.piece(piece))
        return b",".join(found)

    def decode(self, csv: bytes) -> str:
        """The text of ids in decimal, joined by commas. What is no UTF-8 becomes replacement characters; ids that
        the vocabulary lacks give nothing."""
        if not csv:
            return ""
        ids = csv.split(b",")
        try:
            raw = b"".join(map(self.written.__getitem__, ids))
        except KeyError:
            raw = b"".join([self.written.get(i, b"") for i in ids])
        return raw.decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def _run(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                csv = e.document(batch.column(1)[i].as_py() or "")
                text = e.decode(csv)
                row = (csv.count(b",") + 1 if csv else 0, hashlib.sha256(csv).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                for c, v in zip(out, (*row, [int(x) for x in csv.split(b",")] if keep and csv else [], text if keep else None), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
            cols = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols if keep else cols[:4], names if keep else names[:4])

    return run


def bpe_round_trip(docs: DataFrame, vocabulary: str, keep: bool = True) -> DataFrame:
    """Encode every text of docs (doc_id long, text string) with a byte-level BPE vocabulary file and decode it.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 and, with keep, ids
    (array of int) and decoded (string). Null or empty text: no ids, empty text. Special tokens' strings
    in a text become their ids. Repeated rows and null doc_ids pass through. An empty table gives an empty
    result. Each row is worked alone, so nothing is shuffled and no group can be too large.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(tidy(_run(vocabulary, keep)), schema + ", ids array<int>, decoded string" * keep)


def _back(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [None if ids is None else e.decode(b",".join([str(i).encode() for i in ids if i is not None])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def bpe_decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """The texts of ids: tokens (doc_id long, ids array of int) become doc_id, text, as by the vocabulary's byte-level decoder.

    Null ids: null text; no ids: empty text; nulls among ids and ids that the vocabulary lacks give nothing; bytes that are
    no UTF-8 become replacement characters. Repeated rows and null doc_ids pass through, an empty table gives an
    empty result. Each row is worked alone.
    """
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(tidy(_back(vocabulary)), "doc_id long, text string")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_dp_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents"), byte_vocabulary(), keep=False)
