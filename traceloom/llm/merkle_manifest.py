"""Operator 13: a Merkle manifest of a data set, with versions by path copying."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import buckets, read, table

#: Children of a node, and levels that are built inside one block of nodes. The first is part of the digests' definition.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
DIGEST = 64


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


class Block:
    """The lower `levels` levels of an aligned block of nodes. A version shares all nodes with the base but its own copies."""

    def __init__(self, nodes: list[str], levels: int):
        self.levels = [nodes]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])

    def siblings(self, at: int) -> str:
        """The other nodes of each run on the way from node `at` to the top, level by level, left to right."""
        out = []
        for below in self.levels[:-1]:
            run = at // FAN * FAN
            out += below[run:at] + below[at + 1 : run + FAN]
            at //= FAN
        return "".join(out)

    def version(self, at: int, node: str) -> list[str]:
        """The copied path of the version in which `node` stands at `at`: one node a level, the last is its top."""
        path = [node]
        for below in self.levels[:-1]:
            run = at // FAN * FAN
            path.append(digest("".join([*below[run:at], path[-1], *below[at + 1 : run + FAN]])))
            at //= FAN
        return path


def fold(node: str, place: int, siblings: str, runs: list[int]) -> str:
    """The top of the version whose node at the lowest level is `node`: siblings as Block gives them, `runs` the size of the
    run at each level, `place` the node's position at the lowest."""
    used = 0
    for run in runs:
        own = place % FAN
        others = siblings[used : used + DIGEST * (run - 1)]
        node = digest(others[: DIGEST * own] + node + others[DIGEST * own :])
        used, place = used + DIGEST * (run - 1), place // FAN
    return node


def _levels(nodes: int) -> int:
    """How many levels stand over this many nodes until one is left."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // FAN), n + 1
    return n


def _tops(of: pa.Table) -> pa.Table:
    """The top node of one block."""
    of = of.sort_by("at")
    g, block, nodes = of["g"][0].as_py(), of["block"][0].as_py(), of["nodes"][0].as_py()
    top = Block(of["node"].to_pylist(), min(LEVELS, _levels(nodes))).levels[-1][0]
    return pa.table({"g": pa.array([g], pa.binary()), "pos": pa.array([block], pa.int64()), "nodes": pa.array([-(-nodes // BLOCK)], pa.int64()), "node": pa.array([top])})


_WAY = "siblings string, runs array<int>, place long, subroot string"


def _ways_on(of: pa.Table, above: pa.Table) -> pa.Table:
    """For each node of a block its way to the root: the siblings in the block, then those of the block's top."""
    of = of.sort_by("at")
    block = Block(of["node"].to_pylist(), min(LEVELS, _levels(of["nodes"][0].as_py())))
    up = above.to_pylist()[0]
    ways: dict[str, list] = {"siblings": [], "runs": [], "place": []}
    for at in range(of.num_rows):
        ways["siblings"].append(block.siblings(at) + up["siblings"])
        ways["runs"].append([min(FAN, len(below) - at // FAN ** (k + 1) * FAN) for k, below in enumerate(block.levels[:-1])] + up["runs"])
        ways["place"].append(up["place"] * FAN ** (len(block.levels) - 1) + at)
    kinds = {"siblings": pa.string(), "runs": pa.list_(pa.int32()), "place": pa.int64()}
    return pa.table({"g": of["g"], "pos": of["pos"], **{k: pa.array(v, kinds[k]) for k, v in ways.items()}, "subroot": pa.array([up["subroot"]] * of.num_rows, pa.string())})


def _verify(root: str):
    """Rows of one block of leaves with their proofs. A row's leaf, changed or not, makes a version that copies its path in the
    block and goes on above it."""

    def run(of: pa.Table, above: pa.Table) -> pa.Table:
        of = of.sort_by("at")
        block = Block(of["node"].to_pylist(), min(LEVELS, _levels(of["nodes"][0].as_py())))
        up = above.to_pylist()[0]
        proof, folded = [], []
        for at, leaf in enumerate(of["changed"].to_pylist()):
            proof.append(digest(block.siblings(at) + up["siblings"]))
            folded.append(fold(block.version(at, leaf)[-1], up["place"], up["siblings"], up["runs"]))
        same = [pa.array([v] * of.num_rows, pa.string()) for v in (up["subroot"], root)]
        return pa.table({"doc_id": of["doc_id"], "leaf": of["node"], "subroot": same[0], "root": same[1], "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]})

    return run


def _placed(df: DataFrame, order: list[str], rows: int, part_rows: int = 100_000) -> DataFrame:
    """df (g: group) with pos, the rank from 0 within g by `order`, and nodes, the group's size. Rows are sorted in ranges of
    (g, order), so a group may span many tasks; the counts of the ranges before are added."""
    keys = ["g", *order]
    parts = max(buckets(rows, part_rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = table(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    ranged = ranged.withColumn("_part", part).withColumn("_own", own)
    held = ranged.groupBy("g", "_part").agg(F.count("*").alias("_n"), F.min("_own").alias("_first"))
    # A group has one row here for each range that it spans.
    before = F.expr("sum(_n) over (partition by g order by _part rows between unbounded preceding and current row) - _n")
    held = held.select("g", "_part", "_first", before.alias("_before"), F.expr("sum(_n) over (partition by g)").alias("nodes"))
    return ranged.join(held, ["g", "_part"]).withColumn("pos", F.col("_own") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_own", "_first", "_before")


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("at", F.col("pos") % BLOCK)


def _grown(leaves: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes under each round of blocks, lowest first, and g, node of the groups' tops. `most`: size of the largest group."""
    rounds, nodes = [], leaves
    while True:
        rounds.append(nodes)
        schema = "g binary, pos long, nodes long, node string"
        nodes = table(_blocked(nodes.select("g", "pos", "nodes", "node")).groupBy("g", "block").applyInArrow(_tops, schema))
        most = -(-most // BLOCK)
        if most <= 1:
            return rounds, nodes.select("g", "node")


def _ways(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """g, pos and the way to the root of each node of the first of these rounds. From the top down, each round takes what is over
    a block to its nodes, so that two sides meet by block and a group of any size is spread. above: g, block (0) and
    the way of each group's top."""
    for nodes in reversed(rounds):
        of = _blocked(nodes.select("g", "pos", "nodes", "node"))
        met = of.groupBy("g", "block").cogroup(above.groupBy("g", "block"))
        above = table(met.applyInArrow(_ways_on, f"g binary, pos long, {_WAY}")).withColumnRenamed("pos", "block")
    return above


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def merkle_manifest(docs: DataFrame, changed: Column) -> DataFrame:
    """A leaf for each row of docs (doc_id, source, lang, n_chars, text), a tree of runs of 16 for each source over its leaves
    in order of doc_id (null first; rows of one doc_id by digest), a tree over the sources' tops (null first, by bytes), and
    for each row the digest of its siblings and the root that its leaf and they give. Where `changed` holds, that leaf is of
    the row with the text's A-Z in lower case.

    Leaves are ranked in ranges, so a source of any size spreads over tasks. Nodes are built in aligned blocks of 256:
    a changed leaf's version copies its path in the block and shares the rest, and goes on through the siblings of
    the blocks above, which come down once a block and not once a leaf. Returns doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified. Null fields count as `-`. A null text and a text without A-Z stay as they are. Repeated rows
    are a leaf each. An empty table gives an empty result. Other columns are ignored.
    """
    own = docs.select("doc_id", "source", "lang", "n_chars", F.col("text").cast("string").alias("text"), F.coalesce(changed, F.lit(False)).alias("hit"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    head = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf, changed_leaf = (F.sha2(F.concat(*head, _field(t)).cast("binary"), 256) for t in (F.col("text"), lower))
    g = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).cast("binary")
    leaves = own.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("node"), F.when(F.col("hit"), changed_leaf).alias("changed"))
    # The last key parts rows that are equal, of which a range could otherwise get any number.
    leaves = table(leaves.withColumn("changed", F.coalesce("changed", "node")).withColumn("tie", F.monotonically_increasing_id()))
    leaves = table(_placed(leaves, ["doc_id", "node", "tie"], leaves.count()).drop("tie"))
    rounds, tops = _grown(leaves, leaves.agg(F.max("nodes")).first()[0] or 0)

    sources = tops.count()
    upper = table(_placed(tops.select(F.lit(b"").alias("g"), F.col("g").alias("source"), "node"), ["source"], sources))
    over, root = _grown(upper, sources)
    start = root.select("g", F.lit(0).cast("long").alias("block"), F.lit("").alias("siblings"), F.array().cast("array<int>").alias("runs"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("subroot"))
    high = _ways(over, start).select(F.col("block").alias("pos"), "siblings", "runs", "place")
    high = upper.join(high, "pos").select(F.col("source").alias("g"), F.lit(0).cast("long").alias("block"), "siblings", "runs", "place", F.col("node").alias("subroot"))
    ways = _ways(rounds[1:], high)
    found = root.first()
    return _blocked(leaves).groupBy("g", "block").cogroup(ways.groupBy("g", "block")).applyInArrow(_verify(found["node"] if found else ""), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return merkle_manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: one step a bit, a character's code joins before its first."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def _oracle(levels: int = 6, top_levels: int = 4) -> str:
    """The same as SQL, for up to 16^levels leaves a source and 16^top_levels sources."""
    field = lambda e: f"coalesce(strlen({e})::varchar || ':' || ({e}), '-')"
    head = " || ".join(field(f"{c}::varchar") for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [f"""d AS (SELECT doc_id, coalesce('s' || source, '') AS g, sha256({head} || {field("text")}) AS h,
  sha256({head} || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low, coalesce({_crc32_sql("doc_id::varchar")} % 5 = 0, false) AS hit FROM documents)""", "a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, doc_id, CASE WHEN hit THEN low ELSE h END AS changed FROM d)"]

    def grow(name: str, n: int) -> None:
        for k in range(n):
            parts.append(f"{name}r{k} AS (SELECT g, pos // {FAN} AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM (SELECT g, pos, h, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY ALL)")
            parts.append(f"{name}{k + 1} AS (SELECT g, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")

    grow("a", levels)
    parts.append(f"b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, g AS source FROM a{levels})")
    grow("b", top_levels)
    parts.append("w AS (SELECT a0.doc_id, a0.h AS leaf, a0.changed AS node, a0.pos, a0.g, b0.pos AS top, b0.h AS subroot, '' AS proof FROM a0 JOIN b0 ON a0.g = b0.source)")
    last = "w"
    for name, pos, n in (("a", "pos", levels), ("b", "top", top_levels)):
        for k in range(n):
            own = f"({last}.{pos} // {FAN**k} % {FAN})"
            before, after = f"hs[1:{own}]", f"hs[{own} + 2:]"
            join = f"r.run = {last}.{pos} // {FAN ** (k + 1)}" + (f" AND r.g = {last}.g" if name == "a" else "")
            parts.append(f"w{name}{k} AS (SELECT doc_id, leaf, CASE WHEN r.n = 1 THEN node ELSE sha256(array_to_string(list_concat({before}, [node], {after}), '')) END AS node, pos, {last}.g AS g, top, subroot, CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string(list_concat({before}, {after}), '') END AS proof FROM {last} JOIN {name}r{k} r ON {join})")
            last = f"w{name}{k}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, (SELECT h FROM b{top_levels}) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT h FROM b{top_levels}) AS verified FROM {last}"


ORACLE = _oracle()
