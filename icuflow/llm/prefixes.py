"""Conversation prefix trie by a splitter skeleton.

A conversation is the path of its turns, each turn 16 bytes of a hash, so paths compare as byte strings and a prefix stands before
all that it begins. Rows are cut into shards by splitters, (path, conv_id) pairs drawn from a sample, so copies of one path may spread over shards.
A node whose members lie in several shards is a prefix of a splitter between them: the trie of the splitters' paths, the skeleton, is broadcast, and every shard,
read in order with one open node per depth, finishes all nodes outside it. For a node of the skeleton each shard has a partial
aggregate; Spark adds them up, and the sums over subtrees are taken along the skeleton, whose size is bounded.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.llm.batches import small_batches
from icuflow.sources.tables import stage

TURN = 16  # bytes of a turn in a path
SHARD_ROWS, MOST_SHARDS = 100_000, 4_000
DRAWN = 10  # sampled rows per shard
DEEPEST = 128  # turns of a splitter
IDS = 4_096  # ids in a row of a node's ends
BATCH = 5_000
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
FOUND = f"node int, shard int, part int, above int, size long, ids string, {NODE}, ends_sha256 string"
FIELDS = {name: {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[kind] for name, kind in (f.split() for f in FOUND.split(", "))}


def swapped(conv_id: Column) -> Column:
    """How many first turns a conversation takes from another one: crc32 of the decimal id, modulo 9."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): hashes of the turns one after the other, and the UTF-8 bytes of each text.

    Turns stand in order of turn, then role and text hash; null turns come first. Texts don't leave the scan.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    narrow = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    own = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.unhex(F.array_join(F.transform("t.key", F.hex), "")).alias("path"), F.col("t.size").alias("sizes"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation with its first turns replaced by the original ones of conversation c - c % 5: all it has if fewer, none if absent.

    The remainder has the sign of the id, so negative ids look towards zero.
    """
    base = convs.select(F.col("conv_id").alias("_base"), F.col("path").alias("_path"), F.col("sizes").alias("_sizes")).where("_base % 5 = 0")
    h = swapped(F.col("conv_id"))
    joined = convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 5).join(base, "_base", "left")
    rest = F.slice("sizes", h + 1, F.greatest(F.size("sizes") - h, F.lit(0)))
    head = F.coalesce(F.slice("_sizes", F.lit(1), h), F.array().cast("array<long>"))
    first = F.coalesce(F.substring("_path", F.lit(1), h * TURN), F.lit(b""))
    return joined.select(
        "conv_id", F.concat(first, F.substring("path", h * TURN + 1, F.octet_length("path"))).alias("path"), F.concat(head, rest).alias("sizes"))


@dataclass
class Skeleton:
    """Splitters in order, and the trie of their paths. Nodes are numbered from the root in the order of their paths, so parents come first."""

    splitters: list[tuple[bytes, int]]
    number: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])

    def __post_init__(self):
        for path, _ in self.splitters:
            at = 0
            for turn in turns_of(path):
                if (at, turn) not in self.number:
                    self.number[at, turn] = len(self.parent)
                    self.parent.append(at)
                at = self.number[at, turn]

    def along(self, path: bytes) -> list[int]:
        """Nodes of the skeleton on the path, from the root."""
        found = [0]
        for turn in turns_of(path):
            at = self.number.get((found[-1], turn))
            if at is None:
                break
            found.append(at)
        return found


def turns_of(path: bytes) -> Iterator[bytes]:
    return (path[i : i + TURN] for i in range(0, len(path), TURN))


def skeleton(rows: DataFrame, shards: int, drawn: int = DRAWN) -> Skeleton:
    """Splitters at even steps through a sample of rows, the first by a hash of the id.

    At most ``shards * drawn`` sampled paths, cut after ``DEEPEST`` turns, reach the driver, and the skeleton has at most
    ``shards * DEEPEST`` nodes. A splitter that is cut doesn't look at ids.
    """
    cut = F.substring("path", F.lit(1), F.lit(DEEPEST * TURN))
    whole = F.when(F.octet_length("path") <= DEEPEST * TURN, F.col("conv_id"))
    some = rows.select(F.xxhash64(F.lit("skeleton"), "conv_id").alias("draw"), cut.alias("path"), whole.alias("id")).orderBy("draw").limit(shards * drawn)
    found = sorted((bytes(r.path), -(1 << 63) if r.id is None else r.id) for r in some.select("path", "id").collect()) if shards > 1 else []
    return Skeleton(sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else [])


class Open:
    """A node with members still to come; ``number`` if it is in the skeleton. Children wait for the smallest member of a node outside it."""

    __slots__ = ("number", "least", "members", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, number: int | None, least: int):
        self.number, self.least, self.members, self.children, self.leaves, self.saved = number, least, 0, 0, 0, 0
        self.ends, self.waiting = None, []


class Shard:
    """Reads a shard's rows in order; ``rows`` gets finished nodes, and for the skeleton's nodes partial aggregates and ends.

    The open nodes make one path. A partial aggregate counts all members in the shard, but children, leaves and savings only of nodes
    outside the skeleton that hang on the node itself.
    """

    def __init__(self, trie: Skeleton, number: int = 0):
        self.trie, self.shard, self.last, self.rows = trie, number, None, []
        self.stack: list[Open] = []
        self.sizes: list[int] = []
        self.ids: list[str] = []
        self.part = 0

    def add(self, path: bytes, sizes: list[int], conv_id: int) -> None:
        if path != self.last:
            self.send_ids()
            kept = 0 if self.last is None else common_turns(self.last, path) + 1
            while len(self.stack) > kept:
                self.close()
            known = self.trie.along(path)
            for depth in range(len(self.stack), len(path) // TURN + 1):
                self.stack.append(Open(known[depth] if depth < len(known) else None, conv_id))
            self.last, self.sizes = path, [0, *sizes]
        top = self.stack[-1]
        top.members += 1
        top.least = min(top.least, conv_id)
        if top.number is not None:
            self.ids.append(str(conv_id))
            if len(self.ids) == IDS:
                self.send_ids()
        elif top.ends is None:
            top.ends = hashlib.sha256(str(conv_id).encode())
        else:
            top.ends.update(f",{conv_id}".encode())

    def send_ids(self) -> None:
        if self.ids:
            self.rows.append({"node": self.stack[-1].number, "shard": self.shard, "part": self.part, "ids": ",".join(self.ids)})
            self.part, self.ids = self.part + 1, []

    def close(self) -> None:
        """Finish the deepest open node."""
        depth = len(self.stack) - 1
        node, size = self.stack.pop(), self.sizes[depth]
        above = self.stack[-1] if self.stack else None
        if above:
            above.members, above.least = above.members + node.members, min(above.least, node.least)
        row = {"conv_id": node.least, "depth": depth, "n_convs": node.members, "n_children": node.children}
        if node.number is not None:
            self.rows.append({**row, "node": node.number, "size": size, "n_leaves": node.leaves, "saved_tokens": node.saved})
            return
        saved, leaves = node.saved + (node.members - 1) * size, node.leaves or 1
        self.rows += [{**below, "parent_conv_id": node.least} for below in node.waiting]
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        row |= {"n_leaves": leaves, "saved_tokens": saved, "ends_sha256": node.ends.hexdigest() if node.ends else NONE}
        if above.number is None:
            above.waiting.append(row)
        else:
            self.rows.append({**row, "above": above.number})

    def finish(self) -> None:
        self.send_ids()
        while self.stack:
            self.close()


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that both paths begin with."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * TURN] == b[: mid * TURN] else (low, mid - 1)
    return low


def sharded(rows: DataFrame, trie: Skeleton) -> DataFrame:
    """What :class:`Shard` finds in all shards; Spark sorts each, and it is read as a stream."""
    shared = rows.sparkSession.sparkContext.broadcast(trie)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect_right(shared.value.splitters, key) for key in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=["conv_id", "path", "sizes", "shard"])

    def packed(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], kind) for n, kind in FIELDS.items()], names=list(FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Shard(shared.value)
        for batch in batches:
            for conv_id, path, sizes, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != one.shard:
                    one.finish()
                    held, one = one.rows, Shard(shared.value, shard)
                    one.rows = held
                one.add(path, sizes, conv_id)
                if len(one.rows) >= BATCH:
                    yield packed(one.rows)
                    one.rows = []
        one.finish()
        yield packed(one.rows)

    cut = small_batches(rows.select("conv_id", "path", "sizes")).mapInArrow(place, "conv_id long, path binary, sizes array<long>, shard int")
    dealt = cut.repartitionById(len(trie.splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    return dealt.mapInArrow(run, FOUND)


def ends(found: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the skeleton's nodes at which conversations end: the digest runs over a node's ids as a stream, ``IDS`` a row."""
    rows = found.where("ids is not null").select("node", "shard", "part", "ids").repartition("node").sortWithinPartitions("node", "shard", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((node, ids) for b in batches for node, ids in zip(b.column(0).to_pylist(), b.column(3).to_pylist()))
        for node, parts in groupby(each, lambda row: row[0]):
            digest = hashlib.sha256(next(parts)[1].encode())
            for _, ids in parts:
                digest.update(f",{ids}".encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int32()), "ends_sha256": [digest.hexdigest()]})

    return rows.mapInArrow(run, "node int, ends_sha256 string")


def reduced(found: DataFrame, trie: Skeleton) -> DataFrame:
    """The skeleton's nodes: partial aggregates added up by Spark, then along the skeleton, whose size is bounded."""
    sums = found.where("node is not null and ids is null").groupBy("node").agg(
        F.min("conv_id").alias("least"), F.first("depth").alias("depth"), F.first("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()
    of = {r.node: r for r in sums}
    children = {n: of[n].n_children for n in of}
    for n in of:
        if trie.parent[n] >= 0:
            children[trie.parent[n]] += 1
    leaves = {n: of[n].n_leaves + (not children[n]) for n in of}
    saved = {n: of[n].saved_tokens + (of[n].n_convs - 1) * of[n].size for n in of}
    for n in sorted(of, reverse=True)[:-1]:
        leaves[trie.parent[n]] += leaves[n]
        saved[trie.parent[n]] += saved[n]
    rows = [(n, r.least, r.depth, of[trie.parent[n]].least if n else None, r.n_convs, children[n], leaves[n], saved[n]) for n, r in of.items()]
    return found.sparkSession.createDataFrame(rows, f"node int, {NODE}")


def prefix_trie(turns: DataFrame, shards: int | None = None, drawn: int = DRAWN) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations, see :func:`rebuilt` for these.

    A null role or text is empty. Turns that tie stand in the order of a hash, repeated rows are repeated turns, rows without conv_id belong to no
    conversation. A conversation is one row of 24 bytes a turn. An empty table gives no rows; further columns are not read.
    Without ``shards`` there is one for each SHARD_ROWS conversations, at least as many as shuffle partitions, MOST_SHARDS at most.
    """
    rows = stage(rebuilt(paths(turns)), "paths")
    n = rows.count()
    if shards is None:
        shards = min(MOST_SHARDS, max(-(-n // SHARD_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    trie = skeleton(rows, min(shards, n), drawn)
    found = stage(sharded(rows, trie), "trie")
    top = reduced(found, trie)  # the skeleton: MOST_SHARDS * DEEPEST rows at most
    names = [f.split()[0] for f in NODE.split(", ")]
    tops = top.join(ends(found), "node", "left").select(*names, F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
    nodes = found.where("node is null").join(F.broadcast(top.select(F.col("node").alias("above"), F.col("conv_id").alias("_above"))), "above", "left")
    return nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above")).select(*names, "ends_sha256").unionByName(tops)


def crc32_sql(text: str) -> str:
    """SQL for the crc32 of an ASCII text: its bytes one after the other, eight shifts each."""
    shift = "list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: {shift}, CAST(4294967295 AS BIGINT)), 4294967295)"


OP13_SQL = f"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(turn ORDER BY i) AS s, {crc32_sql('CAST(c AS VARCHAR)')} % 9 AS h FROM turns GROUP BY c),
rebuilt AS (
  SELECT o.c, list_concat(coalesce(b.s[1:o.h], []), o.s[o.h + 1:]) AS s
  FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 5),
steps AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT d, s[1:d] AS p, min(c) AS c, count(*) AS n,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends
  FROM steps GROUP BY 1, 2),
with_children AS (
  SELECT x.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN x.d = 0 THEN 0 ELSE (x.n - 1) * octet_length(encode(x.p[x.d].t)) END AS saved
  FROM nodes x LEFT JOIN (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2) k ON k.d = x.d AND k.p = x.p),
sums AS (
  SELECT d, p, sum(leaf) AS n_leaves, sum(saved) AS saved FROM (
    SELECT e AS d, p[1:e] AS p, leaf, saved FROM (
      SELECT p, CAST(n_children = 0 AS BIGINT) AS leaf, saved, unnest(range(0, d + 1)) AS e FROM with_children))
  GROUP BY 1, 2)
SELECT x.c AS conv_id, x.d AS depth, u.c AS parent_conv_id, x.n AS n_convs, CAST(x.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM with_children x JOIN sums s ON s.d = x.d AND s.p = x.p LEFT JOIN nodes u ON u.d = x.d - 1 AND u.p = x.p[1:x.d - 1]
"""
