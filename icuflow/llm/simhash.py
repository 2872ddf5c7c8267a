"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints of 64 bits link when at most three bits differ. Two such fingerprints agree on one of four bands of bits, so there are four
orders, each of the fingerprints turned until one band leads. An order is cut into ranges of Gray rank that share their first bits, few
enough that a range holds thousands of fingerprints; it is the top of a tree. Sorted by Gray rank, neighbours share bits; nodes over
runs of neighbours hold the bits all below agree on, upper nodes the bits shared widely. A search goes down from the top,
adds up differing bits from node to node and drops a whole node once there are more than three, or one in the band that leads:
such a link is found in another order. Ranges that are too large are cut by the whole band, then by quarters of the bits left,
which after five divisions leaves at most 2**15 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.batches import add_columns
from icuflow.llm.components import components
from icuflow.sources.tables import stage

BITS = 3
WORDS = 3
SEED = 42
FAN = 8
GROUP_ROWS = 20_000
RANGE_ROWS = 4_096  # fingerprints in a range of Gray rank, about
BAND = 64 // (BITS + 1)
BLOCK = 256
CHUNK_ROWS = 200_000


def fingerprint(text: bytes | None) -> int:
    """The signed 64-bit fingerprint of a text in UTF-8; 0 if there are no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(size + 1) - size - 1
    ends = (starts + size)[min(WORDS, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends)), np.uint64, len(ends))
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the long ``fingerprint`` of whole texts; null and empty texts have 0."""
    return add_columns(df, text, lambda c: [pa.array(list(map(fingerprint, c.cast(pa.binary()).to_pylist())), pa.int64())], "fingerprint bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, in which neighbours differ by one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


class GrayIndex:
    """Hierarchy of masked patterns over codes that are sorted by group, then Gray rank; node k of level l covers FAN**l codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, ones, every = codes, codes, codes
        self.patterns, self.masks, self.added = [codes], [np.full(len(codes), ~np.uint64(0))], []
        self.nodes_tested = self.codes_tested = 0
        while len(ones) > 1:
            at = np.arange(0, len(ones), FAN)
            ones, every = np.bitwise_or.reduceat(ones, at), np.bitwise_and.reduceat(every, at)
            mask = ~(ones ^ every)
            self.added.append(self.masks[-1] & ~np.repeat(mask, FAN)[: len(self.masks[-1])])
            self.masks.append(mask)
            self.patterns.append(every & mask)

    def pairs(self, first: int, last: int, ends: np.ndarray, bits: int = BITS, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(i, j), i < j, of the codes i in first..last and later codes j of i's group that differ in ``bits`` bits at most.

        ``ends``: where the group of each code ends. In the ``lead`` highest bits they must agree.
        """
        leading = ~np.uint64((1 << 64 - lead) - 1)

        def differing(apart: np.ndarray) -> np.ndarray:
            return np.where(apart & leading, bits + 1, np.bitwise_count(apart))

        query = np.arange(first, last)
        width = ends[first:last] - query
        level = np.minimum(np.log2(np.maximum(width, 1)).astype(np.int64) // int(np.log2(FAN)), len(self.patterns) - 1)
        q = node = acc = np.zeros(0, np.int64)
        for at in range(int(level.max(initial=0)), -1, -1):
            span = FAN**at
            if len(q):
                acc = acc + differing((self.codes[q] ^ self.patterns[at][node]) & self.added[at][node])
            new = query[(level == at) & (width > 1)]
            if len(new):
                low, high = (new + 1) // span, (ends[new] - 1) // span + 1
                nq, nn = np.repeat(new, high - low), _ranges(low, high)
                na = differing((self.codes[nq] ^ self.patterns[at][nn]) & self.masks[at][nn])
                q, node, acc = np.concatenate([q, nq]), np.concatenate([node, nn]), np.concatenate([acc, na])
            if at:
                self.nodes_tested += len(q)
            else:
                self.codes_tested += len(q)
            near = acc <= bits
            q, node, acc = q[near], node[near], acc[near]
            if at:
                below, span = span // FAN, FAN
                low = np.maximum(node * span, (q + 1) // below)
                high = np.minimum((node + 1) * span, (ends[q] - 1) // below + 1)
                n = np.maximum(high - low, 0)
                q, acc, node = np.repeat(q, n), np.repeat(acc, n), _ranges(low, low + n)
        return q, node


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = high - low
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def forest(index: GrayIndex, starts: np.ndarray) -> np.ndarray:
    """For each code of a chunk of whole groups the place of a linked code that stands for its tree; itself if it has no link.

    The index's codes are sorted by group and Gray rank; ``starts``: where groups start. The trees join whatever links join.
    """
    codes = index.codes
    parent = np.arange(len(codes))
    ends = np.repeat(np.append(starts[1:], len(codes)), np.diff(np.append(starts, len(codes))))
    for first in range(0, len(codes), BLOCK):
        a, b = index.pairs(first, min(first + BLOCK, len(codes)), ends, lead=BAND)
        while len(a):
            a, b = _roots(parent, a), _roots(parent, b)
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(parent, b, a)
    return _roots(parent, np.arange(len(codes)))


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[at], at):
        at = up
    return at


def _parts(mask: int) -> list[int]:
    """``mask`` with each quarter of the other bits added in turn."""
    left = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in quarter) for quarter in np.array_split(left, BITS + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def range_bits(codes: int, range_rows: int = RANGE_ROWS) -> int:
    """First bits that the codes of a range share: ranges hold ``range_rows`` codes or more if the codes spread evenly, never parts of a band."""
    return min(max(codes // range_rows, 1).bit_length() - 1, BAND)


def grouped(codes: DataFrame, group_rows: int = GROUP_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(turn, mask, value, code): each code in one range per order, turned left by ``turn`` bits.

    Ranges above ``group_rows`` are divided by the rest of the band, then by the bits left.
    """
    top = range_bits(codes.count(), range_rows)
    turned = [F.struct(F.lit(t).alias("turn"), F.shiftleft("code", t).bitwiseOR(F.shiftrightunsigned("code", 64 - t) if t else F.lit(0)).alias("code")) for t in range(0, 64, BAND)]
    rows = codes.select(F.explode(F.array(*turned)).alias("t")).select("t.*", F.lit(_signed((1 << 64) - (1 << 64 - top))).cast("bigint").alias("mask"))
    children = {(1 << 64) - (1 << 64 - top): [(1 << 64) - (1 << 64 - BAND)]}
    done = []
    while True:
        rows = rows.withColumn("value", F.col("code").bitwiseAND(F.col("mask")))
        if children is None:
            break
        hot = stage(rows.groupBy("turn", "mask", "value").count().where(F.col("count") > group_rows).drop("count"), "hot-groups")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, ["turn", "mask", "value"], "left_anti"))
        below = codes.sparkSession.createDataFrame([(_signed(m), _signed(c)) for m, cs in children.items() for c in cs], "mask bigint, child bigint")
        rows = rows.join(hot, ["turn", "mask", "value"], "left_semi").join(F.broadcast(below), "mask")  # 4**4 rows at most
        rows = rows.select("turn", "code", F.col("child").alias("mask"))
        masks = {c for cs in children.values() for c in cs}
        children = {m: _parts(m) for m in masks} if len(done) < 5 else None
    for part in done:
        rows = rows.unionByName(part)
    return rows.select("turn", "mask", "value", "code")


def gray_sorted(groups: np.ndarray, codes: np.ndarray) -> tuple[GrayIndex, np.ndarray, np.ndarray]:
    """The index over codes whose rows of ``groups`` are sorted, the codes' order in it, and where its groups start."""
    new = np.append(True, (groups[1:] != groups[:-1]).any(1))
    order = np.lexsort((gray_rank(codes), np.cumsum(new)))
    return GrayIndex(codes[order]), order, np.flatnonzero(new)


def links(codes: DataFrame, group_rows: int = GROUP_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(a, b): links of distinct codes that join all that links of at most BITS differing bits join, one per code and range at most."""
    keys = ["turn", "mask", "value"]
    rows = grouped(codes, group_rows, range_rows).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(4)], 1)])
            if len(held) >= CHUNK_ROWS:
                change = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(1))
                if len(change):
                    cut = change[-1] + 1
                    yield edges(held[:cut])
                    held = held[cut:]
        if len(held):
            yield edges(held)

    def edges(held: np.ndarray) -> pa.RecordBatch:
        index, order, starts = gray_sorted(held[:, :3], np.ascontiguousarray(held[:, 3]).view(np.uint64))
        root, turn = forest(index, starts), held[order, 0].astype(np.uint64)
        tied = np.flatnonzero(root != np.arange(len(root)))
        ends = [_turned_back(index.codes[at], turn[at]) for at in (tied, root[tied])]
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in ends], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _turned_back(codes: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return (codes >> turn) | (codes << (np.uint64(64) - turn) % np.uint64(64))


def fingerprint_classes(printed: DataFrame) -> DataFrame:
    """(fingerprint, root) for every distinct fingerprint; classes are what links of three bits or fewer connect."""
    codes = stage(printed.select(F.col("fingerprint").alias("code")).distinct(), "codes")
    roots = components(links(codes))
    return codes.join(roots, codes.code == roots.node, "left").select(F.col("code").alias("fingerprint"), F.coalesce("root", "code").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id): the smallest doc_id that links reach, one row per row of ``docs``.

    Null and empty texts have fingerprint 0, which links like any other; long texts are read whole; equal texts have equal fingerprints;
    rows with null doc_id belong to components and name none (a component of such rows alone has a null id); repeated rows are
    repeated; an empty table gives no rows; other columns are not read. Copies are counted once before the search, so a group of copies of
    any size is one fingerprint; its rows meet only in a join that Spark splits.
    """
    printed = stage(with_fingerprints(docs.select("doc_id", text), text).select("doc_id", "fingerprint"), "fingerprints")
    classes = stage(fingerprint_classes(printed), "classes")
    firsts = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).join(classes, "fingerprint")
    named = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    names = firsts.join(named, "root").select("fingerprint", "component_id")
    return printed.join(names, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id, null ids last; of rows alike in all columns one.

    The same edge cases as :func:`near_duplicates`. Rows are known by two 64-bit hashes of all their columns.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(1), *columns).alias("_k2")]
    printed = stage(with_fingerprints(docs.select("doc_id", text, *keys), text).drop(text), "fingerprints")
    classes = stage(fingerprint_classes(printed), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_k1", "_k2")
    firsts = printed.groupBy("fingerprint").agg(F.min(rank).alias("first")).join(classes, "fingerprint")
    kept = stage(firsts.groupBy("root").agg(F.min("first").alias("first")).select("first._k1", "first._k2"), "kept")
    return docs.withColumns({"_k1": keys[0], "_k2": keys[1]}).join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
