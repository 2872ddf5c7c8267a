"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``words`` hashed words. A block of benchmark items goes to every task as sorted seed hashes; running Karp-Rabin hashes of
the documents are looked up in them. For each item that shares enough seeds with a document, the longest match of unmarked
words is marked again and again, and the item's covered share is tested. Tiles may lie in any order, so reordered passages count.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.batches import keep_rows, mixed, small_batches, words_of

WORDS = 5
COVERED = 0.8
BLOCK_WORDS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
MATCHED = "item_id bigint, item_words bigint, covered bigint, coverage double, tiles array<struct<item_start:int,doc_start:int,words:int>>"


def running(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``k`` words."""
    n = max(len(words) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * BASE + words[i : i + n]
    return h


@dataclass
class Block:
    """Items of a block: ids, words, and for each seed length the sorted seeds with their (item, place)."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]


def block_of(items: list[tuple[int | None, np.ndarray]], k: int) -> Block:
    """Items with fewer than ``k`` words are one seed as they stand; items without words are never found."""
    by: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i, (_, words) in enumerate(items):
        if len(words):
            by.setdefault(min(k, len(words)), []).append((running(words, min(k, len(words))), i))
    seeds = []
    for size, found in by.items():
        h = np.concatenate([x for x, _ in found])
        item = np.repeat([i for _, i in found], [len(x) for x, _ in found])
        place = np.concatenate([np.arange(len(x)) for x, _ in found])
        order = np.argsort(h, kind="stable")
        seeds.append((size, h[order], item[order], place[order]))
    return Block([i for i, _ in items], [w for _, w in items], seeds)


def blocks(benchmark: DataFrame, k: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_words`` words; it is read as a stream, a partition at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = np.concatenate([np.zeros(0, np.uint64), *(w for _, w, _ in words_of(pa.array([row.text or ""])))])
        held.append((row.item_id, words))
        size += len(words)
        if size >= block_words:
            yield block_of(held, k)
            held, size = [], 0
    if held:
        yield block_of(held, k)


def _places(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = np.maximum(high - low, 0)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def match_starts(item: np.ndarray, doc: np.ndarray, i: np.ndarray, i_seed: np.ndarray, j: np.ndarray, j_seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places i and j of equal seeds that no match to the left reaches: the words before them differ, or there is none.

    Only such pairs are made, so a seed that repeats in both texts costs its longest matches, not all pairs of its places.
    """
    before = np.unique(np.concatenate([item, doc]), return_inverse=True)[1]
    n = int(before.max()) + 3  # two values more: nothing before the item, nothing before the document
    i_key = i_seed * n + np.where(i > 0, before[i - 1], n - 2)
    j_key = j_seed * n + np.where(j > 0, before[len(item) + j - 1], n - 1)
    order = np.argsort(j_key, kind="stable")
    j, j_key = j[order], j_key[order]
    low, high = np.searchsorted(j_key, i_seed * n), np.searchsorted(j_key, (i_seed + 1) * n)
    same, after = np.searchsorted(j_key, i_key), np.searchsorted(j_key, i_key, "right")
    starts = np.concatenate([np.repeat(i, same - low), np.repeat(i, high - after)])
    return starts, j[np.concatenate([_places(low, same), _places(after, high)])]


def match_lengths(item: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree from item place i and document place j on, by running hashes of 1, 2, 4 ... words, the longest first."""
    words = mixed(np.unique(np.concatenate([item, doc]), return_inverse=True)[1].astype(np.uint64) + BASE)
    levels, size = [(words[: len(item)], words[len(item) :])], 1
    while 2 * size <= min(len(item), len(doc)):
        levels.append(tuple(mixed(h[:-size] * BASE + h[size:]) for h in levels[-1]))
        size *= 2
    n = np.zeros(len(i), np.int64)
    for a, b in reversed(levels):
        x, y = i + n, j + n
        agree = (x < len(a)) & (y < len(b))
        agree[agree] = a[x[agree]] == b[y[agree]]
        n[agree] += size
        size //= 2
    return n


def tile(item: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, doc start, words) from the places i, j where matches of ``k`` words or more start.

    The longest match goes first, then the earliest in the item, then in the document. A match that is partly marked comes again
    as what is left of it, as long as that has ``k`` words. Places inside a match that starts further left may be given too.
    """
    size = match_lengths(item, doc, i, j)
    order = np.lexsort((j, i, -size))
    i, j, size = i[order], j[order], size[order]
    rest: list[tuple[int, int, int]] = []  # what is left of matches, the longest first
    low, at, unmarked = int(j.min()), 0, len(item)
    marked_item, marked_doc, out = np.zeros(len(item), bool), np.zeros(int((j + size).max()) - low, bool), []
    while unmarked >= k and (at < len(i) or rest):
        following = (-int(size[at]), int(i[at]), int(j[at])) if at < len(i) else None
        if following and (not rest or following <= rest[0]):
            at += 1
        else:
            following = heapq.heappop(rest)
        n, a, b = following
        free = ~(marked_item[a : a - n] | marked_doc[b - low : b - n - low])
        if free.all():
            out.append((a, b, -n))
            marked_item[a : a - n] = marked_doc[b - low : b - n - low] = True
            unmarked += n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in edge.reshape(-1, 2).tolist():
            if e - s >= k:
                heapq.heappush(rest, (s - e, a + s, b + s))
    return out


def found_in(block: Block, words: np.ndarray, at: np.ndarray, covered: float) -> Iterator[tuple[int, int, list]]:
    """(row, item, tiles) of the rows' words; ``at``: where each row's words start."""
    for k, seeds, item_of, place_of in block.seeds:
        h = running(words, k)
        low = np.searchsorted(seeds, h)
        hit = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == h)
        row = np.searchsorted(at, hit, "right") - 1
        inside = hit + k <= at[row + 1]
        hit, row = hit[inside], row[inside]
        if not len(hit):
            continue
        low, high = low[hit], np.searchsorted(seeds, h[hit], "right")
        cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(hit))):
            yield from _row(block, k, item_of, place_of, words, at[row[a]], hit[a:b], low[a:b], high[a:b], covered, int(row[a]))


def _row(block, k, item_of, place_of, words, start, hit, low, high, covered, row):
    distinct, back = np.unique(low, return_inverse=True)
    ends = high[np.unique(low, return_index=True)[1]]
    entries = np.concatenate([np.arange(x, y) for x, y in zip(distinct, ends)])  # seeds of the block that the row has, each once
    of_seed = np.repeat(np.arange(len(distinct)), ends - distinct)
    order = np.argsort(item_of[entries], kind="stable")
    entries, of_seed = entries[order], of_seed[order]
    items = item_of[entries]
    hit = hit[np.argsort(back, kind="stable")] - start
    hits_from = np.append(0, np.cumsum(np.bincount(back)))
    cuts = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(entries))):
        item = block.words[items[a]]
        reach = np.zeros(len(item) + 1, np.int64)
        np.add.at(reach, place_of[entries[a:b]], 1)
        np.add.at(reach, place_of[entries[a:b]] + k, -1)
        if (np.cumsum(reach)[:-1] > 0).sum() < covered * len(item):  # no tiling can cover more
            continue
        shared = np.unique(of_seed[a:b])
        j = hit[_places(hits_from[shared], hits_from[shared + 1])]
        skipped = max(int(j.min()) - 1, 0)  # one word before the first match is compared
        doc = words[start + skipped : start + int(j.max()) + k]
        j_seed = np.repeat(shared, hits_from[shared + 1] - hits_from[shared])
        tiles = tile(item, doc, *match_starts(item, doc, place_of[entries[a:b]], of_seed[a:b], j - skipped, j_seed), k)
        if sum(t[2] for t in tiles) >= covered * len(item):
            yield row, int(items[a]), [(x, y + skipped, n) for x, y, n in tiles]


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, covered: float = COVERED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, item_words, covered, coverage, tiles): items of which a document covers ``covered`` or more of the words.

    Matches have ``words`` words or more; shorter items must stand as a whole. Null and empty texts match nothing; texts are read whole;
    repeated documents or items give repeated rows, and items that share words are each found; null ids are carried; an empty table gives no rows; further columns are not read. The benchmark
    is a stated query set: it is matched in blocks of ``block_words`` words, which bounds what a task is sent; documents aren't shuffled.
    """
    out = None
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    for block in blocks(benchmark, words, block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                found = []
                for first, hashed, at in words_of(batch.column(1)):
                    for row, item, tiles in found_in(block, hashed, at, covered):
                        n, m = len(block.words[item]), sum(t[2] for t in tiles)
                        spans = [dict(zip(("item_start", "doc_start", "words"), t)) for t in sorted(tiles)]
                        found.append((batch.column(0)[first + row].as_py(), block.ids[item], n, m, m / n, spans))
                if found:
                    kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), TILES)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), kinds)], names=NAMES)

        part = small_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {MATCHED}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.where("false").selectExpr("doc_id", *(f"cast(null as {kind}) as {name}" for name, kind in (f.split(" ", 1) for f in MATCHED.split(", "))))


TILES = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))
NAMES = ["doc_id", "item_id", "item_words", "covered", "coverage", "tiles"]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, covered: float = COVERED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows that cover an item; all columns stay, rows are judged where they stand and not shuffled.

    Null and empty texts stay; texts are read whole, whatever their length; repeated rows stay or go together, as ids aren't looked at; an empty
    table of documents or items drops nothing; columns named like those of :func:`contaminated` are kept as they are.
    """
    for block in blocks(benchmark, words, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(column: pa.Array, shared=shared) -> np.ndarray:
            keep = np.ones(len(column), bool)
            for first, hashed, at in words_of(column):
                for row, _, _ in found_in(shared.value, hashed, at, covered):
                    keep[first + row] = False
            return keep

        docs = keep_rows(docs, "text", clean)
    return docs


def flagged(matches: DataFrame) -> DataFrame:
    """One row per contaminated document: its items and the highest coverage."""
    return matches.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))
