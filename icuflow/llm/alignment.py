"""Cross-tokenizer alignment by inverted pair bitmaps.

Every text is encoded by a byte-level BPE (A) and a sentencepiece model (B). Byte offsets where tokens of both end cut the tokens into
groups, and each A-B pair of token occurrences in a group is a link. Links are kept inverted: rows of documents are cut into blocks, and
each (id pair, block) has a compressed bitmap of the documents that hold the pair, as a sorted list of 16-bit rows or as bits, whichever
is shorter. Further bitmaps, the multiplicity planes, hold the binary digits of how often beyond once a document holds it. Blocks are disjoint, so the
OR over a pair's bitmaps is their concatenation: their popcounts add up to its document count, and with the planes' weights to its link
count. Postings go back the same way: each bitmap adds its pair's count, times the plane's weight, to the documents in it.

A pair has one row per block and plane at most, so no pair is a hot key; a block is bounded by ``BLOCK_ROWS`` documents and, but for
its last document, ``BLOCK_CHARS`` characters.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from icuflow.llm.batches import small_batches
from icuflow.sources.tables import stage

FOLDER = "/opt/tokenizers"
# fixed values: the pattern by which byte-level vocabularies cut texts
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_ROWS, BLOCK_CHARS = 1 << 13, 16 << 20
CHUNK_CHARS = 1 << 20
WIDE = 1 << 12  # pairs of a group from which its ids are counted before they are paired
DOC = "n_a long, n_b long, n_groups long, n_links long, groups string"
INDEX = f"block long, at int, doc_id long, {DOC}, pair long, weight long, docs int, dense boolean, bits binary"
RESULT = f"doc_id long, {DOC}, n_best long, count_sum long"


@dataclass(frozen=True)
class Tokenizers:
    """Files of the two tokenizers; every executor needs them at these paths."""

    a: str = f"{FOLDER}/byte_bpe_50k.json"
    b: str = f"{FOLDER}/piece_bpe_32k.model"


def pair_code(a, b):
    """One number for an id pair."""
    return a * 65536 + b


class Encoder:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, files: Tokenizers):
        import sentencepiece

        with open(files.a, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_letters()
        entries = {i: bytes(letters[c] for c in t) for t, i in described["model"]["vocab"].items()}
        self.a = byte_level(files.a, described, entries)
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.b)
        tokens_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        tokens_b = [piece_bytes(self.b, i) for i in range(self.b.get_piece_size())]
        if max(len(tokens_a), len(tokens_b)) > 65536:
            raise ValueError("ids beyond 65535")
        self.bytes_a, self.bytes_b = (pa.array(t, pa.large_binary()) for t in (tokens_a, tokens_b))
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (tokens_a, tokens_b))
        self.written = pa.array([f"{i}{mark}" for i in range(max(len(tokens_a), len(tokens_b))) for mark in (",", "|", ";", "")], pa.large_string())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and offsets per text for A and B; texts that don't come back byte by byte have no tokens."""
        some = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in some]
        a = self.a(spaced)
        b = [np.array(ids, np.int64) for ids in self.b.encode([texts[i] for i in some], num_threads=1)] if some else []
        none = np.zeros(0, np.int64)
        ids_a, ids_b = [none] * len(texts), [none] * len(texts)
        back_a, back_b = (self.joined(table, size, ids) for table, size, ids in ((self.bytes_a, self.size_a, a), (self.bytes_b, self.size_b, b)))
        for i, text, x, y, as_a, as_b in zip(some, spaced, a, b, back_a, back_b):
            if as_a == as_b == text.encode():
                ids_a[i], ids_b[i] = x, y
        return (*flat(ids_a), *flat(ids_b))

    @staticmethod
    def joined(table: pa.Array, size: np.ndarray, ids: list[np.ndarray]) -> Iterator[bytes]:
        """The bytes of each list of tokens."""
        every, at = flat(ids)
        data = table.take(pa.array(every)).buffers()[2]
        ends = np.concatenate([[0], np.cumsum(size[every])])[at]
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield data[s:e].to_pybytes() if e > s else b""


@cache
def encoder(files: Tokenizers) -> Encoder:
    return Encoder(files)


def byte_level(path: str, described: dict, entries: dict[int, bytes]) -> Callable[[list[str]], list[np.ndarray]]:
    """Encodes without special tokens; their strings inside texts are plain text.

    If every merge makes the token whose id is its rank, the ids follow from the vocabulary, the pattern and the order of ids alone, which
    tiktoken works out several times faster than the file's own library.
    """
    model, before = described["model"], described["pre_tokenizer"] or {}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    special = {t["id"] for t in described["added_tokens"] if t["special"]}
    plain = model["type"] == "BPE" and not any(model[k] for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    plain = plain and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not described["normalizer"]
    if plain and all(model["vocab"][t] == 256 + i for i, t in enumerate(merged)):
        import tiktoken

        ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={t: i for i, t in entries.items() if i not in special}, special_tokens={})
        return lambda texts: [ranked.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for t in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, np.int64) for e in own.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def byte_letters() -> dict[str, int]:
    """The byte of every letter of a byte-level vocabulary: printable bytes stand for themselves, the others are letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All lists in one array, and where each starts."""
    return np.concatenate([np.zeros(0, np.int64), *lists]), np.cumsum([0, *map(len, lists)])


@dataclass
class Aligned:
    """Tokens of some texts with their groups: ``first_a`` and ``first_b`` say where each group's tokens start."""

    ids_a: np.ndarray
    at_a: np.ndarray
    ids_b: np.ndarray
    at_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    groups_at: np.ndarray  # first group of each text

    @property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.first_a), np.diff(self.first_b)

    def links(self) -> np.ndarray:
        """Number of links per text."""
        a, b = self.sizes
        return np.diff(np.concatenate([[0], np.cumsum(a * b)])[self.groups_at])


def align_tokens(enc: Encoder, texts: list[str | None]) -> Aligned:
    """Tokens and groups of the texts, side by side on one axis of bytes: both tokenizers cut the same bytes, so texts end at the same places."""
    ids_a, at_a, ids_b, at_b = enc.encode(texts)
    ends_a, ends_b = np.cumsum(enc.size_a[ids_a]), np.cumsum(enc.size_b[ids_b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    edges = np.arange(len(common) + 1)
    text_ends = np.concatenate([[0], ends_a])[at_a]
    return Aligned(
        ids_a, at_a, ids_b, at_b, group_a, group_b, np.searchsorted(group_a, edges), np.searchsorted(group_b, edges),
        np.searchsorted(common, text_ends, "right"),
    )


def groups_written(enc: Encoder, found: Aligned) -> list[str]:
    """Per text its groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    last_a, last_b = np.zeros(len(found.ids_a), bool), np.zeros(len(found.ids_b), bool)
    last_a[found.first_a[1:] - 1], last_b[found.first_b[1:] - 1] = True, True
    end = np.zeros(len(found.ids_b), bool)
    end[found.at_b[1:][np.diff(found.at_b) > 0] - 1] = True
    codes = np.zeros(len(found.ids_a) + len(found.ids_b), np.int64)
    codes[np.arange(len(found.ids_a)) + found.first_b[found.group_a]] = found.ids_a * 4 + last_a
    codes[np.arange(len(found.ids_b)) + found.first_a[found.group_b + 1]] = found.ids_b * 4 + 2 * last_b + end
    written = enc.written.take(pa.array(codes))
    offsets = np.frombuffer(written.buffers()[1], np.int64)[(found.at_a + found.at_b)].tolist()
    data = written.buffers()[2]
    return [data[s:e].to_pybytes().decode() if e > s else "" for s, e in zip(offsets[:-1], offsets[1:])]


def link_postings(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, text) with the number of links, by pair and text. Ids of very wide groups are counted before they are paired."""
    a, b = found.sizes
    text_of = np.repeat(np.arange(len(found.groups_at) - 1), np.diff(found.groups_at))
    wide = a * b > WIDE
    left = np.flatnonzero(~wide[found.group_a]) if len(wide) else np.zeros(0, np.int64)
    group = found.group_a[left]
    times = b[group]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    right = np.repeat(found.first_b[group], times) + step
    pairs, texts, counts = [pair_code(np.repeat(found.ids_a[left], times), found.ids_b[right])], [np.repeat(text_of[group], times)], [np.ones(len(right), np.int64)]
    for g in np.flatnonzero(wide):
        one, n = np.unique(found.ids_a[found.first_a[g] : found.first_a[g + 1]], return_counts=True)
        two, m = np.unique(found.ids_b[found.first_b[g] : found.first_b[g + 1]], return_counts=True)
        pairs.append(pair_code(np.repeat(one, len(two)), np.tile(two, len(one))))
        counts.append(np.outer(n, m).ravel())
        texts.append(np.full(len(one) * len(two), text_of[g]))
    key = np.concatenate(pairs) * BLOCK_ROWS + np.concatenate(texts)
    count = np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first] // BLOCK_ROWS, key[first] % BLOCK_ROWS, np.add.reduceat(count, first) if len(first) else count


class Block:
    """Postings of a block's documents, turned into bitmaps at its end."""

    def __init__(self, number: int):
        self.number, self.rows, self.chars, self.held = number, 0, 0, []

    def add(self, postings: tuple[np.ndarray, np.ndarray, np.ndarray], texts: list[str | None]) -> None:
        pair, text, count = postings
        self.held.append((pair * BLOCK_ROWS + text + self.rows, count))
        self.rows += len(texts)
        self.chars += sum(map(len, filter(None, texts)))

    @property
    def full(self) -> bool:
        return self.rows >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def bitmaps(self) -> Iterator[pa.RecordBatch]:
        """The document bitmap of every pair (``docs`` set), then the planes of the links beyond the first (``docs`` null)."""
        key, count = (np.concatenate(x) for x in zip(*self.held))
        order = np.argsort(key, kind="stable")
        key, beyond = key[order], count[order] - 1
        yield from self.plane(key, 1, True)
        for digit in range(int(beyond.max(initial=0)).bit_length()):
            yield from self.plane(key[(beyond >> digit) & 1 == 1], 1 << digit, False)

    def plane(self, key: np.ndarray, weight: int, documents: bool) -> Iterator[pa.RecordBatch]:
        pair, row = key // BLOCK_ROWS, key % BLOCK_ROWS
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        dense = size * 16 > BLOCK_ROWS
        short = np.repeat(~dense, size)
        offsets = np.concatenate([[0], np.cumsum(2 * size[~dense])]).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(row[short].astype("<u2").tobytes())])
        yield self.batch(pair[first[~dense]], weight, size[~dense] if documents else None, False, lists)
        where = np.flatnonzero(dense)
        for i in range(0, len(where), 512):
            some = where[i : i + 512]
            bits = np.zeros((len(some), BLOCK_ROWS), bool)
            for n, j in enumerate(some):
                bits[n, row[first[j] : first[j] + size[j]]] = True
            packed = [x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")]
            yield self.batch(pair[first[some]], weight, size[some] if documents else None, True, pa.array(packed, pa.binary()))

    def batch(self, pair: np.ndarray, weight: int, docs: np.ndarray | None, dense: bool, bits: pa.Array) -> pa.RecordBatch:
        n = len(pair)
        return index_rows(n, block=np.full(n, self.number), pair=pair, weight=np.full(n, weight), dense=np.full(n, dense), bits=bits,
                          **({} if docs is None else {"docs": docs}))


FIELDS = [("block", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
          ("n_links", pa.int64()), ("groups", pa.string()), ("pair", pa.int64()), ("weight", pa.int64()), ("docs", pa.int32()),
          ("dense", pa.bool_()), ("bits", pa.binary())]


def index_rows(n: int, **columns) -> pa.RecordBatch:
    """Rows of the index, columns that aren't named null."""
    found = [columns.get(name) for name, _ in FIELDS]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, kind) if x is None else x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind) for x, (_, kind) in zip(found, FIELDS)],
        names=[name for name, _ in FIELDS])


def inverted_index(docs: DataFrame, text: str = "text", key: str = "doc_id", files: Tokenizers = Tokenizers(), digest: bool = False) -> DataFrame:
    """Documents and pair bitmaps in one staged table, so that both come from the same run of a task.

    Rows with ``bits`` are bitmaps, the others documents: their place in the block, token, group and link counts, and their groups written out,
    or with ``digest`` the groups' SHA-256.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(files), TaskContext.get().partitionId(), 0
        block = Block(part << 32)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, end in pieces(texts, block.rows):
                if block.rows + end - start > BLOCK_ROWS or block.full:
                    yield from block.bitmaps()
                    number += 1
                    block = Block((part << 32) | number)
                some = texts[start:end]
                found = align_tokens(enc, some)
                written = groups_written(enc, found)
                if digest:
                    written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
                yield index_rows(
                    len(some), block=np.full(len(some), block.number), at=np.arange(block.rows, block.rows + len(some)), doc_id=ids[start:end],
                    n_a=np.diff(found.at_a), n_b=np.diff(found.at_b), n_groups=np.diff(found.groups_at), n_links=found.links(), groups=pa.array(written))
                block.add(link_postings(found), some)
        if block.rows:
            yield from block.bitmaps()

    return stage(small_batches(rows).mapInArrow(run, INDEX), "pair-bitmaps")


def pieces(texts: list[str | None], rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most CHUNK_CHARS characters, or one text, and no more than a block's rows."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and (size + n > CHUNK_CHARS or i - start >= BLOCK_ROWS):
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, a, b, docs, links, best): documents and links of every pair; ``best`` marks an A id's highest document count, ties included."""
    every = index.where("bits is not null").groupBy("pair").agg(F.sum("docs").alias("docs"), links_of().alias("links"))
    named = every.withColumns({"a": F.shiftright("pair", 16), "b": F.col("pair").bitwiseAND(65535)})
    most = F.max("docs").over(Window.partitionBy("a"))  # at most as many rows as B has ids
    return named.select("pair", "a", "b", "docs", "links", (F.col("docs") == most).alias("best"))


def links_of() -> Column:
    """Links in the bitmaps: popcount times weight."""
    popcount = F.when(F.col("dense"), F.bitmap_count("bits")).otherwise(F.octet_length("bits") / 2).cast("long")
    return F.sum(popcount * F.col("weight"))


def add_back(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one block with the sums of their links' counts and of their best links."""
    is_doc = left["at"].is_valid()
    docs = left.filter(is_doc).combine_chunks().sort_by("at")
    planes = left.filter(left["bits"].is_valid()).combine_chunks()
    total, best = np.zeros(BLOCK_ROWS, np.int64), np.zeros(BLOCK_ROWS, np.int64)
    pair = right["of_pair"].to_numpy()
    order = np.argsort(pair)
    place = order[np.searchsorted(pair[order], planes["pair"].to_numpy())]
    weight = planes["weight"].to_numpy()
    count, is_best = right["of_docs"].to_numpy()[place] * weight, right["best"].to_numpy(zero_copy_only=False).astype(np.int64)[place] * weight
    dense = planes["dense"].to_numpy(zero_copy_only=False).astype(bool)
    bits = planes["bits"].combine_chunks()
    if (~dense).any():
        lists = bits.filter(pa.array(~dense))
        rows = np.frombuffer(b"".join(lists.to_pylist()), "<u2")
        size = np.array(pa.compute.binary_length(lists)) // 2
        np.add.at(total, rows, np.repeat(count[~dense], size))
        np.add.at(best, rows, np.repeat(is_best[~dense], size))
    for one, n, k in zip(bits.filter(pa.array(dense)).to_pylist(), count[dense], is_best[dense]):
        rows = np.unpackbits(np.frombuffer(one, np.uint8), bitorder="little").astype(np.int64)
        total += n * rows
        best += k * rows
    at = docs["at"].to_numpy()
    return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]).append_column("n_best", pa.array(best[at])).append_column(
        "count_sum", pa.array(total[at]))


def align(docs: DataFrame, text: str = "text", key: str = "doc_id", files: Tokenizers = Tokenizers(), digest: bool = False) -> DataFrame:
    """One row per document: tokens, groups and links; ``n_best`` links whose pair is its A id's most frequent (by documents, ties
    included), and ``count_sum``, the document counts of its links added up.

    Texts that are null, empty, or that a tokenizer doesn't give back byte by byte have no tokens: zeros and empty groups. Repeated rows
    are documents of their own, also with null or equal ids; an empty table gives no rows; further columns are not read.
    Only the keys (pair, block) travel to the counts and back; the bitmaps are shuffled once, to their block.
    """
    index = inverted_index(docs, text, key, files, digest)
    held = index.where("docs is not null").select(F.col("block").alias("of_block"), F.col("pair").alias("of_pair"))
    counted = pair_counts(index).select(F.col("pair").alias("of_pair"), F.col("docs").alias("of_docs"), "best")
    scores = held.join(counted, "of_pair")
    return index.groupBy("block").cogroup(scores.groupBy("of_block")).applyInArrow(add_back, RESULT)
