"""I-Match document fingerprints.

Terms are distinct words, known by a hash of 63 bits (``CLASSES``); their document frequency is counted over all documents. Terms whose
normalised inverse document frequency ln(N / n) / ln(N) lies in a band make the lexicon, a sorted table of hashes: of N documents
from N**(1 - BAND[1]) to N**(1 - BAND[0]) hold each of its terms, so terms of one or a few documents (typing errors, ids) and terms of most
documents are out at any size. At least a share of RAREST holds each, so the lexicon has at most 1 / RAREST (22,026) times as many terms
as a document does on average. A document's lexicon terms are sorted and hashed, once as a whole and once for each of several random
subsets of the lexicon, at rates that fall by 4.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.batches import add_columns, mixed, small_batches, words_of
from icuflow.llm.ranks import prefix_sums

CLASSES = 1 << 63
HELD_TERMS = 1 << 20  # that a task adds up before it hands them on
BAND = (0.16, 0.55)
LEAST = 2  # documents that hold a term of the lexicon, in small tables too
RAREST = math.exp(-10)
SUBSETS = 12
RATES = (4, 16, 64, 256, 1024, 4096)
BUCKET_ROWS = 1_000
MOST_BUCKETS = 1_000_000
NONE = "0000"
SALTS = np.random.default_rng(77).integers(1, 2**63, SUBSETS, np.uint64)


def term_counts(docs: DataFrame, text: str = "text", classes: int = CLASSES) -> DataFrame:
    """(class, n): documents that hold a term of the class, over all rows of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for _, words, at in words_of(batch.column(0)):
                held.append(_counted(*_distinct((words % np.uint64(classes)).astype(np.int64), at)))
                size += len(held[-1][0])
                if size >= HELD_TERMS:
                    terms, n = _counted(*map(np.concatenate, zip((terms, n), *held)))
                    held, size = [], 0
                    if len(terms) >= HELD_TERMS:
                        yield from parts(terms, n)
                        terms, n = terms[:0], n[:0]
        yield from parts(*_counted(*map(np.concatenate, zip((terms, n), *held))))

    def parts(terms: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(terms), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["class", "n"])

    return small_batches(docs.select(text)).mapInArrow(run, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n"))


def _distinct(terms: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each row, a count of 1 for each."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(terms, kind="stable")
    terms, row = terms[order], row[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
    return terms[new], np.ones(int(new.sum()), np.int64)


def _counted(terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms in order and the sum of ``n`` of each."""
    if (terms[1:] < terms[:-1]).any():
        order = np.argsort(terms, kind="stable")
        terms, n = terms[order], n[order]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    return terms[first], np.add.reduceat(n, first) if len(first) else n[:0]


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND, classes: int = CLASSES) -> np.ndarray:
    """The classes in the band of normalised inverse document frequency ln(documents / n) / ln(documents), in order."""
    total = docs.count()
    low, high = max(LEAST, total ** (1 - band[1]), total * RAREST), total ** (1 - band[0])
    return np.sort(term_counts(docs, text, classes).where(F.col("n").between(low, high)).select("class").toArrow()["class"].to_numpy())


def fingerprint(words: np.ndarray, inside: np.ndarray, classes: int = CLASSES) -> str:
    """16 digits for all lexicon terms and 4 for each subset, ``0000`` where it holds none; without lexicon terms all terms count."""
    terms = np.unique(words)
    wanted = (terms % np.uint64(classes)).astype(np.int64)
    within = inside.take(np.searchsorted(inside, wanted), mode="clip") == wanted if len(inside) else np.zeros(len(terms), bool)
    terms = terms[within] if within.any() else terms
    out = [f"{xxhash.xxh64_intdigest(terms.tobytes()):016x}"]
    for draw in mixed(terms ^ SALTS[:, None]):
        rest = terms
        for rate in RATES:
            if len(rest):
                member = draw < np.uint64((1 << 64) // rate)
                rest, draw = rest[member], draw[member]
            out.append(f"{xxhash.xxh64_intdigest(rest.tobytes(), rate) % 65535 + 1:04x}" if len(rest) else NONE)
    return "".join(out)


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints; else the share of subsets that agree, at the sparsest rate at which half of the subsets hold a term.

    Subsets that hold none of either document's terms don't count. Where no rate is dense enough, the densest one is taken.
    """
    if a == b:
        return 1.0
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(16, len(a), 4)]
    for level in reversed(range(len(RATES))):
        held = [x == y for x, y in pairs[level :: len(RATES)] if x != NONE or y != NONE]
        if 2 * len(held) >= SUBSETS or level == 0:
            return sum(held) / len(held) if held else 0.0
    return 0.0


def fingerprints(texts: list[str], inside: np.ndarray) -> list[str]:
    out = []
    for _, words, at in words_of(pa.array(texts, pa.large_string())):
        out += [fingerprint(words[s:e], inside) for s, e in zip(at[:-1], at[1:])]
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", inside: np.ndarray | None = None) -> DataFrame:
    """``docs`` with the string ``fingerprint`` of whole texts.

    Null and empty texts have no terms and share one fingerprint; equal texts have equal ones; repeated rows are counted and
    fingerprinted each; an empty table gives no rows; a column named fingerprint is replaced, others stay. Rows aren't shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text) if inside is None else inside)
    return add_columns(docs, text, lambda c: [pa.array(fingerprints([t or "" for t in c.to_pylist()], shared.value), pa.string())], "fingerprint string")


class Bounds:
    """First rows of runs of rows in order of doc_id (nulls last), then a hash of the text.

    Rows alike that span several starts are split among these runs; the rows of all but the last of them are ``alike``.
    """

    def __init__(self, rows: list[tuple[int | None, int]]):
        self.ids = np.array([r[0] for r in rows if r[0] is not None], np.int64)
        self.hashes = np.array([r[1] for r in rows], np.int64)
        self.alike = {i for i, (row, after) in enumerate(zip(rows, rows[1:])) if row == after}

    def place(self, ids: pa.Array, hashes: np.ndarray, turns: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The run of each row, and the run that gets a copy of it to end with, or -1.

        ``turns`` counts a task's rows that are like the first of a run. They go to the last run that starts with them, then to each in
        turn, so the last one is never without; the first of them is copied to the run before.
        """
        n = len(self.hashes)
        missing = np.asarray(ids.is_null())
        known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = np.searchsorted(self.ids, known), np.searchsorted(self.ids, known, "right")
        low, high = np.where(missing, len(self.ids), low), np.where(missing, n, high)
        run, guarded = high - 1, np.full(len(ids), -1)
        for i in np.flatnonzero(high > low):
            equal = self.hashes[low[i] : high[i]]
            first, last = (low[i] + np.searchsorted(equal, hashes[i], side) for side in ("left", "right"))
            run[i] = last - 1
            if last > first:
                turn = turns.get(last, 0)
                turns[last] = turn + 1
                run[i] = first + (turn + last - 1 - first) % (last - first)
                guarded[i] = (first - 1) % n if not turn else -1
        return run, guarded


def edited_fingerprints(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last half replaced by the first as many code points of the next document by doc_id (nulls last, ties by
    text); after the last comes the first, and a single document follows itself. Null texts read as empty; further columns are not read.

    Rows in order are cut into runs of about ``bucket_rows``; each run is one unit of the only shuffle of texts, sorted by Spark and read
    as a stream, and gets a copy of the next run's first row from each task that holds one. Rows alike fill runs of their own and follow
    themselves there. The runs' first rows, MOST_BUCKETS at most, reach the driver.
    """
    inside = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    ranked = prefix_sums(keyed.select("doc_id", "h", F.lit(1).cast("bigint").alias("one")), order, "one", name="at")
    each = max(bucket_rows, -(-docs.count() // MOST_BUCKETS))
    firsts = ranked.where(F.col("at") % each == 0).orderBy("at").select("doc_id", "h").collect()
    bounds = docs.sparkSession.sparkContext.broadcast(Bounds([tuple(r) for r in firsts]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, int] = {}
        for batch in batches:
            run, guarded = bounds.value.place(batch.column(0), batch.column(2).to_numpy(), turns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run), pa.array(np.zeros(len(run), np.int32))], names=names)
            again = batch.filter(pa.array(guarded >= 0))
            if again.num_rows:
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(guarded[guarded >= 0]), pa.array(np.ones(again.num_rows, np.int32))], names=names)

    names = ["doc_id", "text", "h", "run", "guard"]
    dealt = small_batches(keyed).mapInArrow(deal, "doc_id bigint, text string, h bigint, run bigint, guard int")
    dealt = dealt.repartition("run").sortWithinPartitions("run", "guard", F.col("doc_id").asc_nulls_last(), "h", "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if row[2] in bounds.value.alike:
                    yield row[0], row[1], row[1]
                elif last and last[2] == row[2] and not last[3]:
                    yield last[0], last[1], row[1]
                last = row

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for pair in pairs(batches):
            held.append(pair)
            size += len(pair[1])
            if size >= 1_000_000:
                yield compared(held)
                held, size = [], 0
        if held:
            yield compared(held)

    def compared(held: list[tuple]) -> pa.RecordBatch:
        keep = [len(text) - len(text) // 2 for _, text, _ in held]
        edited = [text[:k] + after[: len(text) - k] for (_, text, after), k in zip(held, keep)]
        own = fingerprints([text for _, text, _ in held], inside.value)
        after = [own[i + 1] if i + 1 < len(held) and held[i][2] == held[i + 1][1] else None for i in range(len(held))]
        missing = [i for i, x in enumerate(after) if x is None]
        for i, x in zip(missing, fingerprints([held[i][2] for i in missing], inside.value)):
            after[i] = x
        changed = fingerprints(edited, inside.value)
        out = (
            [d for d, _, _ in held], [len(text) for _, text, _ in held], [hashlib.sha256(e.encode()).hexdigest() for e in edited], own, changed,
            list(map(likeness, own, changed)), list(map(likeness, own, after)),
        )
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[f.split()[0] for f in COMPARED.split(", ")])

    return dealt.mapInArrow(compare, COMPARED)


COMPARED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
