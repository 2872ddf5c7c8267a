"""Quality by a logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits, runs of other signs, and single characters of scripts written without blanks; case counts. A text's
features are its distinct words and pairs of neighbours, and how large a share of them (in powers of two) are words in capitals, runs of signs, pairs
of equal words and repeated pairs, all hashed to ``SPACE`` places, each with the same weight so that their squares sum to one. Training streams a
bounded sample of labelled rows through one task in a fixed order, a few passes over, each row one update of the places it touches; the
weights that are not zero come back as rows. A score is the dot product of a text's features with them, moved so that the cut chosen on a
part of the sample that was not learnt stands at ``CALLED``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.llm.batches import add_columns, mixed, small_batches

SPACE = 1 << 20
EACH = 4_000  # labelled rows of either class that are learnt from
PASSES = 4
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.05, 0.0
CALLED = 0.3
LEVEL = float(np.log(CALLED / (1 - CALLED)))
CHUNK_CHARS = 1 << 18
BLANK, WORD, SIGN, ALONE = range(4)
STEP = np.uint64(0x9E3779B97F4A7C15)
SOLID = (
    (0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
)


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is 0 modulo 5; so are rows without id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@cache
def kinds() -> np.ndarray:
    """Kind of every code point; ``SOLID`` scripts are written without blanks."""
    kind = np.fromiter((BLANK if c.isspace() or not c.isprintable() else WORD if c.isalnum() else SIGN for c in map(chr, range(0x110000))), np.uint8, 0x110000)
    for first, last in SOLID:
        part = kind[first : last + 1]
        part[part == WORD] = ALONE
    return kind


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed places of each text's words, pairs of neighbours and shares, and where each text's places start."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([0, *map(len, texts)])
    kind = kinds()[code]
    first = np.ones(len(code), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == ALONE)
    edges = ends[:-1][ends[:-1] < len(code)]
    first[edges] = True
    runs = np.flatnonzero(first)
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    place = (np.arange(len(code)) - np.repeat(runs, np.diff(np.append(runs, len(code))))).astype(np.uint64)
    hashed = mixed(np.add.reduceat(mixed(code.astype(np.uint64) + place * STEP), runs))
    small = np.add.reduceat(~capitals()[code], runs)  # characters that aren't capitals
    real = kind[runs] != BLANK
    words, text = hashed[real], np.searchsorted(ends, runs[real], "right") - 1
    beside = text[1:] == text[:-1]
    pairs, pair_text = mixed(words[:-1] * STEP + words[1:])[beside], text[:-1][beside]
    key = pair_text * SPACE + (pairs % np.uint64(SPACE)).astype(np.int64)
    distinct = np.unique(key)
    n, m = (np.bincount(t, minlength=len(texts)) for t in (text, pair_text))
    shares = [
        (np.bincount(text[small[real] == 0], minlength=len(texts)), n),
        (np.bincount(text[kind[runs][real] == SIGN], minlength=len(texts)), n),
        (np.bincount(pair_text[(words[1:] == words[:-1])[beside]], minlength=len(texts)), m),
        (m - np.bincount(distinct // SPACE, minlength=len(texts)), m),
    ]
    found = [distinct, text * SPACE + (words % np.uint64(SPACE)).astype(np.int64)]
    for number, (part, whole) in enumerate(shares):
        some = np.flatnonzero(part)
        level = np.floor(np.log2(part[some] / whole[some])).astype(np.int64)
        found.append(some * SPACE + (mixed((level * len(shares) + number).astype(np.uint64)) % np.uint64(SPACE)).astype(np.int64))
    every = np.unique(np.concatenate(found))
    return every % SPACE, np.searchsorted(every, np.arange(len(ends)) * SPACE)


def chunked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the texts of a column, about ``CHUNK_CHARS`` characters at a time; null reads as empty."""
    held, size = [], 0
    for text in column.to_pylist():
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield features(held)
            held, size = [], 0
    if held:
        yield features(held)


@cache
def capitals() -> np.ndarray:
    return np.fromiter((c.isupper() for c in map(chr, range(0x110000))), bool, 0x110000)


class Leader:
    """Follow-the-regularised-leader: per place the sum of adjusted gradients and of their squares; the last place is the constant."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)

    def weights(self, at) -> np.ndarray:
        """The leader's weights: zero until the gradients outweigh ``l1``. The constant isn't regularised."""
        z, n = self.z[at], self.n[at]
        free = np.arange(SPACE + 1)[at] == SPACE
        l1, l2 = np.where(free, 0.0, self.l1), np.where(free, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def learn(self, places: np.ndarray, label: int) -> None:
        """One update by one text."""
        at = np.append(places, SPACE)
        x = values(len(places))
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def values(n: int) -> np.ndarray:
    """Weights of n features and of the constant."""
    return np.append(np.full(n, 1 / np.sqrt(max(n, 1))), 1.0)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_cut(raw: np.ndarray, label: np.ndarray) -> float:
    """The cut with the fewest wrong calls, half-way between two values; the lowest of equals."""
    if len(set(label.tolist())) < 2:
        return 0.0
    order = np.argsort(raw, kind="stable")
    raw, label = raw[order], label[order]
    right = np.cumsum(label == 0) - np.cumsum(label)
    right[:-1][raw[1:] == raw[:-1]] = -len(raw)
    k = int(right[:-1].argmax())
    return float((raw[k] + raw[k + 1]) / 2)


@dataclass
class Model:
    """Weights of the places and of the constant, less the cut; ``share``: the score of every text where one class had no example."""

    weights: np.ndarray
    share: float | None = None

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.share is not None:
            return np.full(len(column), self.share)
        out = [np.zeros(0)]
        for places, at in chunked(column):
            n = np.diff(at)
            total = np.diff(np.concatenate([[0.0], np.cumsum(self.weights[places])])[at])
            out.append(sigmoid(total / np.sqrt(np.maximum(n, 1)) + self.weights[SPACE] + LEVEL))
        return np.concatenate(out)


def sample(docs: DataFrame, labels: DataFrame, each: int = EACH) -> DataFrame:
    """(doc_id, quality, draw, part, text) of at most ``each`` labelled ids of either class outside the held-out rows, the first by a hash of the id.

    An id that is labelled twice counts as its higher label. Only the chosen ids, of proven number, go to the scan of the documents.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    known = known.withColumn("draw", F.xxhash64(F.lit("quality"), "doc_id"))
    chosen = [known.where(F.col("quality") == c).orderBy("draw", "doc_id").limit(each) for c in (0, 1)]
    ids = docs.sparkSession.createDataFrame(chosen[0].unionByName(chosen[1]).collect(), known.schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # 2 * each rows at most
    return rows.select("doc_id", "quality", "draw", (F.pmod("draw", F.lit(5)) == 0).alias("part"), "text")


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH, passes: int = PASSES) -> Model:
    """A model of a bounded sample of labelled rows.

    Where an id repeats, the text with the smallest hash is learnt. Neither texts nor their features reach the driver, only weights.
    """
    rows = sample(docs, labels, each).withColumn("hash", F.xxhash64("text"))

    def hashed(column: pa.Array) -> list[pa.Array]:
        parts = [places[s:e].astype(np.int32) for places, at in chunked(column) for s, e in zip(at[:-1], at[1:])]
        return [pa.array(parts, pa.list_(pa.int32()))]

    learnt = add_columns(rows, "text", hashed, "places array<int>").groupBy("doc_id").agg(
        F.min_by(F.struct("quality", "draw", "part", "places"), F.struct("hash", "text")).alias("row")).select("doc_id", "row.*")
    learnt = learnt.withColumn("turn", F.explode(F.when(F.col("part"), F.array(F.lit(passes))).otherwise(F.sequence(F.lit(0), F.lit(passes - 1)))))
    ordered = learnt.select("turn", "draw", "doc_id", "quality", "part", "places").repartition(1).sortWithinPartitions("turn", "draw", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, seen, raw, label = Leader(), np.zeros(2), [], []
        for batch in batches:
            quality, part = batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            lists = batch.column(5)
            for i in range(batch.num_rows):
                places = lists[i].values.to_numpy()
                if part[i]:
                    raw.append(leader.weights(np.append(places, SPACE)) @ values(len(places)))
                    label.append(quality[i])
                else:
                    seen[quality[i]] += 1
                    leader.learn(places, quality[i])
        weights = leader.weights(slice(None))
        weights[SPACE] -= best_cut(np.array(raw), np.array(label))
        kept = np.flatnonzero(weights)
        kept = kept if seen.all() else np.zeros(0, np.int64)
        both = seen + np.bincount(label, minlength=2) if label else seen
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(kept, -1)), pa.array(np.append(weights[kept], both[1] / max(both.sum(), 1)))], names=["place", "weight"])

    found = small_batches(ordered).mapInArrow(run, "place long, weight double").toArrow()  # SPACE + 2 rows at most
    place, weight = (found[c].to_numpy() for c in ("place", "weight"))
    if len(place) < 2:
        return Model(np.zeros(SPACE + 1), float(weight[0]) if len(weight) else 0.0)
    weights = np.zeros(SPACE + 1)
    weights[place[place >= 0]] = weight[place >= 0]
    return Model(weights)


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from ``CALLED`` up) of every whole text.

    Null and empty texts get the score of no words; repeated rows score alike; ties at the cut count as good; without examples of both
    classes every score is the share of good ones; an empty table gives no rows; columns of the new names are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(column: pa.Array) -> list[pa.Array]:
        score = shared.value.scores(column)
        return [pa.array(score), pa.array((score >= CALLED).astype(np.int32))]

    return add_columns(docs, text, scored, "score double, predicted int")
