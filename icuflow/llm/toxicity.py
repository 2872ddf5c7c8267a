"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is three hash-table rows side by side: two of its hash, so two words are alike to the net only if both are, and one of
the hash of its first four bytes, which words of one stem share. Filters of one, two and three words slide over the whole text; the largest response of each filter feeds a logistic unit.

All labelled rows outside the held-out ones are learnt from. A hash of the id deals them to shards of about ``WORDS`` words. The first shard alone
starts the net; then each task goes on from the same net with its own shard, what they moved is averaged, and so again (``ROUNDS``). A fifth of
the rows, by the hash, is kept out of that: all of it gives each language its threshold, and scores are moved so that the threshold stands at
``CALLED``. A text's language is guessed from its word hashes, by frequencies counted in all labelled rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.batches import add_columns, keep_rows, small_batches, words_of
from icuflow.llm.language import held_out
from icuflow.operators.ordered import CHUNK, CHUNK_ROWS, running_totals, with_value_chunks
from icuflow.sources.tables import stage

CALLED = 0.3
WORDS = 1 << 22  # words of a shard, on average
ROUNDS = 2
SIEVE = 1 << 26  # bits that tell most unlabelled ids before their texts are joined
LEAST_OF_CLASS = 10  # rows of each class that give a language its own threshold
BLOCK = 1 << 12  # table rows that are averaged together
TABLE = 1 << 16  # rows of a table: 16 bits of a word's code
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, LEAST_STEPS, BATCH, RATE = 8, 600, 32, 0.01
STEM = 4
TABLES = 3
PAD = max(WIDTHS) + 1  # so that even no words make a window, and each text's last window of padding can be left out


@dataclass
class Model:
    """Net, guess of the language, and thresholds; ``constant``: the score of every text where one class had no example."""

    tables: np.ndarray = field(default_factory=lambda: np.zeros((TABLES, TABLE + 1, DIM), np.float32))
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS + 1, np.float32))
    words: np.ndarray = field(default_factory=lambda: np.zeros((TABLE, 1), np.float32))
    langs: list[str] = field(default_factory=list)
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(1))
    constant: float | None = None

    def pooled(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict]:
        """Largest response of each filter per text, and the place of it; ``rows``: padded table rows, ``at``: where texts start."""
        x = np.concatenate([t[r] for t, r in zip(self.tables, rows)], 1)
        best, places = [], {}
        for width in WIDTHS:
            z = x[: len(x) - width + 1] @ self.filters[width][0]
            for k in range(1, width):
                z = z + x[k : len(x) - width + 1 + k] @ self.filters[width][k]
            bounds = np.stack([at[:-1], at[1:] - width], 1).ravel()
            top = np.maximum.reduceat(z, bounds, axis=0)[::2]
            best.append(top)
            places[width] = z
        return np.concatenate(best, 1), places

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out[:-1] + self.out[-1]

    def scores(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Score of each text of a chunk, 0 to 1."""
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        rows, starts = padded(words, at)
        raw = self.logits(self.pooled(rows, starts)[0]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(raw - self.cuts[self.guess(words, at)] + LEVEL, -40, 40)))

    def dense(self) -> dict[str, np.ndarray]:
        """All that is learnt besides the tables, to be changed in place."""
        return {"bias": self.bias, "out": self.out, **{f"f{w}": self.filters[w] for w in WIDTHS}}

    def raw(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output of one text before its threshold, and the place of its language."""
        at = np.array([0, len(words)])
        return self.logits(self.pooled(*padded(words, at))[0]).astype(np.float64), self.guess(words, at)

    def guess(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of each text's likeliest language."""
        if len(self.langs) < 2 or not len(words):
            return np.zeros(len(at) - 1, np.int64)
        mine = self.words[(words % np.uint64(TABLE)).astype(np.int64)]
        upto = np.concatenate([np.zeros((1, mine.shape[1])), np.cumsum(mine, 0, np.float64)])
        return (upto[at[1:]] - upto[at[:-1]]).argmax(1)


LEVEL = float(np.log(CALLED / (1 - CALLED)))


def codes_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word codes, offsets): 32 bits of a word's hash, then 16 of its stem's."""
    for first, words, at, stems in words_of(column, STEM):
        yield first, (words & np.uint64(0xFFFFFFFF)) | ((stems & np.uint64(0xFFFF)) << np.uint64(32)), at


def padded(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words with PAD empty rows after each text, and where the texts now start."""
    starts = at + PAD * np.arange(len(at))
    rows = np.full((TABLES, starts[-1]), TABLE, np.int64)
    place = np.arange(len(words)) + PAD * np.repeat(np.arange(len(at) - 1), np.diff(at))
    for side in range(TABLES):
        rows[side, place] = ((words >> np.uint64(16 * side)) % np.uint64(TABLE)).astype(np.int64)
    return rows, starts


def train(texts: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], calibrate: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Model:
    """:func:`fit` of one shard in memory, given as word hashes of labelled texts; rows of ``calibrate`` set thresholds only."""
    rows = np.flatnonzero(~calibrate)
    if len(set(toxic[rows].tolist())) < 2:
        return Model(constant=float(toxic[rows].mean()) if len(rows) else 0.0)
    model = fresh(seed)
    learn(model, [texts[i] for i in rows], toxic[rows], float(toxic[rows].mean()), epochs, seed)
    model.langs = sorted({x for x in langs if x is not None}) or [""]
    counts = np.zeros((TABLE, len(model.langs)))
    for words, lang in zip(texts, langs):
        if lang is not None:
            np.add.at(counts[:, model.langs.index(lang)], (words % np.uint64(TABLE)).astype(np.int64), 1)
    model.words = shares(counts)
    used = np.flatnonzero(calibrate if calibrate.any() and len(set(toxic[calibrate].tolist())) == 2 else ~calibrate)
    raw, lang = (np.concatenate(x) for x in zip(*(model.raw(texts[i]) for i in used)))
    common = best_cut(raw, toxic[used])
    own = [(raw[lang == j], toxic[used][lang == j]) for j in range(len(model.langs))]
    model.cuts = np.array([best_cut(r, t) if min(t.sum(), len(t) - t.sum()) >= LEAST_OF_CLASS else common for r, t in own])
    return model


def fresh(seed: int) -> Model:
    """A net that has learnt nothing."""
    model, rng = Model(), np.random.default_rng(seed)
    model.tables[:, :TABLE] = rng.normal(0, 0.1, (TABLES, TABLE, DIM))
    model.filters = {w: rng.normal(0, 0.3, (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    model.out[:-1] = rng.uniform(0.2, 0.6, len(model.bias))
    model.out[-1] = -1.0
    return model


def learn(model: Model, texts: list[np.ndarray], toxic: np.ndarray, share: float, epochs: int, seed: int, least: int = LEAST_STEPS) -> None:
    """Move the net by Adam steps over batches of the texts; ``share``: of toxic rows, so that both classes weigh the same."""
    rng = np.random.default_rng(seed)
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
    params, flat = model.dense(), model.tables.reshape(-1, DIM)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in [*params.items(), ("tables", flat)]}
    step = 0
    for _ in range(max(epochs, -(-least // max(1, len(texts) // BATCH)))):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            step += 1
            grads, touched, moved = gradients(model, [texts[i] for i in batch], toxic[batch], weight[batch])
            for k, g in grads.items():
                adam(params[k], g, moments[k], step, slice(None))
            adam(flat, moved, moments["tables"], step, touched)
        model.tables[:, TABLE] = 0


def adam(value: np.ndarray, grad: np.ndarray, moments: tuple[np.ndarray, np.ndarray], step: int, at) -> None:
    """One step on the rows ``at``; rows without a gradient stay as they are."""
    m, v = moments
    m[at] = 0.9 * m[at] + 0.1 * grad
    v[at] = 0.99 * v[at] + 0.01 * grad * grad
    value[at] -= (RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)).astype(value.dtype)


def gradients(model: Model, texts: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of filters and output, rows of the tables (one table's after another's) that have one, and those.

    Only the window of a filter's largest response passes any on.
    """
    words, at = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    rows, starts = padded(words, at)
    pooled, responses = model.pooled(rows, starts)
    hidden = np.maximum(pooled + model.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.out[:-1] + model.out[-1], -30, 30)))
    d = ((p - toxic) * weight / len(texts)).astype(np.float32)
    out = {"out": np.append(hidden.T @ d, d.sum()) + 1e-4 * model.out}
    dz = (d[:, None] * model.out[:-1]) * (hidden > 0)
    out["bias"] = dz.sum(0)
    seen, moved = [], []
    for n, width in enumerate(WIDTHS):
        z, mine, f = responses[width], dz[:, n * FILTERS : (n + 1) * FILTERS], model.filters[width]
        best = np.stack([s + z[s : e - width].argmax(0) for s, e in zip(starts[:-1], starts[1:])])
        g = 1e-4 * f
        for k in range(width):
            r = rows[:, best + k]
            x = np.concatenate([table[at] for table, at in zip(model.tables, r)], 2)
            g[k] += np.einsum("df,dfe->ef", mine, x)
            back = mine[:, :, None] * f[k].T[None]
            for side in range(TABLES):
                seen.append((r[side] + side * (TABLE + 1)).ravel())
                moved.append(back[:, :, side * DIM : (side + 1) * DIM].reshape(-1, DIM))
        out[f"f{width}"] = g
    touched, to = np.unique(np.concatenate(seen), return_inverse=True)
    total = np.zeros((len(touched), DIM), np.float32)
    np.add.at(total, to, np.concatenate(moved))
    return out, touched, total


def shares(counts: np.ndarray) -> np.ndarray:
    """Logarithms of each language's share of words per table row, from their counts."""
    counts = counts + 0.1
    return np.log(counts / counts.sum(0)).astype(np.float32)


def best_cut(raw: np.ndarray, toxic: np.ndarray) -> float:
    order = np.argsort(-raw, kind="stable")
    raw, hits = raw[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(raw) + 1) + toxic.sum())
    f1[:-1][raw[1:] == raw[:-1]] = -1
    k = int(f1.argmax())
    return float((raw[k] + raw[k + 1]) / 2 if k + 1 < len(raw) else raw[k] - 1)


def fit(docs: DataFrame, labels: DataFrame, words: int = WORDS, chunk_rows: int = CHUNK_ROWS) -> Model:
    """A model of all labelled rows outside the held-out ones; only weights, counts per table row and thresholds reach the driver.

    ``words``: of a shard; ``chunk_rows``: distinct outputs that are put in order together.
    """
    rows = stage(labelled(docs, labels), "toxicity-rows")
    sizes = {r.part: r for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("n_words").alias("words")).collect()}
    mine, rest = sizes.get(False), sizes.get(True)
    if mine is None or mine.toxic in (0, mine.n):
        return Model(constant=mine.toxic / mine.n if mine else 0.0)
    shards, share = min(mine.n, -(-mine.words // words)) or 1, mine.toxic / mine.n
    dealt = rows.where("not part").withColumn("shard", F.pmod(F.shiftright("draw", 16), F.lit(shards)).cast("int"))
    seed, model = 5, fresh(5)
    one = dealt.where("shard = 0") if shards > 1 else dealt
    model = moved(model, one, shards, share, EPOCHS, seed, LEAST_STEPS)
    for n in range(ROUNDS if shards > 1 else 0):
        model = moved(model, dealt, shards, share, EPOCHS // ROUNDS, seed + 1 + n, 0)
    count_languages(model, rows)
    set_thresholds(model, rows.where("part" if rest and 0 < rest.toxic < rest.n else "not part"), chunk_rows)
    return model


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, lang, part, draw, n_words, words) of all labelled ids outside the held-out rows; ``part``: kept for the thresholds.

    Of rows that repeat an id the one with the smallest hash counts. Words are six bytes each. Texts whose id no label has are mostly left
    out before the join, by a table of bits of ``SIEVE`` hash values; the join decides.
    """
    spark = docs.sparkSession
    docs, labels = (df.withColumn("doc_id", F.col("doc_id").cast("bigint")) for df in (docs, labels))
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64(F.lit("sieve"), "doc_id").bitwiseAND(F.lit(SIEVE - 1))
    found = known.select(place.alias("place")).groupBy(F.shiftright("place", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(place & 7 as int)))").alias("bits")).toArrow()
    sieve = np.zeros(SIEVE >> 3, np.uint8)
    sieve[found["byte"].to_numpy()] = found["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(3).to_numpy()
            batch = batch.filter(pa.array((shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1, pa.bool_()))
            texts = [w[s:e] for _, w, at in codes_of(batch.column(4)) for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(map(len, texts)), pa.int64()), pa.array([packed(t) for t in texts], pa.binary())],
                                             names=["doc_id", "lang", "version", "n_words", "words"])

    source = docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "lang", F.xxhash64("text", "lang").alias("version"), place.alias("place"), "text")
    hashed = small_batches(source).mapInArrow(run, "doc_id bigint, lang string, version bigint, n_words bigint, words binary")
    draw = F.xxhash64(F.lit("toxicity"), "doc_id")
    first = F.min_by(F.struct("toxic", "lang", "n_words", "words"), F.struct("version", "words", "lang"))
    return hashed.join(known, "doc_id").groupBy("doc_id").agg(first.alias("row")).select("doc_id", "row.*", (F.pmod(draw, F.lit(5)) == 0).alias("part"), draw.alias("draw"))


def packed(words: np.ndarray) -> bytes:
    """Word codes without their two empty bytes."""
    return words.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes()


def unpacked(column: pa.Array) -> list[np.ndarray]:
    out = []
    for value in column:
        part = np.frombuffer(value.as_buffer(), "<u2").reshape(-1, 3)
        words = np.zeros((len(part), 4), "<u2")
        words[:, :3] = part
        out.append(words.view("<u8").ravel().astype(np.uint64, copy=False))
    return out


def moved(model: Model, dealt: DataFrame, shards: int, share: float, epochs: int, seed: int, least: int) -> Model:
    """``model`` after each shard of ``dealt`` has moved it by itself: a table row by the mean over the shards that moved it, all else by the mean over all."""
    shared = dealt.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, texts, toxic in by_shard(batches):
            yield pa.RecordBatch.from_pylist(changes(shared, shard, texts, toxic, share, epochs, seed, least), pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("data", pa.binary())]))

    rows = dealt.select("shard", "draw", "doc_id", "toxic", "words").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "draw", "doc_id")
    blocks = small_batches(rows).mapInArrow(run, "block int, shard int, data binary")
    found = blocks.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(means, "block int, data binary").toArrow()
    new = pickle.loads(pickle.dumps(model))
    flat = new.tables.reshape(-1, DIM)
    for block, data in zip(found["block"].to_pylist(), found["data"].to_pylist()):
        mean = np.frombuffer(data, np.float64)
        if block >= 0:
            flat[block * BLOCK : (block + 1) * BLOCK] += mean.reshape(-1, DIM).astype(np.float32)
        else:
            for value, change in zip(new.dense().values(), np.split(mean, np.cumsum([v.size for v in new.dense().values()])[:-1])):
                value += change.reshape(value.shape).astype(np.float32)
    shared.unpersist()
    return new


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(shard, texts, toxic) of rows that come shard by shard."""
    now, texts, toxic = None, [], []
    for batch in batches:
        for shard, label, words in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), unpacked(batch.column(4))):
            if shard != now and texts:
                yield now, texts, np.array(toxic)
                texts, toxic = [], []
            now = shard
            texts.append(words)
            toxic.append(label)
    if texts:
        yield now, texts, np.array(toxic)


def changes(shared: Broadcast, shard: int, texts: list[np.ndarray], toxic: np.ndarray, share: float, epochs: int, seed: int, least: int) -> list[dict]:
    """How one shard moves the net, in blocks of table rows; block -1 holds all else."""
    old, new = shared.value, pickle.loads(pickle.dumps(shared.value))
    learn(new, texts, toxic, share, epochs, seed, least)
    change = (new.tables - old.tables).reshape(-1, DIM).astype(np.float16)
    dense = np.concatenate([(b - a).ravel() for a, b in zip(old.dense().values(), new.dense().values())])
    out = [{"block": n, "shard": shard, "data": change[n * BLOCK : (n + 1) * BLOCK].tobytes()} for n in range(-(-len(change) // BLOCK))]
    return [*out, {"block": -1, "shard": shard, "data": dense.astype(np.float32).tobytes()}]


def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One mean per block of rows (block, shard, change) that come block by block."""
    now, total, n = None, None, None
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(2)):
            if block != now:
                if now is not None:
                    yield mean_of(now, total, n)
                now, total, n = block, 0.0, 0
            change = np.frombuffer(data.as_buffer(), np.float16 if block >= 0 else np.float32).astype(np.float64)
            total = total + change
            n = n + ((change.reshape(-1, DIM) != 0).any(1) if block >= 0 else 1)
    if now is not None:
        yield mean_of(now, total, n)


def mean_of(block: int, total: np.ndarray, n: np.ndarray | int) -> pa.RecordBatch:
    mean = total / (np.repeat(np.maximum(n, 1), DIM) if block >= 0 else n)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["block", "data"])


def count_languages(model: Model, rows: DataFrame) -> None:
    """Set the languages and their word shares from all ``rows``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = unpacked(batch.column(1)), batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                word, n = np.unique(np.concatenate([t for t, x in zip(texts, langs) if x == lang]) % np.uint64(TABLE), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(word), pa.string()), pa.array(word.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])

    known = rows.where("lang is not null").select("lang", "words")
    model.langs = sorted(r.lang for r in known.select("lang").distinct().collect()) or [""]
    found = small_batches(known).mapInArrow(run, "lang string, word int, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts, place = np.zeros((TABLE, len(model.langs))), {x: i for i, x in enumerate(model.langs)}
    counts[found["word"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    model.words = shares(counts)


def set_thresholds(model: Model, rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> None:
    """Cut of the raw output per language with the best F1 over all ``rows``, half-way to the next value; languages with few examples share one."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, lang = (np.concatenate(x) for x in zip(*map(shared.value.raw, unpacked(batch.column(1))))) if batch.num_rows else (np.zeros(0), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(raw), batch.column(0).cast(pa.int32())], names=["lang", "raw", "toxic"])

    scored = small_batches(rows.select("toxic", "words")).mapInArrow(run, "lang int, raw double, toxic int")
    cuts = {r.lang: r for r in best_cuts(scored, chunk_rows).collect()}
    enough = [j in cuts and min(cuts[j].toxic, cuts[j].n - cuts[j].toxic) >= LEAST_OF_CLASS for j in range(len(model.langs))]
    model.cuts = np.array([cuts[j if own else -1].cut for j, own in enumerate(enough)])


def best_cuts(scored: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(lang, cut, n, toxic) of rows (lang, raw, toxic), as :func:`best_cut` has it; lang -1: of all rows. Equal outputs are counted before they are put in order."""
    both = scored.withColumn("lang", F.explode(F.array("lang", F.lit(-1))))
    counts = stage(both.groupBy("lang", (-F.col("raw")).alias("down")).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")), "toxicity-outputs")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    upto = running_totals(with_value_chunks(counts, "down", ["lang"], chunk_rows), ["lang"], ["down"], CHUNK, {"called": F.col("n"), "hits": F.col("toxic")})
    f1 = 2 * F.col("hits") / (F.col("called") + F.col("t.toxic"))
    best = upto.drop("n", "toxic").join(totals.alias("t"), "lang").groupBy("lang").agg(F.max_by("down", F.struct(f1, -F.col("down"))).alias("at"), F.first("t.n").alias("n"), F.first("t.toxic").alias("toxic"))
    after = best.select("lang", "at").join(counts.select("lang", "down"), "lang").where("down > at").groupBy("lang").agg(F.min("down").alias("next"))
    return best.join(after, "lang", "left").select("lang", F.coalesce(-(F.col("at") + F.col("next")) / 2, -F.col("at") - 1).alias("cut"), "n", "toxic")


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from ``CALLED`` up) of every whole text.

    Null and empty texts get the score of no words; repeated rows score alike; ties at the cut count as toxic; without examples of both
    classes every score is the share of toxic ones; an empty table gives no rows; columns of the new names are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(column: pa.Array) -> list[pa.Array]:
        score = scores(shared.value, column)
        return [pa.array(score), pa.array((score >= CALLED).astype(np.int32))]

    return add_columns(docs, text, scored, "score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``CALLED``, with all columns as they are; edge cases as in :func:`with_scores`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda column: scores(shared.value, column) < CALLED)


def scores(model: Model, column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0)] + [model.scores(words, at) for _, words, at in codes_of(column)])
