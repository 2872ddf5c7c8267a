"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams, by rank. A document's own most frequent n-grams are compared with each profile:
the out-of-place distance sums how far the ranks differ, and an n-gram that a profile lacks counts the full length of a profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from icuflow.llm.batches import add_columns, small_batches

LENGTHS = (1, 2, 3)
TOP = 300
CHARS, HELD = 300_000, 2_000_000
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is 2 modulo 4; so are rows without id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams of a text, in lower case with word edges, and their counts; characters beyond 16 bits are folded to 16."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where(_letters()[code], (code & 0xFFFF) ^ (code >> 16), 0)
    code = np.concatenate([[0], code, [0]])
    code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]
    pair = (code[:-1] << 16) | code[1:]
    every = [code[code != 0] + (1 << 60), pair[code[:-1] + code[1:] != 0] + (2 << 60)]
    if len(code) > 2:
        every.append(((pair[:-1] << 16) | code[2:])[code[1:-1] != 0] + (3 << 60))
    return np.unique(np.concatenate(every), return_counts=True)


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, rank from 0): the ``top`` n-grams of each non-null lang over all texts of ``docs``; ties by gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        counted: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= CHARS:
                    mine = counted.setdefault(lang, [])
                    mine.append(grams("\n".join(texts.pop(lang))))
                    size[lang] = 0
                    if sum(len(g) for g, _ in mine) > HELD:
                        counted[lang] = [merged(mine)]
                        if len(counted[lang][0][0]) > HELD // 2:
                            yield from sent(lang, counted.pop(lang)[0])
        for lang in sorted({*texts, *counted}):
            yield from sent(lang, merged([*counted.get(lang, []), grams("\n".join(texts.get(lang, [])))]))

    def sent(lang, counted):
        for i in range(0, len(counted[0]), 100_000):
            g, n = (x[i : i + 100_000] for x in counted)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

    counted = small_batches(docs.where("lang is not null and text is not null").select("lang", "text")).mapInArrow(run, "lang string, gram bigint, n bigint")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def merged(counted: list) -> tuple[np.ndarray, np.ndarray]:
    gram, back = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
    return gram, np.bincount(back, np.concatenate([n for _, n in counted])).astype(np.int64)


@dataclass
class Model:
    """Learnt languages in code point order; ranks of every n-gram of any profile, one column per language."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    top: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 minus its distance as a share of the largest possible; ties go to the first language."""
        gram, n = grams(text or "")
        if not len(gram) or not self.langs:
            return UNKNOWN, 0.0
        gram = gram[np.argsort(-n, kind="stable")[: self.top]]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        apart = np.abs(self.ranks[at[known]] - np.flatnonzero(known)[:, None])
        apart[self.ranks[at[known]] < 0] = self.top
        total = np.minimum(apart, self.top).sum(0) + self.top * (~known).sum()
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (self.top * len(gram))


def fit(docs: DataFrame, top: int = TOP) -> Model:
    """A model of the languages in ``docs``; ``top`` n-grams per language reach the driver."""
    found = profiles(docs, top).collect()
    langs, every = sorted({r.lang for r in found}), np.unique(np.array([r.gram for r in found], np.int64))
    ranks = np.full((len(every), len(langs)), -1, np.int64)
    for r in found:
        ranks[np.searchsorted(every, r.gram), langs.index(r.lang)] = r["rank"]
    return Model(langs, every, ranks, top)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) of every whole text.

    ``und`` with score 0 for texts that are null, empty or without letters, and if nothing was learnt; ties go to the first language;
    repeated rows are predicted alike; an empty table gives no rows; columns of the new names are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(column: pa.Array) -> list[pa.Array]:
        out = [shared.value.predict(t) for t in column.to_pylist()]
        return [pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())]

    return add_columns(docs, text, predicted, "lang_pred string, score double")
