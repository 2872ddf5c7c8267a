"""Co-occurrence of codes within a stay, without listing the pairs of a stay.

The codes of interest are the top-k of a rate table (k is a parameter of the report). Each stay
becomes a bit mask over them; equal masks are counted together; and each set bit of a mask adds
to one row of the k x k table. Work is linear in (distinct mask, set bit), not quadratic per stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = 60  # bits used per long


def ranked_codes(rates: DataFrame, code: str, k: int) -> DataFrame:
    """The k codes of highest rate (name breaks ties) with their place 0..k-1."""
    best = rates.orderBy(F.desc("rate"), code).limit(k)
    place = F.row_number().over(W.orderBy(F.desc("rate"), code)) - 1  # at most k rows
    return best.select(code, "rate", place.alias("place"))


def has_bit(word: int, place: int, prefix: str = "mask") -> str:
    return f"(shiftright({prefix}{word}, {place % WORD}) & 1) = 1"


def stay_masks(rows: DataFrame, ranked: DataFrame, stay: str, code: str, k: int, carry: Sequence[Column] = ()) -> DataFrame:
    """One row per stay with a bit mask (``mask0``, ``mask1``, ...) of its ranked codes."""
    words = range((k + WORD - 1) // WORD)
    placed = rows.join(F.broadcast(ranked.select(code, "place")), code)  # k rows
    return placed.groupBy(stay).agg(*carry, *[
        F.expr(f"bit_or(CASE WHEN place DIV {WORD} = {w} THEN shiftleft(1L, place % {WORD}) ELSE 0L END) AS mask{w}")
        for w in words
    ])


def pair_counts(masks: DataFrame, k: int, event: str) -> DataFrame:
    """(a, b, n, events) for places a < b: stays that hold both codes, and those with the event."""
    words = [f"mask{w}" for w in range((k + WORD - 1) // WORD)]
    same = masks.groupBy(*words).agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("events"))
    place = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("a")
    held = F.expr("CASE " + " ".join(
        f"WHEN a DIV {WORD} = {w} THEN (shiftright(mask{w}, a % {WORD}) & 1) = 1" for w in range(len(words))) + " END")
    row = same.select("*", place).filter(held).groupBy("a").agg(*[
        F.expr(f"sum(CASE WHEN {has_bit(j // WORD, j)} THEN {v} END) AS {v}_{j}") for j in range(k) for v in ("n", "events")
    ])
    cells = F.expr(
        f"stack({k}, " + ", ".join(f"{j}, n_{j}, events_{j}" for j in range(k)) + ") AS (b, n, events)"
    )
    return row.select("a", cells).filter((F.col("a") < F.col("b")) & F.col("n").isNotNull())


def stays_with_pairs(masks: DataFrame, pairs: DataFrame, stay: str, k: int) -> DataFrame:
    """(a, b, stay) for the chosen pairs only: each set bit is matched with its pairs, then tested."""
    words = range((k + WORD - 1) // WORD)
    held_a = "CASE " + " ".join(f"WHEN a DIV {WORD} = {w} THEN (shiftright(mask{w}, a % {WORD}) & 1) = 1" for w in words) + " END"
    held_b = "CASE " + " ".join(f"WHEN b DIV {WORD} = {w} THEN (shiftright(mask{w}, b % {WORD}) & 1) = 1" for w in words) + " END"
    bits = masks.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter(F.expr(held_a))
    return bits.join(F.broadcast(pairs), "a").filter(F.expr(held_b)).drop(*[f"mask{w}" for w in words])


def bounded_lists(df: DataFrame, keys: Sequence[str], ids: str, size: int = 1000) -> DataFrame:
    """List-valued column in slices of ``size`` consecutive ids, so that no list grows with the data."""
    return df.withColumn("slice", F.floor(F.col(ids) / size)).groupBy(*keys, "slice").agg(
        F.array_sort(F.collect_set(ids)).alias(ids + "s")
    )
