"""Item codes to concepts: code map, plausibility range, unit change, conditional pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.rules import items

MAP_COLUMNS = "itemid, concept, low, low_closed, high, high_closed, shift, divide"


def item_map(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Constant inline table with one row per item code; its size is that of the vocabulary."""
    def literal(x):
        if x is None:
            return "CAST(NULL AS DOUBLE)"
        return f"{x!r}D" if isinstance(x, float) else repr(x)
    listed = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS m({MAP_COLUMNS})")


def vital_map(spark: SparkSession) -> DataFrame:
    rows = []
    for concept, specs in items.VITALS.items():
        for codes, low, low_closed, high, high_closed in specs:
            for code in codes:
                shift, divide = (-32.0, 1.8) if code in items.FAHRENHEIT_CODES else (0.0, 1.0)
                rows.append((code, concept, float(low), low_closed, None if high is None else float(high),
                             high_closed, shift, divide))
    return item_map(spark, rows)


def lab_map(spark: SparkSession) -> DataFrame:
    return item_map(spark, [
        (code, name, None, False, float(limit), True, 0.0, 1.0)
        for name, (codes, limit) in items.LABS.items() for code in codes
    ])


def to_concepts(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Known items only, with ``concept`` and ``num``: null when implausible, then unit-changed.

    The map is a constant vocabulary (tens of rows), hence the broadcast hint.
    """
    v = F.col("valuenum")
    above = F.col("low").isNull() | F.when(F.col("low_closed"), v >= F.col("low")).otherwise(v > F.col("low"))
    below = F.col("high").isNull() | F.when(F.col("high_closed"), v <= F.col("high")).otherwise(v < F.col("high"))
    named = events.join(F.broadcast(mapping), "itemid")
    return named.withColumn("num", F.when(above & below, (v + F.col("shift")) / F.col("divide"))).drop(
        "low", "low_closed", "high", "high_closed", "shift", "divide"
    )


_AGGREGATE = {"min": "min", "max": "max", "mean": "avg"}


def concept_columns(concepts: Sequence[str], stats: Sequence[str], concept: str = "concept", value: str = "num") -> list[Column]:
    """Aggregates ``<concept>_<stat>`` of a conditional pivot, all in one pass over the rows."""
    return [
        F.expr(f"{_AGGREGATE[s]}(CASE WHEN {concept} = '{c}' THEN {value} END) AS {c}_{s}") for c in concepts for s in stats
    ]


def max_columns(names: Sequence[str], value: str = "num") -> list[Column]:
    """Aggregates named like the concepts themselves."""
    return [F.expr(f"max(CASE WHEN concept = '{n}' THEN {value} END) AS {n}") for n in names]
