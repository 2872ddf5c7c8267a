"""Small table operators that the plans and queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.operators.ordered import CHUNK, CHUNK_ROWS, number_rows, with_value_chunks
from icuflow.sources.tables import stage

MOST_CATEGORIES = 1_000


def repair_suffixes(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", suffix: str = "_right") -> DataFrame:
    """Join with every clashing right column renamed beforehand, so no name is ambiguous."""
    clash = [c for c in right.columns if c in left.columns and c not in on]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), [*on], how)


def group_rate(df: DataFrame, keys: Sequence[str], event: str, least: int = 10) -> DataFrame:
    """Event share per group for groups with at least ``least`` events."""
    return df.groupBy(*keys).agg(F.sum(event).alias("event_count"), F.count(F.lit(1)).alias("row_count")).filter(
        F.col("event_count") >= least
    ).withColumn("rate", F.col("event_count") / F.col("row_count"))


def category_codes(df: DataFrame, column: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """(value, ordinal from 1) of the distinct values of a column in order: the fit of an encoder, a table of any length.

    Values are numbered inside ranges of ``rows`` values, and the ranges before are added.
    """
    found = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    return number_rows(with_value_chunks(stage(found, "categories"), "value", rows=rows), [], ["value"], CHUNK, "ordinal").select("value", "ordinal")


def fit_categories(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list:
    """Sorted distinct values of a column that becomes one column per value; an error beyond ``most`` of them."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"column {column} has more than {most} values; use category_codes with binary_encode, or pass the values to encode")
    return sorted(r[0] for r in found)


def binary_codes(categories: Sequence, column, prefix: str):
    """Ordinal codes written in bits: 1 for the first category, 0 for an unknown one."""
    listed = F.array(*[F.lit(c) for c in categories])
    return code_bits(F.coalesce(F.array_position(listed, column), F.lit(0)), len(categories), prefix)


def code_bits(ordinal: Column, categories: int, prefix: str) -> list[Column]:
    """Bits of an ordinal, the highest first, as many as the number of categories needs."""
    width = max(1, categories.bit_length())
    return [F.shiftright(ordinal, width - 1 - i).bitwiseAND(F.lit(1)).cast("int").alias(f"{prefix}_{i}") for i in range(width)]


def binary_encode(df: DataFrame, codes: DataFrame, column: str, prefix: str) -> DataFrame:
    """``df`` with the bits of a column's ordinal in ``codes``; 0 for null and unknown values."""
    joined = df.join(codes.withColumnRenamed("value", column), column, "left")
    return joined.select(*df.columns, *code_bits(F.coalesce("ordinal", F.lit(0)), codes.count(), prefix))


def occupancy_share(rows: DataFrame, capacity: DataFrame, keys: Sequence[str], unit: str, units: Sequence[str]) -> DataFrame:
    """Share of capacity (%) per unit, wide; a unit without patients is null."""
    counts = rows.groupBy(*keys).agg(*[
        F.count(F.when(F.col(unit) == u, 1)).alias(u) for u in units
    ])
    return counts.join(capacity, [k for k in keys if k in capacity.columns]).select(
        *keys, *[F.when(F.col(u) > 0, F.col(u) / F.col("capacity") * 100).alias(u) for u in units]
    )
