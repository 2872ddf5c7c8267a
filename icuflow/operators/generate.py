"""Row generators: stay-days, repeated procedures, complete day axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_snapshots(stays: DataFrame, stay: str, start: str, end: str, died: Column) -> DataFrame:
    """One row per stay-day; ``out_flag`` is 0, on the last day 1 for a death and -1 for a discharge.

    A stay that ends before it starts has no day.
    """
    first, last = F.to_date(start), F.to_date(end)
    days = stays.filter(last >= first).select(
        stay, first.alias("_first"), last.alias("_last"), died.alias("_died"), F.explode(F.sequence(first, last)).alias("date")
    )
    return days.select(
        stay, "date", F.date_diff("date", "_first").alias("day_of_stay"),
        F.when(F.col("date") != F.col("_last"), 0).when(F.col("_died"), 1).otherwise(-1).alias("out_flag"),
    )


def repeat_days(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """Each row once per day number from ``start`` to ``end``; none when reversed or unknown."""
    return df.filter(F.col(end) >= F.col(start)).withColumn(name, F.explode(F.sequence(start, end)))


def densify(df: DataFrame, entities: DataFrame, key: str, day: str, last_day: int, fill: Sequence[str]) -> DataFrame:
    """Every day 0..last_day of every entity, absent days with zeros; rows of later days, and of other entities, stay."""
    axis = entities.select(key, F.explode(F.sequence(F.lit(0), F.lit(last_day))).alias(day))
    return axis.join(df.select(key, day, *fill), [key, day], "full").fillna(0, subset=list(fill))
