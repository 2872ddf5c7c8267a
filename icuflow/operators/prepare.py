"""Splitting, balancing and scaling of a feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.functions.values import hashed_uniform


def split_name(key: str, test_share: float = 0.25):
    """"test" or "train" from a hash of the id: the same row always falls on the same side."""
    return F.when(hashed_uniform(F.col(key), "split") < test_share, "test").otherwise("train")


def undersample(df: DataFrame, label: str, key: str, rows: int = 1_000_000) -> DataFrame:
    """Every class cut to the size of the smallest, rows taken in the order of an id hash.

    Rows are counted per (class, range of the hash), a range holding about ``rows`` rows. Ranges that lie wholly below the cut are kept
    as they are and those above go, without any sort; only the one range per class in which the cut falls is ranked. A null label is a
    class; rows with a null key come first.
    """
    ranges = df.agg(F.ceil(F.count(F.lit(1)) / rows) + 63).scalar()
    hashed = df.withColumn("_u", F.coalesce(hashed_uniform(F.col(key), "balance"), F.lit(0.0))).withColumn("_range", F.floor(F.col("_u") * ranges))
    counts = hashed.groupBy(F.col(label).alias("_class"), "_range").agg(F.count(F.lit(1)).alias("_n"))
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_class").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("_left", smallest - before).where((F.col("_left") > 0) & (F.col("_left") <= F.col("_n")))
    cut = cut.select("_class", F.col("_range").alias("_cut"), "_left")  # one row per class
    placed = hashed.join(cut, F.col(label).eqNullSafe(F.col("_class")))
    edge = placed.where(F.col("_range") == F.col("_cut")).withColumn("_place", F.row_number().over(W.partitionBy("_class").orderBy("_u", key)))
    kept = placed.where(F.col("_range") < F.col("_cut")).select(*df.columns)
    return kept.unionByName(edge.where(F.col("_place") <= F.col("_left")).select(*df.columns))


def scale(train: DataFrame, columns: Sequence[str], *tables: DataFrame) -> list[DataFrame]:
    """Z-scores with mean and population deviation of ``train``, applied to every table.

    A constant column keeps its distance from the mean. The fit is one row, read as a scalar
    subquery.
    """
    fit = train.agg(F.struct(*[
        x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))
    ]).alias("fit")).scalar()

    def apply(df):
        held = df.withColumn("_fit", fit)
        spread = {c: F.when(F.col(f"_fit.s_{c}") == 0, 1.0).otherwise(F.col(f"_fit.s_{c}")) for c in columns}
        return held.withColumns({c: (F.col(c) - F.col(f"_fit.m_{c}")) / spread[c] for c in columns}).drop("_fit")
    return [apply(t) for t in tables]
