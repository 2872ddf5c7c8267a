"""Sources and sinks: typed scans, CSV exchange, staged tables, run logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from icuflow.session import scratch_path


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself, or an error that lists every missing column."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def scan(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """Parquet table with only the named columns read."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return require_columns(df, *columns).select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> str:
    """CSV sink with header and no index column, one file per task."""
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV source with header and a stated schema; nothing is inferred."""
    return (
        spark.read.schema(schema).option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    )


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back; cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stack_runs(frames: list[DataFrame], stride: int = 9) -> DataFrame:
    """Stack run logs, the i-th log's run numbers moved by ``i * stride``."""
    moved = [f.withColumn("run_number", F.col("run_number") + i * stride) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, moved)


def load_run_logs(
    spark: SparkSession, paths: list[str], schema: StructType | str, stride: int = 9
) -> DataFrame:
    """Run logs stacked, the i-th path's run numbers moved by ``i * stride``; each path is read by itself."""
    return stack_runs([read_csv(spark, path, schema) for path in paths], stride)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Row-capped fetch; the order makes "first" repeatable."""
    return df.orderBy(*order).limit(n)
