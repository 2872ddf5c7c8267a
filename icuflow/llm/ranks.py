"""Running sums over a global order, without a window over a whole key.

Rows are range-partitioned by group and order, summed inside each task as a stream, written once, and each task's total per
group is carried to the tasks after it. A group of any size spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from icuflow.llm.batches import small_batches
from icuflow.sources.tables import stage


def prefix_sums(df: DataFrame, order: list[Column], weight: str, group: str | None = None, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of the long column ``weight`` over all earlier rows of the group.

    Null weights count as 0, a null group is a group. Rows that tie in the whole order stand in any order. The working
    columns start with ``_ranks``.
    """
    keys = [F.col(group).asc_nulls_last(), *order] if group else order
    df = df.drop(name)
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = StructType([*df.schema.fields, StructField("_ranks_part", IntegerType()), StructField("_ranks_own", LongType())])
    at_weight, at_group = df.columns.index(weight), df.columns.index(group) if group else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            w = pc.fill_null(batch.column(at_weight), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.zeros(n, bool)
            if group:
                column = batch.column(at_group)
                code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
                first[1:] = code[1:] != code[:-1]
                first[0] = column[0].as_py() != last
                last = column[n - 1].as_py()
            before = np.cumsum(w) - w
            at = np.flatnonzero(first)
            base = np.zeros(n, np.int64)
            base[at] = np.diff(before[at], prepend=0)
            own = before - np.cumsum(base)
            own[: at[0] if len(at) else n] += total
            total = int(own[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(own)], names=[f.name for f in schema])

    rows = stage(small_batches(sorted_rows).mapInArrow(run, schema), "ranks")
    by = [F.col(group).alias("_ranks_group")] if group else [F.lit(0).alias("_ranks_group")]
    totals = rows.groupBy("_ranks_part", *by).agg(F.sum(weight).alias("_ranks_sum"))
    earlier = Window.partitionBy("_ranks_group").orderBy("_ranks_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_ranks_part").alias("_ranks_to"), "_ranks_group", F.coalesce(F.sum("_ranks_sum").over(earlier), F.lit(0)).alias("_ranks_base"),
    )
    same = rows._ranks_part == carried._ranks_to
    if group:
        same &= rows[group].eqNullSafe(carried._ranks_group)
    joined = rows.join(carried, same, "left")
    return joined.withColumn(name, F.col("_ranks_own") + F.col("_ranks_base")).select(*df.columns, name)
