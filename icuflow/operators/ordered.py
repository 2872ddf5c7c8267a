"""Ordered operators that never put a whole key into one task.

A plain window puts every row of a key in one task, which a hot key does not survive. Here the rows
of a key are cut into chunks that follow the order (a span of time, a span of values); the window
runs inside (key, chunk), one summary row per chunk is carried over the key, and the two are joined.
The carried table has one row per chunk, not per input row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.functions.values import epoch
from icuflow.sources.tables import stage

CHUNK = "_chunk"
CHUNK_ROWS = 1_000_000
Hold = Callable[[DataFrame, str], DataFrame]


def keep(df: DataFrame, name: str) -> DataFrame:
    """The default ``hold``: nothing is staged."""
    return df


def time_chunk(time: str | Column, seconds: int = 3600) -> Column:
    """Chunk by a fixed span of time."""
    return F.floor(epoch(F.col(time) if isinstance(time, str) else time) / seconds)


def with_value_chunks(df: DataFrame, value: str, keys: Sequence[str] = (), rows: int = CHUNK_ROWS) -> DataFrame:
    """Add a chunk number that grows with (keys, value): ranges of about ``rows`` rows each, as many as that takes.

    Spark cuts the ranges from a sample. They are written once, so that all later reads see the same chunks; equal values share one.
    Up to ``rows`` rows are one chunk.
    """
    chunks = -(-df.count() // rows)
    if chunks < 2:
        return df.withColumn(CHUNK, F.pmod(F.hash(value), F.lit(1)))  # zero, but no constant: joins on it stay equi joins
    return stage(df.repartitionByRange(chunks, *keys, value).withColumn(CHUNK, F.spark_partition_id()), "chunks")


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: str,
    wanted: dict[str, tuple[Column, Column]],
) -> DataFrame:
    """For each output the value of the nearest earlier row of the key that meets a condition.

    ``wanted`` maps an output name to (value, condition); ``lit(True)`` as condition is a plain lag.
    ``order`` should be unique within a key, or equal rows may come in any order. The input is read
    twice (rows and chunk ends): stage it when it is costly.
    """
    part = [*keys, chunk]
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    boxed = {o: (F.struct(v.alias("v")), c) for o, (v, c) in wanted.items()}
    local = df.select("*", *[
        F.last(F.when(c, box), ignorenulls=True).over(inside).alias(f"_in_{o}") for o, (box, c) in boxed.items()
    ])
    ends = df.groupBy(*part).agg(*[
        F.max_by(box, F.when(c, F.struct(*order))).alias(f"_end_{o}") for o, (box, c) in boxed.items()
    ])
    carried = ends.select(*part, *[
        F.last(f"_end_{o}", ignorenulls=True).over(across).alias(f"_carry_{o}") for o in boxed
    ])
    return local.join(carried, part, "left").select(
        *df.columns, *[F.coalesce(f"_in_{o}", f"_carry_{o}")["v"].alias(o) for o in boxed]
    )


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: str, sums: dict[str, Column],
    ties_together: bool = False,
) -> DataFrame:
    """Running sums along the key; ``ties_together`` gives rows of equal order the same total."""
    part = [*keys, chunk]
    inside = W.partitionBy(*part).orderBy(*order)
    inside = (
        inside.rangeBetween(W.unboundedPreceding, W.currentRow) if ties_together
        else inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    across = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    local = df.select("*", *[F.sum(c).over(inside).alias(f"_in_{o}") for o, c in sums.items()])
    ends = df.groupBy(*part).agg(*[F.sum(c).alias(f"_end_{o}") for o, c in sums.items()])
    carried = ends.select(*part, *[F.sum(f"_end_{o}").over(across).alias(f"_carry_{o}") for o in sums])
    return local.join(carried, part, "left").select(
        *df.columns,
        *[(F.col(f"_in_{o}") + F.coalesce(F.col(f"_carry_{o}"), F.lit(0))).alias(o) for o in sums],
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: str, name: str
) -> DataFrame:
    """``row_number`` along the key."""
    return running_totals(df, keys, order, chunk, {name: F.lit(1).cast("long")})


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in the given order: one aggregation with map-side combine, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    ).select(*keys, "_row.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Last row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    ).select(*keys, "_row.*")


def ecdf(
    df: DataFrame, value: str, keys: Sequence[str] = (), chunk: Column | None = None, hold: Hold = keep, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(keys, value, n, below, total, ecdf): distinct values with their cumulative share.

    Equal values are counted before anything is ordered, so a frequent value costs one row. The
    counts are read several times; ``hold`` lets the caller stage them so that ``df`` is read once.
    """
    counts = hold(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), "counts")
    return counted_ecdf(counts, value, keys, chunk, rows)


def counted_ecdf(counts: DataFrame, value: str, keys: Sequence[str] = (), chunk: Column | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """:func:`ecdf` of values that are counted already, in the column ``n``."""
    counts = with_value_chunks(counts, value, keys, rows) if chunk is None else counts.withColumn(CHUNK, chunk)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    group = [*keys] or ["_all"]
    if not keys:
        counts = counts.withColumn("_all", F.lit(0))
    run = running_totals(counts, group, [value], CHUNK, {"upto": F.col("n")})
    run = run.join(totals, [*keys]) if keys else run.withColumn("total", totals.scalar())
    return run.select(
        *keys, value, "n", (F.col("upto") - F.col("n")).alias("below"), "total",
        (F.col("upto") / F.col("total")).alias("ecdf"),
    )


def exact_quantiles(counts: DataFrame, value: str, keys: Sequence[str], shares: dict[str, float], rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, a column per share): quantiles of counted values (``n`` each), interpolated between neighbours.

    The two values around a quantile are those whose ranks hold its place, found by running totals over chunks of values, so no key is in one task.
    Null values don't count; a key without any has no row.
    """
    table = counted_ecdf(counts.where(F.col(value).isNotNull()), value, keys, None, rows)
    place = {name: (F.col("total") - 1) * F.lit(float(share)) for name, share in shares.items()}

    def at(rank):
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col(value)))
    found = table.groupBy(*keys).agg(
        F.max("total").alias("total"), *[at(F.floor(p)).alias(f"_low_{n}") for n, p in place.items()], *[at(F.ceil(p)).alias(f"_high_{n}") for n, p in place.items()])
    low, high = (lambda n: F.col(f"_low_{n}")), (lambda n: F.col(f"_high_{n}"))
    return found.select(*keys, *[(low(n) + (high(n) - low(n)) * (p - F.floor(p))).alias(n) for n, p in place.items()])


def quantile_curve(
    df: DataFrame, value: str, keys: Sequence[str] = (), chunk: Column | None = None, block: int = 65536,
    hold: Hold = keep, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sorted curve: one row per input row, x = i / n and y = the i-th smallest value.

    The rows of a frequent value are written in blocks that are spread over the tasks first.
    """
    table = ecdf(df, value, keys, chunk, hold, rows)
    blocks = table.select(
        *keys, "total", value, (F.col("below") + F.col("n")).alias("stop"),
        F.explode(F.sequence(F.col("below"), F.col("below") + F.col("n") - 1, F.lit(block).cast("long"))).alias("at"),
    ).repartition(*keys, value, "at")
    return blocks.select(
        *keys, "total", value,
        F.explode(F.sequence("at", F.least(F.col("stop"), F.col("at") + block) - 1)).alias("i"),
    ).select(*keys, "i", (F.col("i") / F.col("total")).alias("x"), F.col(value).alias("y"))
