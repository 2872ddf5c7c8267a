"""Joins of tall event tables with stays, spells and earlier measurements.

None of them needs a whole stay in one task: the stay join is salted, interval joins and look-back
joins are keyed by (stay, time bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.functions.values import epoch, micros

SALTS = 16


def may_be_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size estimate is under its threshold for broadcasts."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def join_stays(
    events: DataFrame, stays: DataFrame, on: Sequence[str], spread_by: Sequence[str],
    within: Column | None = None, salts: int = SALTS, how: str = "inner",
) -> DataFrame:
    """Join of events with the one row of their stay, then a time-window test on both.

    Spark broadcasts the stays, once each, when their size is under its threshold. Beyond it both sides are
    shuffled on (key, salt): the rows of one hot stay are spread over ``salts`` tasks by a hash of
    ``spread_by`` and the small stay row is repeated once per salt, so the join stays exact. Nothing
    above needs the (key, salt) layout, so adaptive execution can split a partition that is still
    too large without another shuffle.
    """
    if may_be_broadcast(stays):  # Spark's estimate doesn't see the salts: it would broadcast the repeated rows
        joined = events.join(stays, [*on], how)
        return joined if within is None else joined.filter(within)
    salted = events.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = stays.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = salted.join(repeated, [*on, "_salt"], how).drop("_salt")
    return joined if within is None else joined.filter(within)


def interval_join(
    points: DataFrame, spells: DataFrame, on: Sequence[str], time: str, start: str, end: str,
    bucket_seconds: int = 86400, how: str = "left",
) -> DataFrame:
    """Points with the spells that contain them, both ends closed.

    Time is cut into buckets of ``bucket_seconds``, and these are paired level by level into buckets twice as wide. A spell is listed at
    the first level whose buckets are no shorter than it, where it touches two at most, and a point asks one bucket of each level
    that any spell has. So the range test becomes an equi join on (key, level, bucket) with a small residual, a spell of
    any length costs two rows, and a candidate is never further off than a few lengths of the spell.
    """
    unit = F.lit(bucket_seconds).cast("double")
    # a spell that ends before it starts holds no point
    sound = spells.filter(F.col(end) >= F.col(start))
    buckets = F.greatest(F.ceil((epoch(F.col(end)) - epoch(F.col(start))) / unit), F.lit(1))
    levelled = sound.withColumn("_level", F.ceil(F.log2(buckets)).cast("int"))

    def bucket(col, level):
        return F.floor(epoch(F.col(col)) / (unit * F.pow(F.lit(2.0), level)))

    listed = levelled.withColumn("_bucket", F.explode(F.sequence(bucket(start, F.col("_level")), bucket(end, F.col("_level")))))
    levels = levelled.agg(F.coalesce(F.array_sort(F.collect_set("_level")), F.array().cast("array<int>"))).scalar()  # a few dozen at most
    asked = points.select("*", F.posexplode_outer(levels).alias("_place", "_level"))
    left = asked.withColumn("_bucket", bucket(time, F.col("_level"))).alias("p")
    right = listed.withColumn("_hit", F.lit(True)).alias("s")
    test = (F.col(f"p.{time}") >= F.col(f"s.{start}")) & (F.col(f"p.{time}") <= F.col(f"s.{end}"))
    for key in [*on, "_level", "_bucket"]:
        test = test & (F.col(f"p.{key}") == F.col(f"s.{key}"))
    kept = [F.col(f"s.{c}") for c in spells.columns if c not in on]
    joined = left.join(right, test, how).select("p.*", *kept, "s._hit")
    if how == "inner":
        return joined.drop("_bucket", "_level", "_place", "_hit")
    # a point without any spell keeps one of its copies; rows that can't match, for a null, don't meet in one group
    unknown = F.col(time).isNull()
    for key in on:
        unknown = unknown | F.col(key).isNull()
    apart = F.when(unknown, F.xxhash64(*points.columns)).otherwise(F.lit(0))
    found = F.max(F.col("_hit")).over(W.partitionBy(*on, time, apart))
    seen = joined.withColumn("_found", found).where("_hit or (_found is null and coalesce(_place, 0) = 0)")
    return seen.drop("_bucket", "_level", "_place", "_hit", "_found")


def asof_lookback(
    probes: DataFrame, measures: DataFrame, on: Sequence[str], time: str, values: Sequence[str],
    lookback_seconds: int, tie: Sequence[str] = (), strategy: str = "window", chunks: int = 16,
) -> DataFrame:
    """Each probe with the latest measure at or before it, no older than the look-back, to the microsecond.

    Probes keep their columns; ``values`` come from the measure (null when none qualifies). Equal
    times are decided by the largest ``tie``. A null key or time matches nothing.

    ``strategy="window"``: time is cut into chunks of a ``chunks``-th of the look-back. Union and one growing-frame
    window per (key, chunk); the last measure of the chunks before is carried in. The carrying window
    sees one row per key and chunk, so no task holds a look-back's worth of a busy key.
    ``strategy="join"``: equi join on (key, bucket), then the latest match per probe; fit for few
    measures per bucket and for probes that are unique on (key, time).
    """
    span = lookback_seconds * 1_000_000
    found = F.struct(F.col(time).alias("at"), *[F.col(c) for c in tie if c != time], *values)
    right = measures.dropna(subset=[*on, time]).select(*on, found.alias("found"))
    fresh = lambda at: micros(at) - micros(F.col("found.at")) <= span
    if strategy == "join":
        keys = [*on, "_bucket"]
        left = probes.withColumn("_bucket", F.floor(micros(F.col(time)) / span))
        right = right.withColumn("_bucket", F.floor(micros(F.col("found.at")) / span))
        both = right.withColumn("_bucket", F.explode(F.array(F.col("_bucket"), F.col("_bucket") + 1)))
        probe_key = [*keys, time]
        latest = (
            left.select(*probe_key).join(both, keys)
            .filter((F.col("found.at") <= F.col(time)) & fresh(F.col(time)))
            .groupBy(*probe_key).agg(F.max("found").alias("found"))
        )
        out = left.join(latest, probe_key, "left")
        return out.select(*probes.columns, *[F.col(f"found.{v}").alias(v) for v in values])
    keys, width = [*on, "_bucket"], max(span // chunks, 1)
    right = right.withColumn("_bucket", F.floor(micros(F.col("found.at")) / width))
    left = probes.withColumn("_bucket", F.floor(micros(F.col(time)) / width))
    kind = right.schema["found"].dataType
    last = right.groupBy(*keys).agg(F.max("found").alias("found"))
    asked = left.select(*keys).dropna().distinct().withColumn("found", F.lit(None).cast(kind))
    each = last.unionByName(asked).groupBy(*keys).agg(F.max("found").alias("found"))  # one row per key and chunk
    before = W.partitionBy(*on).orderBy("_bucket").rangeBetween(-chunks - 1, -1)
    carried = each.withColumn("found", F.max("found").over(before)).where("found is not null")
    row = F.struct(*probes.columns)
    feed = (
        right.select(*keys, F.col("found.at").alias("_t"), F.lit(0).alias("_side"), "found")
        .unionByName(carried.select(*keys, F.col("found.at").alias("_t"), F.lit(0).alias("_side"), "found"))
        .withColumn("row", F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType))
        .unionByName(left.select(
            *keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("found"), row.alias("row"),
        ))
    )
    so_far = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    seen = feed.withColumn("found", F.max("found").over(so_far)).filter(F.col("_side") == 1)
    return seen.select("row.*", *[F.when(fresh(F.col("_t")), F.col(f"found.{v}")).alias(v) for v in values])
