"""Sampling of synthetic cohorts as table operators, with repeatable draws from id hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.functions.values import hashed_uniform
from icuflow.operators.joins import join_stays
from icuflow.operators.ordered import CHUNK, ecdf, number_rows, previous_values

ROWS = 1_000_000


def inverse_cdf(draws: DataFrame, table: DataFrame, keys: Sequence[str], u: str, value: str, closed: str) -> DataFrame:
    """Draw a value from an ECDF table for each uniform ``u``.

    ``closed="left"``: first value whose ECDF is above u (categories). ``closed="right"``: first value whose ECDF reaches u (numbers; the
    same as one more than the largest integer below it; a draw of exactly zero takes the first value). Draws and steps are laid on
    one axis from 1 down to 0, cut into chunks of about ROWS rows, and each draw takes the nearest step before it: the work grows with
    draws plus steps. Draws without a value, a null ``u`` or a null key give no row.
    """
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True))
    first = closed == "right"  # whether a step stands before the draws at its place
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in draws.schema if f.name not in keys]
    points = draws.where(F.col(u).isNotNull() & known).select(
        *draws.columns, F.lit(None).cast(table.schema[value].dataType).alias("_value"), (-F.col(u)).alias("_at"), F.lit(1 if first else 0).alias("_side"),
    ).unionByName(table.where(known).select(
        *keys, *absent, F.col(value).alias("_value"), (-F.col("ecdf")).alias("_at"), F.lit(0 if first else 1).alias("_side"),
    ))
    step = F.col("_side") == F.lit(0 if first else 1)
    chunked = points.withColumn(CHUNK, F.floor(F.col("_at") * chunks_of(points)))
    group = [*keys] or ["_all"]
    if not keys:
        chunked = chunked.withColumn("_all", F.lit(0))
    drawn = previous_values(chunked, group, ["_at", "_side"], CHUNK, {"_drawn": (F.struct(F.col("_value").alias("value")), step)})
    return drawn.where(~step & F.col("_drawn").isNotNull()).select(*draws.columns, F.col("_drawn.value").alias(value))


def chunks_of(df: DataFrame, rows: int = ROWS) -> Column:
    """In how many chunks of a uniform number ``df`` is cut, so that one has about ``rows`` rows."""
    return df.agg(F.ceil(F.count(F.lit(1)) / rows) + 7).scalar()


def draw_categories(draws: DataFrame, observed: DataFrame, keys: Sequence[str], u: str, value: str) -> DataFrame:
    """Category per draw given its band; categories are taken in lexical order (a dictionary's size)."""
    return inverse_cdf(draws, ecdf(observed, value, keys, F.lit(0)), keys, u, value, "left")


def draw_numbers(draws: DataFrame, observed: DataFrame, u: str, value: str) -> DataFrame:
    return inverse_cdf(draws, ecdf(observed, value), [], u, value, "right")


def bernoulli(draws: DataFrame, observed: DataFrame, key: str, event: Column, u: str, draw_id: str, name: str) -> DataFrame:
    """0/1 per draw with the event share of its category."""
    shares = observed.groupBy(key).agg(F.avg(event).alias("_p"))
    return join_stays(draws, shares, [key], [draw_id]).withColumn(name, (F.col(u) < F.col("_p")).cast("int")).drop("_p")


def matched_donor(
    draws: DataFrame, donors: DataFrame, keys: Sequence[str], u: str, draw_id: str, donor_id: str, measures: Sequence[str],
    enough: int = 10,
) -> DataFrame:
    """Values for each draw from the donors that agree on all keys.

    ``enough`` donors: the values of one of them, chosen by ``u``. Fewer: the mean over the cohort.
    None: no match, values null. Donors are numbered within their cohort in chunks of a hash, so a
    cohort that holds most donors is not sorted in one task.
    """
    cohort = donors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(m).alias(f"_mean_{m}") for m in measures])
    spread = donors.select(*keys, donor_id, *measures, hashed_uniform(F.col(donor_id), "donor").alias("_u")).withColumn(
        CHUNK, F.floor(F.col("_u") * chunks_of(donors))
    )
    numbered = number_rows(spread, keys, ["_u", donor_id], CHUNK, "_place").drop("_u", CHUNK)
    sized = join_stays(draws, cohort, keys, [draw_id], how="left").withColumn("_place", F.floor(F.col(u) * F.col("_n")) + 1)
    chosen = sized.join(numbered, [*keys, "_place"], "left")
    found = F.col("_n") >= enough
    return chosen.select(
        *draws.columns, *[F.when(found, F.col(m)).otherwise(F.col(f"_mean_{m}")).alias(m) for m in measures],
        F.when(found, F.col(donor_id)).alias(donor_id),
        F.when(found, "donor").when(F.col("_n").isNotNull(), "mean").otherwise("none").alias("matched"),
    )


def with_noise(drawn: DataFrame, spread: DataFrame, keys: Sequence[str], draw_id: str, measure: str) -> DataFrame:
    """Results of :func:`matched_donor` in which a mean is replaced by a normal draw around it.

    ``spread`` has one row per ``keys`` with the column ``std``, as :func:`widened_std` gives it. The draw is repeatable: two independent
    uniform numbers from the id by the Box-Muller rule. Without a deviation the mean stays; values of donors stay as they are.
    """
    uniform = [hashed_uniform(F.col(draw_id), f"noise{i}|{measure}") for i in (1, 2)]
    normal = F.sqrt(-2 * F.log(1 - uniform[0])) * F.cos(2 * math.pi * uniform[1])
    wide = join_stays(drawn, spread.select(*keys, F.col("std").alias("_std")), keys, [draw_id], how="left")
    moved = F.col(measure) + F.when(F.col("matched") == "mean", F.coalesce(F.col("_std") * normal, F.lit(0.0))).otherwise(0.0)
    return wide.withColumn(measure, moved).select(*drawn.columns)


def widened_std(
    draws: DataFrame, donors: DataFrame, keys: Sequence[str], age: str, band, measure: str, reach: int = 25,
) -> DataFrame:
    """Mean over the cohort of a draw and sample deviation over it and its two neighbours in age.

    ``band`` maps an age column to its band. Cohorts are reduced to (n, mean, squared distances) before
    anything is joined, and merged without cancellation; the distinct (keys, age) of the draws are graded once.
    """
    x = F.col(measure).cast("double")
    cohorts = donors.withColumn("_band", band(F.col(age))).groupBy(*keys, "_band").agg(
        F.count(measure).alias("_n"), F.avg(x).alias("_m"), (F.var_pop(x) * F.count(measure)).alias("_d")
    ).where("_n > 0")
    a = F.col(age)
    wanted = draws.select(*keys, age).distinct().withColumn("_own", band(a)).withColumn(
        "_band", F.explode(F.array_distinct(F.array(band(a), band(a + reach), band(a - reach))))
    )
    own = F.col("_band") == F.col("_own")
    joined = wanted.join(cohorts, [*keys, "_band"]).groupBy(*keys, age).agg(
        F.max(F.when(own, F.col("_m"))).alias("mean"), F.sort_array(F.collect_list(F.struct("_band", "_n", "_m", "_d"))).alias("_parts"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("_n"), F.lit(0.0).alias("_m"), F.lit(0.0).alias("_d"))
    whole = F.aggregate("_parts", start, _merged)  # three parts at most
    return joined.withColumn("_w", whole).select(
        *keys, age, "mean", F.when(F.col("_w._n") > 1, F.sqrt(F.col("_w._d") / (F.col("_w._n") - 1))).alias("std"),
    )


def _merged(a: Column, b: Column) -> Column:
    """Count, mean and sum of squared distances of two parts together."""
    n, apart = a._n + b._n, b._m - a._m
    return F.struct(
        n.alias("_n"), (a._m + apart * b._n / n).alias("_m"), (a._d + b._d + apart * apart * a._n * b._n / n).alias("_d")
    )


def kde(df: DataFrame, value: str, grid: Sequence[float], bandwidth: float) -> DataFrame:
    """Gaussian kernel density on a fixed grid; equal values are counted first."""
    counts = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    z = (F.col("x") - F.col("v")) / bandwidth
    points = counts.withColumn("x", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    scale = 1.0 / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    return points.groupBy("x").agg(F.sum(F.col("n") * F.exp(-z * z / 2)).alias("s")).select(
        "x", (F.col("s") / total * scale).alias("density")
    )
