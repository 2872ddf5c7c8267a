"""Mortality features from single diagnoses and diagnosis pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.values import cap_flag, flag, rate_bin, safe_rate
from icuflow.operators import pairs
from icuflow.operators.ordered import Hold, first_per_key, keep
from icuflow.operators.tables import group_rate
from icuflow.rules import diagnoses as dx


def pair_rates(counts: DataFrame, ranked: DataFrame, code: str, least: int) -> DataFrame:
    """Pairs of at least ``least`` stays with their death rate and the rates of both single codes."""
    def side(s):
        return F.broadcast(ranked.select(
            F.col("place").alias(s), F.col(code).alias(f"{code}_{s}"), F.col("rate").alias(f"rate_{s}")
        ))  # k rows
    return counts.filter(F.col("n") >= least).join(side("a"), "a").join(side("b"), "b").withColumn(
        "rate", safe_rate(F.col("events"), F.col("n"))
    )


def diagnosis_features(
    rows: DataFrame, min_deaths: int = dx.MIN_DEATHS, min_pairs: int = dx.MIN_PAIRS, top: int = dx.TOP_DIAGNOSES,
    hold: Hold = keep,
) -> DataFrame:
    """One row per stay: its first diagnosis, counts of deadly diagnoses, flags of deadly pairs.

    ``rows`` is the diagnosis extract. A diagnosis is graded when it has at least ``min_deaths``
    deaths (row-level rate); pairs are formed among the ``top`` diagnoses by rate and count when
    their rate exceeds one of the single rates by a quarter. Pair rates below one half get no bin.
    ``hold`` is applied to the two tables that are read more than once.
    """
    stay, title, died = "icustay_id", "short_title", "hospital_expire_flag"
    singles = hold(group_rate(rows.select(title, died), [title], died, min_deaths).withColumn(
        "bin", rate_bin(F.col("rate"), dx.SINGLE_BINS, 0)
    ), "singles")
    # rows per (stay, title) are bounded by the codes that share a title
    titled = rows.groupBy(stay, title).agg(F.count(F.lit(1)).alias("n"), F.max(died).alias(died))
    graded = titled.join(singles.select(title, "bin"), title, "left").groupBy(stay).agg(*[
        F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)).alias(f"deathrate_cat_{b}") for b in (1, 2)
    ])

    ranked = pairs.ranked_codes(singles, title, top)
    masks = hold(pairs.stay_masks(titled, ranked, stay, title, top, [F.max(died).alias(died)]), "masks")
    table = pair_rates(pairs.pair_counts(masks, top, died), ranked, title, min_pairs)
    lifted = table.filter(
        (F.col("rate") > dx.LIFT + F.col("rate_a")) | (F.col("rate") > dx.LIFT + F.col("rate_b"))
    ).select("a", "b", rate_bin(F.col("rate"), dx.PAIR_BINS).alias("bin"))
    paired = pairs.stays_with_pairs(masks.drop(died), lifted, stay, top).groupBy(stay).agg(*[
        cap_flag(F.sum(flag(F.col("bin") == b))).alias(f"deathrate_int_cat_{b}") for b in (1, 2)
    ])
    first = first_per_key(rows, [stay], ["seq_num", "icd9_code"])
    return first.join(graded, stay, "left").join(paired, stay, "left").fillna(
        0, subset=["deathrate_int_cat_1", "deathrate_int_cat_2"]
    )
