"""Day-level feature table: stay features, scores, vital signs, snapshots, care time, procedures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.functions.values import cap_flag, chapter, code_prefix_number, flag, one_hot
from icuflow.operators.generate import daily_snapshots, repeat_days
from icuflow.operators.joins import join_stays
from icuflow.operators.ordered import first_per_key
from icuflow.operators.tables import binary_codes
from icuflow.rules import diagnoses as dx

# score columns kept as features, next to the vital signs
SCORE_FEATURES = [
    "preiculos", "gcs", "heartrate", "meanbp", "resprate", "temp", "urineoutput", "mechvent", "electivesurgery",
    "respiration", "coagulation", "liver", "cardiovascular", "cns", "renal",
]
CHAPTER_LABELS = sorted([label for _, _, label in dx.CHAPTERS] + [dx.OTHER_CHAPTER])
ENCODED = {"gender": "gender_", "icustay_age_group": "age_group_", "admission_type": "admission_type_",
           "insurance": "insurance_type_", "curr_careunit": "careunit_"}


def scores_by_subject(scores: DataFrame) -> DataFrame:
    """Scores of the first stay of each subject (lowest id), as the extract keeps one row per subject."""
    return first_per_key(scores.select("subject_id", "icustay_id", *SCORE_FEATURES), ["subject_id"], ["icustay_id"]).drop("subject_id")


def stay_features(main: DataFrame, scores: DataFrame, vitals: DataFrame, categories: dict[str, Sequence[str]]) -> DataFrame:
    """Diagnosis features with scores (left) and vital signs (inner), categories one-hot encoded.

    ``categories`` holds the fitted categories per encoded column; the first of each is dropped.
    """
    rows = main.join(scores_by_subject(scores), "icustay_id", "left").join(
        vitals.drop("subject_id", "hadm_id"), "icustay_id"
    )
    dummies = [c for name, prefix in ENCODED.items() for c in one_hot(F.col(name), categories[name], prefix)]
    label = chapter(code_prefix_number(F.col("icd9_code")))
    return rows.select(
        "*", *dummies, label.alias("icd9_code_cat"),
        F.date_add(F.to_date("intime"), "diff").alias("intime_actual"), F.date_add(F.to_date("outtime"), "diff").alias("outtime_actual"),
    )


def care_ratio(counts: DataFrame) -> DataFrame:
    """Caregivers per patient and day."""
    return counts.select(
        "date", F.try_divide("count_doctors", "count_patients").alias("caretime_doctors"),
        F.try_divide("count_nurses", "count_patients").alias("caretime_nurses"),
    )


def procedure_days(procedures: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Per stay and day since admission a 0/1 flag per kind of procedure."""
    days = repeat_days(procedures, "daysin_start", "daysin_end", "days_since_admission")
    return days.groupBy("icustay_id", "days_since_admission").agg(*[
        cap_flag(F.sum(flag(F.col("ordercategoryname") == k))).alias("procedure_" + k.replace(" ", "")) for k in kinds
    ])


def stay_day_features(
    main: DataFrame, scores: DataFrame, vitals: DataFrame, counts: DataFrame, procedures: DataFrame,
    categories: dict[str, Sequence[str]], kinds: Sequence[str] = ("Significant Events", "Ventilation"), hold=lambda df, name: df,
) -> DataFrame:
    """One row per stay-day with a caregiver count, as input of the three-class model.

    Three day-zero rules meet here, as defined: snapshots count from the shifted admission to the
    unit, procedures from the hospital admission, and both are joined on the number alone.
    """
    stays = hold(stay_features(main, scores, vitals, categories), "stay-features")  # read for the days and for their features
    days = daily_snapshots(stays, "icustay_id", "intime_actual", "outtime_actual", F.col("hospital_expire_flag") == 1)
    timed = join_stays(days, care_ratio(counts), ["date"], ["icustay_id"])  # few dates, many stay-days each
    # a stay has one row per day here, so this window is bounded by the length of the stay
    so_far = W.partitionBy("icustay_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    timed = timed.select("*", *[
        F.sum(F.coalesce(f"caretime_{w}", F.lit(0.0))).over(so_far).alias(f"cum_caretime_{w}") for w in ("doctors", "nurses")
    ])
    done = procedure_days(procedures, kinds).withColumnRenamed("days_since_admission", "day_of_stay")
    rows = timed.join(done, ["icustay_id", "day_of_stay"], "left").fillna(0, subset=["procedure_" + k.replace(" ", "") for k in kinds])
    return rows.join(stays, "icustay_id").select(
        "*", *binary_codes(CHAPTER_LABELS, F.col("icd9_code_cat"), "icd9_code_cat")
    )
