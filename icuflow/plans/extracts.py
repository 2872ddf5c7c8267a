"""Extracts handed to the feature step: diagnoses, procedures, caregiver counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.values import banded, years_by_boundary
from icuflow.operators.joins import join_stays
from icuflow.plans.features import STAY, Inputs
from icuflow.rules import diagnoses as dx


def all_diagnoses(v: Inputs) -> DataFrame:
    """Stay, patient and admission with every coded diagnosis and its titles."""
    age = years_by_boundary(F.col("admittime"), F.col("dob"))
    stays = v["icustays"].join(v["patients"], "subject_id").join(v["admissions"].select(
        "hadm_id", "admittime", "deathtime", "hospital_expire_flag", "insurance", "admission_type"
    ), "hadm_id").select(
        *STAY, "intime", "outtime", "los", "curr_careunit", "diff", "last_wardid", "gender", "dob", "deathtime",
        "hospital_expire_flag", "insurance", "admission_type", age.alias("age"),
        banded(age, dx.AGE_BANDS, dx.AGE_BAND_ABOVE).alias("icustay_age_group"),
    )
    # a frequent code and an admission with many codes are both spread
    coded = join_stays(v["diagnoses_icd"], v["d_icd_diagnoses"], ["icd9_code"], ["hadm_id"])
    return join_stays(coded, stays, ["hadm_id"], ["icd9_code"])


def procedures(v: Inputs) -> DataFrame:
    """Procedures of a stay with label and first and last day since admission.

    Written as a right join to admissions, but the stay is required, which makes it an inner join.
    The order category is added because the next step needs it.
    """
    rows = join_stays(
        v["procedureevents_mv"].filter(F.col("icustay_id").isNotNull()),
        v["admissions"].select("hadm_id", "admittime"), ["hadm_id"], ["starttime", "itemid"],
    )
    day = F.to_date("admittime")
    return join_stays(rows, v["d_items"], ["itemid"], ["icustay_id", "starttime"], how="left").select(
        *STAY, "itemid", "label", F.date_diff(F.to_date("starttime"), day).alias("daysin_start"),
        F.date_diff(F.to_date("endtime"), day).alias("daysin_end"), "ordercategoryname",
    )


def caregiver_counts(v: Inputs) -> DataFrame:
    """Distinct doctors, nurses and patients per (shifted) day.

    The chart is first reduced to distinct (day, stay, caregiver), so the two look-ups and the
    distinct counts work on far fewer rows and no stay is hot any more.
    """
    seen = v["chartevents"].select(
        F.to_date("charttime").alias("day"), "icustay_id", "subject_id", "cgid"
    ).distinct()
    rows = join_stays(seen, v["caregivers"], ["cgid"], ["icustay_id", "day"], how="left")
    rows = join_stays(rows, v["icustays"].select("icustay_id", "diff"), ["icustay_id"], ["cgid", "day"], how="left")
    dated = rows.withColumn("date", F.date_add("day", F.col("diff").cast("int")))
    who = F.when(F.col("class").isin("Doctor", "Nurse") & F.col("cgid").isNotNull(), F.struct("class", F.col("cgid").alias("id")))
    patient = F.when(F.col("subject_id").isNotNull(), F.struct(F.lit("Patient").alias("class"), F.col("subject_id").alias("id")))
    each = dated.select("date", F.explode(F.array(who, patient)).alias("x")).select("date", "x.class", "x.id").distinct()
    return each.groupBy("date").agg(*[
        F.count_if(F.col("class") == c).alias(f"count_{n}") for c, n in (("Doctor", "doctors"), ("Nurse", "nurses"), ("Patient", "patients"))
    ])
