"""Keys of the feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.catalog.clinical_sql import with_views
from icuflow.catalog.feature_sql import FEATURES, rounded
from icuflow.catalog.registry import query
from icuflow.plans import features as plan
from icuflow.rules import items as it
from icuflow.sources.clinical import clinical_views
from icuflow.sources.tables import stage

STAY = ["subject_id", "hadm_id", "icustay_id"]
VITAL = [f"{n}_{s}" for n in it.VITALS for s in ("min", "max", "mean")]
LAB = [f"{n}_{s}" for n in it.LABS for s in ("min", "max")]
GAS = [n for n in it.GAS if n != "specimen"]
ARTERIAL = [*GAS, "spo2", "fio2_chartevents", "specimen_prob", "aado2_calc", "pao2fio2"]


def tidy(df: DataFrame, names, keep=(), times=()) -> DataFrame:
    """Measured and nullable columns as doubles rounded to eight places, dates and times as text."""
    return df.select(
        *keep, *[F.expr(f"round(CAST({n} AS DOUBLE), 8) AS {n}") for n in names], *[F.col(t).cast("string").alias(t) for t in times]
    )


def feature(key, build, names, keep, times=()):
    sql = with_views(rounded(key, names, keep, times), key, extra=FEATURES)
    query(key, sql)(lambda spark, folder: tidy(build(clinical_views(spark, folder)), names, keep, times))


feature("vitals_all", plan.vitals_all, VITAL, [*STAY, "days_since_admission"])
feature("vitals_first_day", plan.vitals_first_day, VITAL, STAY)
feature("labs_first_day", plan.labs_first_day, LAB, STAY)
feature("bloodgas_first_day", plan.bloodgas_first_day, GAS, [*STAY, "specimen"], ["charttime"])
feature("bloodgas_arterial", plan.bloodgas_arterial, ARTERIAL, [*STAY, "specimen", "specimen_pred"], ["charttime"])
feature("gcs_first_day", plan.gcs_first_day, ["gcsmotor", "gcsverbal", "gcseyes", "mingcs"], ["icustay_id", "endotrachflag"])
feature("urine_output_first_day", plan.urine_output_first_day, ["urineoutput"], STAY)
feature("vent_settings", plan.vent_settings, ["icustay_id"],
        ["mechvent", "oxygentherapy", "extubated", "selfextubated"], ["charttime"])
feature("vent_durations", lambda v: plan.vent_durations(v, hold=stage), ["duration_hours"], ["icustay_id", "ventnum"], ["starttime", "endtime"])
