"""The four severity scores and their joined table.

Every score takes the input tables and, optionally, a dict of feature tables computed before, so
that several scores can share one staged copy of each feature.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.ladder import deciding_value, logistic, points, total
from icuflow.functions.values import epoch, flag, in_code_ranges, plus, within_days, years_fractional
from icuflow.operators.joins import interval_join, join_stays
from icuflow.operators.ordered import Hold, first_per_key, keep
from icuflow.plans import features
from icuflow.plans.echo import echo_notes
from icuflow.plans.features import STAY, Inputs, no_error
from icuflow.rules import diagnoses as dx
from icuflow.rules import items, scores


NEEDS = {
    "oasis": ("vitals", "gcs", "urine", "vent_day"),
    "saps": ("vitals", "labs", "gcs", "urine", "vent_day"),
    "saps2": ("vitals", "labs", "gcs", "urine", "arterial", "vent"),
    "sofa": ("vitals", "labs", "gcs", "urine", "arterial", "vent"),
    "all_scores": ("vitals", "labs", "gcs", "urine", "arterial", "vent", "vent_day"),
}


def score_features(
    v: Inputs, score: str = "all_scores", hold: Hold = keep
) -> Inputs:
    """The feature tables a score reads.

    ``hold`` is applied to each; pass :func:`icuflow.sources.tables.stage` to write every feature
    table once to the shared folder, so that several scores read it instead of computing it again
    and a lost executor costs one table at most.
    """
    build = {
        "vitals": features.vitals_first_day, "labs": features.labs_first_day, "gcs": features.gcs_first_day,
        "urine": features.urine_output_first_day, "arterial": features.bloodgas_arterial, "vent": lambda v: features.vent_durations(v, hold=hold),
    }
    needed = NEEDS[score]
    for table in ("icustays", "chartevents", "labevents", "outputevents", "procedureevents_mv"):
        v[table]  # views are built once, before the features ask for them side by side
    wanted = [n for n in build if n in needed or (n == "vent" and "vent_day" in needed)]
    make = inheritable_thread_target(v["icustays"].sparkSession)(lambda n: hold(build[n](v), n))
    # the features are independent jobs; submitted together they fill the cluster
    with ThreadPoolExecutor(len(wanted)) as pool:
        f = dict(zip(wanted, pool.map(make, wanted)))
    if "vent_day" in needed:
        f["vent_day"] = features.vent_first_day(v, f["vent"])
    return f


def _persons(v: Inputs) -> DataFrame:
    """Stays with their admission and patient."""
    return v["icustays"].select(*STAY, "intime", "outtime").join(
        v["admissions"].select("hadm_id", "admittime", "dischtime", "deathtime", "discharge_location",
                               "hospital_expire_flag", "admission_type"), "hadm_id"
    ).join(v["patients"].select("subject_id", "dob"), "subject_id")


def _attach(cohort: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    return cohort.join(table.select("icustay_id", *columns), "icustay_id", "left")


def expire_flag():
    """Died in the unit: death inside the stay, before it (a typing error), or discharged dead by its end."""
    inside = F.col("deathtime").between(F.col("intime"), F.col("outtime"))
    early = F.col("deathtime") <= F.col("intime")
    dead = (F.col("dischtime") <= F.col("outtime")) & (F.col("discharge_location") == "DEAD/EXPIRED")
    return flag(inside | early | dead)


def elective_surgery():
    """1 elective and surgical, null when either is unknown, else 0."""
    return (
        F.when((F.col("admission_type") == "ELECTIVE") & (F.col("surgical") == 1), 1)
        .when(F.col("admission_type").isNull() | F.col("surgical").isNull(), None).otherwise(0)
    )


def surgical_by_stay(v: Inputs) -> DataFrame:
    """1 when any service until one day after admission to the unit is surgical or orthopaedic."""
    service = F.col("curr_service")
    surgical = F.lower(service).contains("surg") | (service == "ORTHO")
    known = join_stays(
        v["services"], v["icustays"].select("icustay_id", "hadm_id", "intime"), ["hadm_id"], ["transfertime", "curr_service"],
        F.col("transfertime") < plus(F.col("intime"), days=1),
    ).groupBy("icustay_id").agg(F.max(flag(surgical)).alias("surgical"))
    return v["icustays"].select("icustay_id").join(known, "icustay_id", "left").select(
        "icustay_id", F.coalesce("surgical", F.lit(0)).alias("surgical")
    )


def oasis(v: Inputs, f: Inputs | None = None) -> DataFrame:
    """OASIS with its ten parts, the values behind them and the death probability."""
    f = score_features(v, "oasis") if f is None else f
    age = years_fractional(F.col("intime"), F.col("dob"))
    cohort = _attach(_persons(v), surgical_by_stay(v), "surgical")
    cohort = _attach(cohort, f["gcs"], "mingcs")
    cohort = _attach(cohort, f["vitals"], *[f"{m}_{s}" for m in ("heartrate", "meanbp", "resprate", "tempc") for s in ("max", "min")])
    cohort = _attach(cohort, f["urine"], "urineoutput")
    cohort = _attach(cohort, f["vent_day"], "mechvent")
    label = F
    for high, name in dx.OASIS_AGE_BANDS:
        label = label.when(age <= high, name)
    cohort = cohort.select(
        "*", (epoch(F.col("intime")) - epoch(F.col("admittime"))).alias("preiculos"), F.floor(age).alias("age"),
        label.otherwise(dx.OASIS_AGE_ABOVE).alias("icustay_age_group"), expire_flag().alias("icustay_expire_flag"),
        elective_surgery().alias("electivesurgery"),
    )
    parts = cohort.select(
        *STAY, "icustay_age_group", "hospital_expire_flag", "icustay_expire_flag", "age", "preiculos",
        F.col("mingcs").alias("gcs"),
        *[deciding_value(scores.OASIS[part]).alias(name) for name, part in scores.OASIS_DRIVERS.items()],
        "urineoutput", "mechvent", "electivesurgery",
        *[points(grade).alias(name) for name, grade in scores.OASIS.items()],
    ).withColumn("oasis", total(scores.OASIS))
    base, slope = scores.OASIS_LOGIT
    return parts.withColumn("oasis_prob", logistic(base + slope * F.col("oasis")))


def cpap_spells(v: Inputs) -> DataFrame:
    """Stays with a CPAP or BiPAP mask on the first two calendar days, and the padded time it was charted.

    The reference writes the alternatives with LIKE, which can never match; its stated intent is a
    regular expression.
    """
    chart = no_error(v["chartevents"]).filter(
        F.col("itemid").isin(*items.CPAP_CODES) & F.lower("value").rlike(items.CPAP_PATTERN)
    )
    rows = join_stays(
        chart.select("icustay_id", "itemid", "charttime"), v["icustays"].select("icustay_id", "intime"),
        ["icustay_id"], ["charttime", "itemid"], within_days(F.col("charttime"), F.col("intime"), 0, 1),
    )
    return rows.groupBy("icustay_id").agg(
        plus(F.min("charttime"), hours=-items.CPAP_LEAD_HOURS).alias("cpap_start"),
        plus(F.max("charttime"), hours=items.CPAP_TAIL_HOURS).alias("cpap_end"), F.lit(1).alias("cpap"),
    )


def saps(v: Inputs, f: Inputs | None = None) -> DataFrame:
    """SAPS and its 15 parts (glucose and urea cut points are in mmol/L, as defined)."""
    f = score_features(v, "saps") if f is None else f
    cohort = _persons(v).select(*STAY, F.round(years_fractional(F.col("intime"), F.col("dob")), 2).alias("age"))
    vitals = f["vitals"].withColumnsRenamed({"glucose_max": "v_glucose_max", "glucose_min": "v_glucose_min"})
    labs = f["labs"].withColumnsRenamed({"glucose_max": "l_glucose_max", "glucose_min": "l_glucose_min"})
    cohort = _attach(cohort, cpap_spells(v), "cpap")
    cohort = _attach(cohort, f["gcs"], "mingcs")
    cohort = _attach(cohort, vitals, "v_glucose_max", "v_glucose_min", *[
        f"{m}_{s}" for m in ("heartrate", "sysbp", "resprate", "tempc") for s in ("max", "min")])
    cohort = _attach(cohort, f["urine"], "urineoutput")
    cohort = _attach(cohort, f["vent_day"], "mechvent")
    cohort = _attach(cohort, labs, "l_glucose_max", "l_glucose_min", *[
        f"{m}_{s}" for m in ("bun", "hematocrit", "wbc", "sodium", "potassium", "bicarbonate") for s in ("max", "min")])
    cohort = cohort.select("*", *[
        F.coalesce(f"v_glucose_{s}", f"l_glucose_{s}").alias(f"glucose_{s}") for s in ("max", "min")])
    parts = cohort.select("icustay_id", *[points(g).alias(n) for n, g in scores.SAPS.items()])
    return v["icustays"].select(*STAY).join(parts, "icustay_id", "left").withColumn("saps", total(scores.SAPS))


def comorbidities(diagnoses: DataFrame) -> DataFrame:
    """AIDS, haematologic and metastatic flags per admission; null (not 0) without one."""
    code = F.col("icd9_code")
    ranges = {"aids": dx.AIDS_RANGES, "hem": dx.HEM_RANGES, "mets": dx.METS_RANGES}
    return diagnoses.groupBy("hadm_id").agg(*[
        F.max(F.when(in_code_ranges(code, r), 1)).alias(n) for n, r in ranges.items()
    ])


def first_service(v: Inputs) -> DataFrame:
    """Whether the first service of an admission is surgical."""
    first = first_per_key(v["services"], ["hadm_id"], ["transfertime", "curr_service"])
    return first.select("hadm_id", flag(F.lower("curr_service").contains("surg")).alias("surgical"))


def admission_class():
    surgical = F.col("surgical") == 1
    return (
        F.when((F.col("admission_type") == "ELECTIVE") & surgical, "ScheduledSurgical")
        .when((F.col("admission_type") != "ELECTIVE") & surgical, "UnscheduledSurgical").otherwise("Medical")
    )


def gas_on_vent(v: Inputs, f: Inputs, cpap: DataFrame | None = None) -> DataFrame:
    """Blood gas with flags for ventilation (and CPAP) at the time of the sample."""
    gas = f["arterial"].select("icustay_id", "charttime", "pao2fio2")
    spells = f["vent"].select("icustay_id", F.col("starttime").alias("vent_start"), F.col("endtime").alias("vent_end"))
    out = interval_join(gas, spells, ["icustay_id"], "charttime", "vent_start", "vent_end")
    if cpap is not None:
        out = interval_join(out, cpap.drop("cpap"), ["icustay_id"], "charttime", "cpap_start", "cpap_end")
        return out.withColumn("aided", F.col("vent_start").isNotNull() | F.col("cpap_start").isNotNull())
    return out.withColumn("aided", F.col("vent_start").isNotNull())


def saps2(v: Inputs, f: Inputs | None = None) -> DataFrame:
    """SAPS II, its 15 parts and the death probability."""
    f = score_features(v, "saps2") if f is None else f
    ratio = gas_on_vent(v, f, cpap_spells(v)).filter("aided").groupBy("icustay_id").agg(
        F.min("pao2fio2").alias("pao2fio2_vent_min")
    )
    cohort = _persons(v).select(
        *STAY, "admission_type", F.round(years_fractional(F.col("intime"), F.col("dob")), 2).alias("age")
    )
    cohort = _attach(cohort, ratio, "pao2fio2_vent_min")
    cohort = cohort.join(first_service(v), "hadm_id", "left").join(comorbidities(v["diagnoses_icd"]), "hadm_id", "left")
    cohort = _attach(cohort, f["gcs"], "mingcs")
    cohort = _attach(cohort, f["vitals"], *[f"{m}_{s}" for m in ("heartrate", "sysbp", "tempc") for s in ("max", "min")])
    cohort = _attach(cohort, f["urine"], "urineoutput")
    cohort = _attach(cohort, f["labs"], *[
        f"{m}_{s}" for m in ("bun", "wbc", "potassium", "sodium", "bicarbonate", "bilirubin") for s in ("max", "min")])
    cohort = cohort.withColumn("admissiontype", admission_class())
    parts = cohort.select("icustay_id", *[points(g).alias(n) for n, g in scores.SAPS2.items()])
    parts = parts.withColumn("sapsii", total(scores.SAPS2))
    base, slope, log_slope = scores.SAPS2_LOGIT
    s = F.col("sapsii")
    parts = parts.withColumn("sapsii_prob", logistic(base + slope * s + log_slope * F.log(s + 1)))
    return v["icustays"].select(*STAY).join(parts, "icustay_id", "left")


def charted_weight(v: Inputs) -> DataFrame:
    """Mean weight in kilograms from the day before to the day after admission to the unit."""
    code, value = F.col("itemid"), F.col("valuenum")
    codes = [*items.WEIGHT_KG, items.WEIGHT_LB, items.WEIGHT_OZ]
    chart = no_error(v["chartevents"]).filter(code.isin(codes) & (value != 0))
    rows = join_stays(
        chart.select("icustay_id", "itemid", "charttime", "valuenum"), v["icustays"].select("icustay_id", "intime"),
        ["icustay_id"], ["charttime", "itemid"], within_days(F.col("charttime"), F.col("intime"), -1, 1),
    )
    kg = F.when(code.isin(*items.WEIGHT_KG), value).when(
        code == items.WEIGHT_LB, value * items.LB_TO_KG).when(code == items.WEIGHT_OZ, value * items.OZ_TO_KG)
    return rows.groupBy("icustay_id").agg(F.avg(kg).alias("weight"))


def echo_weight(v: Inputs) -> DataFrame:
    """Mean weight in kilograms from echo notes of the week before until the day after admission."""
    notes = echo_notes(v["noteevents"]).select("hadm_id", "row_id", "charttime", "weight")
    start = F.col("intime")
    rows = join_stays(
        notes, v["icustays"].select("icustay_id", "hadm_id", "intime"), ["hadm_id"], ["row_id"],
        (F.col("charttime") > plus(start, days=-7)) & (F.col("charttime") < plus(start, days=1)),
    )
    return rows.groupBy("icustay_id").agg(F.avg(F.col("weight") * items.LB_TO_KG).alias("echo_weight"))


def vasopressors_cv(v: Inputs) -> DataFrame:
    """Highest rate per drug in the first 24 hours; some rates are divided by the body weight."""
    code, rate = F.col("itemid"), F.col("rate")
    codes = [c for pair in items.VASO_CV.values() for group in pair for c in group]
    given = v["inputevents_cv"].filter(code.isin(codes) & rate.isNotNull())
    rows = join_stays(
        given.select("icustay_id", "itemid", "charttime", "rate"), v["icustays"].select("icustay_id", "intime"),
        ["icustay_id"], ["charttime", "itemid"], F.col("charttime").between(F.col("intime"), plus(F.col("intime"), days=1)),
    )
    # the weight is one value per stay, so the division is done after the maxima
    drugs = rows.groupBy("icustay_id").agg(*[
        F.max(F.when(code.isin(*group), rate)).alias(f"{name}_{i}")
        for name, pair in items.VASO_CV.items() for i, group in enumerate(pair) if group
    ])
    drugs = _attach(_attach(drugs, charted_weight(v), "weight"), echo_weight(v), "echo_weight")
    kg = F.coalesce("weight", "echo_weight")
    return drugs.select("icustay_id", *[
        (F.greatest(f"{name}_0", F.try_divide(F.col(f"{name}_1"), kg)) if by_weight else F.col(f"{name}_0"))
        .alias(f"cv_{name}") for name, (_, by_weight) in items.VASO_CV.items()
    ])


def vasopressors_mv(v: Inputs) -> DataFrame:
    """Highest delivered rate per drug in the first 24 hours."""
    code = F.col("itemid")
    given = v["inputevents_mv"].filter(
        code.isin(*items.VASO_MV.values()) & (F.col("statusdescription") != items.NOT_DELIVERED)
    )
    rows = join_stays(
        given.select("icustay_id", "itemid", "starttime", "rate"), v["icustays"].select("icustay_id", "intime"),
        ["icustay_id"], ["starttime", "itemid"], F.col("starttime").between(F.col("intime"), plus(F.col("intime"), days=1)),
    )
    return rows.groupBy("icustay_id").agg(*[
        F.max(F.when(code == c, F.col("rate"))).alias(f"mv_{n}") for n, c in items.VASO_MV.items()
    ])


def sofa(v: Inputs, f: Inputs | None = None) -> DataFrame:
    """SOFA and its six parts."""
    f = score_features(v, "sofa") if f is None else f
    ratio = gas_on_vent(v, f).groupBy("icustay_id").agg(
        F.min(F.when(~F.col("aided"), F.col("pao2fio2"))).alias("pao2fio2_novent_min"),
        F.min(F.when(F.col("aided"), F.col("pao2fio2"))).alias("pao2fio2_vent_min"),
    )
    drugs = list(items.VASO_CV)
    cohort = v["icustays"].select("icustay_id")
    cohort = _attach(cohort, vasopressors_cv(v), *[f"cv_{d}" for d in drugs])
    cohort = _attach(cohort, vasopressors_mv(v), *[f"mv_{d}" for d in drugs])
    cohort = _attach(cohort, ratio, "pao2fio2_novent_min", "pao2fio2_vent_min")
    cohort = _attach(cohort, f["vitals"], "meanbp_min")
    cohort = _attach(cohort, f["labs"], "creatinine_max", "bilirubin_max", "platelet_min")
    cohort = _attach(cohort, f["urine"], "urineoutput")
    cohort = _attach(cohort, f["gcs"], "mingcs")
    cohort = cohort.select("*", *[F.coalesce(f"cv_{d}", f"mv_{d}").alias(f"rate_{d}") for d in drugs])
    parts = cohort.select("icustay_id", *[points(g).alias(n) for n, g in scores.SOFA.items()])
    return v["icustays"].select(*STAY).join(parts, "icustay_id", "left").withColumn("sofa", total(scores.SOFA))


def all_scores(v: Inputs, f: Inputs | None = None) -> DataFrame:
    """The four scores side by side, joined in full on the stay; shared part names come from OASIS."""
    f = score_features(v, "all_scores") if f is None else f
    ids = ["subject_id", "hadm_id"]
    out = oasis(v, f)
    for table in (saps(v, f).drop(*ids, *scores.ALL_SCORES_SHARED), saps2(v, f).drop(*ids, *scores.ALL_SCORES_SHARED),
                  sofa(v, f).drop(*ids)):
        out = out.join(table, "icustay_id", "full")
    return out
