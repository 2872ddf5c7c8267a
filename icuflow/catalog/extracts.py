"""Keys of the extracts, the diagnosis features, the day table and the run-log report."""

from __future__ import annotations

from pyspark.sql import functions as F

from icuflow.catalog.clinical_sql import with_views
from icuflow.catalog.feature_sql import FEATURES
from icuflow.catalog.features import STAY, VITAL, tidy
from icuflow.catalog.registry import query
from icuflow.catalog.score_sql import SCORES
from icuflow.plans import extracts as plan
from icuflow.plans import scores
from icuflow.plans.diagnoses import diagnosis_features
from icuflow.plans.run_logs import run_log_report
from icuflow.plans.stay_days import CHAPTER_LABELS, SCORE_FEATURES, stay_day_features
from icuflow.rules import diagnoses as dx
from icuflow.sources.clinical import ADMISSION_TYPES, INSURANCES, clinical_views
from icuflow.sources.clinical import CARE_UNITS as UNITS
from icuflow.sources.tables import stage

# thresholds fit for the size of the test data; the defaults of the plan are 10, 10 and 50
MIN_DEATHS, MIN_PAIRS, TOP = 10, 10, 50

EXTRACTS: dict[str, tuple[tuple[str, ...], str]] = {
    "all_diagnoses": (("icustays", "patients", "admissions", "diagnoses_icd", "d_icd_diagnoses"), """
        SELECT subject_id, hadm_id, icustay_id, intime, outtime, los, curr_careunit, diff, last_wardid, gender, icd9_code, short_title, long_title,
               seq_num, deathtime, hospital_expire_flag, insurance, admission_type, CAST(age AS INTEGER) AS age,
               CASE WHEN age <= 1 THEN 'neonate' WHEN age < 15 THEN '1-14' WHEN age < 40 THEN '15-39' WHEN age < 65 THEN '40-64'
                    WHEN age < 90 THEN '65-89' ELSE '>89' END AS icustay_age_group
        FROM (SELECT *, date_diff('year', dob, admittime) AS age FROM icustays JOIN patients USING (subject_id) JOIN admissions USING (hadm_id)
              JOIN diagnoses_icd USING (hadm_id) JOIN d_icd_diagnoses USING (icd9_code))"""),
    "procedures": (("procedureevents_mv", "admissions", "d_items"), """
        SELECT subject_id, hadm_id, icustay_id, itemid, label, CAST(CAST(starttime AS DATE) - CAST(admittime AS DATE) AS INTEGER) AS daysin_start,
               CAST(CAST(endtime AS DATE) - CAST(admittime AS DATE) AS INTEGER) AS daysin_end, ordercategoryname
        FROM procedureevents_mv RIGHT JOIN admissions USING (hadm_id) LEFT JOIN d_items USING (itemid) WHERE icustay_id IS NOT NULL"""),
    "caregiver_counts": (("chartevents", "caregivers", "icustays"), """
        SELECT CAST(charttime AS DATE) + diff AS date, count(DISTINCT c.cgid) FILTER (class = 'Doctor') AS count_doctors,
               count(DISTINCT c.cgid) FILTER (class = 'Nurse') AS count_nurses, count(DISTINCT c.subject_id) AS count_patients
        FROM chartevents c LEFT JOIN caregivers g ON g.cgid = c.cgid LEFT JOIN icustays i ON i.icustay_id = c.icustay_id GROUP BY 1"""),
    "singles": (("all_diagnoses",), f"""
        SELECT short_title, sum(hospital_expire_flag) / count(*)::DOUBLE AS rate FROM all_diagnoses GROUP BY short_title
        HAVING sum(hospital_expire_flag) >= {MIN_DEATHS}"""),
    "top_rows": (("all_diagnoses", "singles"), f"""
        SELECT DISTINCT icustay_id, short_title, hospital_expire_flag, rate FROM all_diagnoses
        JOIN (SELECT * FROM singles ORDER BY rate DESC, short_title LIMIT {TOP}) USING (short_title)"""),
    "hot_pairs": (("top_rows",), f"""
        SELECT x.short_title AS t1, y.short_title AS t2, avg(x.hospital_expire_flag) AS r
        FROM top_rows x JOIN top_rows y ON x.icustay_id = y.icustay_id AND x.short_title < y.short_title
        GROUP BY x.short_title, y.short_title
        HAVING count(*) >= {MIN_PAIRS} AND avg(x.hospital_expire_flag) > {dx.LIFT} + least(any_value(x.rate), any_value(y.rate))"""),
    "diagnosis_features": (("all_diagnoses", "singles", "top_rows", "hot_pairs"), """
        SELECT d.*, cat1 AS deathrate_cat_1, cat2 AS deathrate_cat_2, coalesce(int1, 0) AS deathrate_int_cat_1, coalesce(int2, 0) AS deathrate_int_cat_2
        FROM (SELECT * FROM all_diagnoses QUALIFY row_number() OVER (PARTITION BY icustay_id ORDER BY seq_num, icd9_code) = 1) d
        JOIN (SELECT icustay_id, count(*) FILTER (rate >= 0.5 AND rate < 0.7) AS cat1, count(*) FILTER (rate >= 0.7) AS cat2
              FROM all_diagnoses LEFT JOIN singles USING (short_title) GROUP BY icustay_id) USING (icustay_id)
        LEFT JOIN (SELECT x.icustay_id, CAST(max(CASE WHEN r >= 0.5 AND r < 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS int1,
                          CAST(max(CASE WHEN r >= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS int2
                   FROM hot_pairs JOIN top_rows x ON x.short_title = t1 JOIN top_rows y ON y.short_title = t2 AND y.icustay_id = x.icustay_id
                   GROUP BY x.icustay_id) USING (icustay_id)"""),
    "stay_rows": (("diagnosis_features", "oasis", "sofa", "vitals_first_day"), f"""
        SELECT m.*, {', '.join('s.' + c for c in SCORE_FEATURES)}, v.* EXCLUDE (subject_id, hadm_id, icustay_id),
               CAST(intime AS DATE) + diff AS d0, CAST(outtime AS DATE) + diff AS d1,
               coalesce((SELECT label FROM (VALUES {', '.join(f"({a}, {b}, '{t}')" for a, b, t in dx.CHAPTERS)}) c(lo, hi, label)
                         WHERE n > lo AND n < hi), 'Other') AS icd9_code_cat
        FROM (SELECT *, try_cast(CASE WHEN regexp_full_match(icd9_code[1:3], '\\d+') THEN icd9_code[1:3] END AS INTEGER) AS n FROM diagnosis_features) m
        JOIN vitals_first_day v USING (icustay_id)
        LEFT JOIN (SELECT o.*, f.* EXCLUDE (subject_id, hadm_id, icustay_id) FROM oasis o JOIN sofa f USING (icustay_id)
                   QUALIFY row_number() OVER (PARTITION BY o.subject_id ORDER BY o.icustay_id) = 1) s USING (icustay_id)"""),
    "stay_day_features": (("stay_rows", "caregiver_counts", "procedures"), f"""
        SELECT r.*, CAST(r.date AS VARCHAR) AS day, coalesce(pe, 0) AS procedure_significantevents, coalesce(pv, 0) AS procedure_ventilation,
               {', '.join(f"CAST((list_position([{', '.join(repr(x) for x in CHAPTER_LABELS)}], icd9_code_cat) >> {4 - i}) & 1 AS INTEGER) AS icd9_code_cat_{i}" for i in range(5))}
        FROM (SELECT *, sum(count_doctors / count_patients::DOUBLE) OVER w AS cum_caretime_doctors,
                     sum(count_nurses / count_patients::DOUBLE) OVER w AS cum_caretime_nurses
              FROM (SELECT *, d0 + CAST(day_of_stay AS INTEGER) AS date,
                           CASE WHEN d0 + CAST(day_of_stay AS INTEGER) < d1 THEN 0 WHEN hospital_expire_flag = 1 THEN 1 ELSE -1 END AS out_flag
                    FROM (SELECT *, CAST(unnest(range(0, d1 - d0 + 1)) AS INTEGER) AS day_of_stay FROM stay_rows)) JOIN caregiver_counts USING (date)
              WINDOW w AS (PARTITION BY icustay_id ORDER BY date)) r
        LEFT JOIN (SELECT icustay_id, day_of_stay, CAST(max((ordercategoryname = 'Significant Events')::INTEGER) AS BIGINT) AS pe,
                          CAST(max((ordercategoryname = 'Ventilation')::INTEGER) AS BIGINT) AS pv
                   FROM (SELECT *, unnest(range(daysin_start, daysin_end + 1)) AS day_of_stay FROM procedures WHERE daysin_end >= daysin_start)
                   GROUP BY ALL) USING (icustay_id, day_of_stay)"""),
    "run_log_report": (("run_agent", "run_model"), f"""
        SELECT 'occupancy' AS section, run_number, careunit AS name, step::DOUBLE AS x, count(*) / any_value(80 + 20 * (run_number % 3))::DOUBLE * 100 AS value
        FROM run_agent GROUP BY run_number, careunit, step
        UNION ALL SELECT 'demand', run_number, unnest(['doctors', 'nurses', 'capacity']), unnest([d, n, c])::DOUBLE, v FROM (
            SELECT run_number, least(any_value(n_doctors), any_value(n_nurses)) AS d, greatest(any_value(n_doctors), any_value(n_nurses)) AS n,
                   max(max_agents) AS c, arg_max(demand_serviced, step) AS v FROM run_model GROUP BY run_number)
        {' '.join(f'''UNION ALL SELECT '{section}', run_number, '{name}', (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY run_number))::DOUBLE, y::DOUBLE
            FROM (SELECT run_number, agent_id, max({col}) AS y FROM run_agent WHERE {test} GROUP BY ALL) WINDOW w AS (PARTITION BY run_number ORDER BY y)'''
        for section, name, col, test in [('los', 'all', 'days_in_hospital', 'TRUE'), ('los', 'fatal', 'days_in_hospital', 'out_flag = 1'),
                                         ('care_time', 'doctors', 'cum_caretime_doctors', 'TRUE'), ('care_time', 'nurses', 'cum_caretime_nurses', 'TRUE')])}"""),
}
KNOWN = {**FEATURES, **SCORES, **EXTRACTS}
DIAGNOSIS_KEEP = [*STAY, "icd9_code", "short_title", "seq_num", "gender", "insurance", "admission_type", "age", "icustay_age_group",
                  "hospital_expire_flag", "curr_careunit"]
DIAGNOSIS_NUM = ["los"]


def listed(key, names, keep, times=()):
    cols = [*keep, *[f"round(CAST({n} AS DOUBLE), 8) AS {n}" for n in names], *[f"CAST({t} AS VARCHAR) AS {t}" for t in times]]
    return with_views(f"SELECT {', '.join(cols)} FROM {key}", key, extra=KNOWN)


def extract(key, build, names, keep, times=()):
    query(key, listed(key, names, keep, times))(
        lambda spark, folder: tidy(build(clinical_views(spark, folder)), names, keep, times)
    )


extract("all_diagnoses", plan.all_diagnoses, DIAGNOSIS_NUM, [*DIAGNOSIS_KEEP, "long_title", "diff", "last_wardid"], ["intime", "outtime", "deathtime"])
extract("procedures", plan.procedures, [], [*STAY, "itemid", "label", "daysin_start", "daysin_end", "ordercategoryname"])
extract("caregiver_counts", plan.caregiver_counts, [], ["count_doctors", "count_nurses", "count_patients"], ["date"])

FEATURE_KEEP = [*DIAGNOSIS_KEEP, "deathrate_cat_1", "deathrate_cat_2", "deathrate_int_cat_1", "deathrate_int_cat_2"]


def diagnosis_table(v):
    return diagnosis_features(stage(plan.all_diagnoses(v), "diagnoses"), MIN_DEATHS, MIN_PAIRS, TOP, stage)


@query("diagnosis_features", listed("diagnosis_features", DIAGNOSIS_NUM, FEATURE_KEEP))
def _(spark, folder):
    return tidy(diagnosis_table(clinical_views(spark, folder)), DIAGNOSIS_NUM, FEATURE_KEEP)


CATEGORIES = {
    "gender": ["F", "M"], "icustay_age_group": ["neonate", "1-14", "15-39", "40-64", "65-89", ">89"],
    "admission_type": sorted({t for t in ADMISSION_TYPES if t}), "insurance": INSURANCES, "curr_careunit": UNITS,
}
DAY_KEEP = ["icustay_id", "icd9_code_cat", "day_of_stay", "out_flag", "procedure_significantevents", "procedure_ventilation",
            *[f"icd9_code_cat_{i}" for i in range(5)], *FEATURE_KEEP[3:]]
DAY_NUM = [*SCORE_FEATURES, *VITAL, "cum_caretime_doctors", "cum_caretime_nurses"]
PREFIXES = {"gender": "gender", "icustay_age_group": "age_group", "admission_type": "admission_type", "insurance": "insurance_type", "curr_careunit": "careunit"}
DUMMIES = {f"{PREFIXES[c]}_{v}": f"{c} = '{v}'" for c, values in CATEGORIES.items() for v in sorted(values)[1:]}  # the first value has none


def day_table(spark, folder):
    """The day-level table over the views, with the shared inputs staged."""
    v = clinical_views(spark, folder, stage)
    f = scores.score_features(v, "all_scores", stage)
    graded = scores.oasis(v, f).join(scores.sofa(v, f).drop("subject_id", "hadm_id"), "icustay_id", "full")
    rows = stay_day_features(
        stage(diagnosis_table(v), "main"), stage(graded, "scores"), f["vitals"], plan.caregiver_counts(v), plan.procedures(v), CATEGORIES, hold=stage,
    )
    return rows.withColumnRenamed("procedure_SignificantEvents", "procedure_significantevents").withColumnRenamed(
        "procedure_Ventilation", "procedure_ventilation")


@query("stay_day_features", with_views(
    "SELECT " + ", ".join([*DAY_KEEP, *[f"round(CAST({n} AS DOUBLE), 8) AS {n}" for n in DAY_NUM], "day",
                           *[f'CASE WHEN {t} THEN 1 ELSE 0 END AS "{n}"' for n, t in DUMMIES.items()]]) + " FROM stay_day_features",
    "stay_day_features", extra=KNOWN))
def _(spark, folder):
    rows = day_table(spark, folder)
    return rows.select(*DAY_KEEP, *[F.expr(f"round(CAST({n} AS DOUBLE), 8) AS {n}") for n in DAY_NUM],
                       F.col("date").cast("string").alias("day"), *[F.col(f"`{d}`") for d in DUMMIES])


@query("run_log_report", with_views("SELECT section, run_number, name, round(x, 8) AS x, round(value, 8) AS value FROM run_log_report",
                                    "run_log_report", extra=KNOWN))
def _(spark, folder):
    v = clinical_views(spark, folder, stage)
    agents = stage(v["run_agent"], "agents")
    return run_log_report(v["run_model"], agents, stage).select(
        "section", "run_number", "name", F.round("x", 8).alias("x"), F.round("value", 8).alias("value")
    )


