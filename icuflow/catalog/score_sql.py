"""Score tables as DuckDB common table expressions (checks for the score plans)."""

from __future__ import annotations

from icuflow.catalog.clinical_sql import in_list, lit
from icuflow.rules import diagnoses as dx
from icuflow.rules import items as it
from icuflow.rules import scores as sc
from icuflow.rules.scores import ANY


def _test(tests) -> str:
    word, tests = (" OR ", tests[1:]) if tests[0] == ANY else (" AND ", tests)
    return word.join(f"{c} {op} {lit(bound)}" for c, op, bound in tests)


def graded(name, grade) -> str:
    """One graded part: the first step that holds, found in a list of (holds, points)."""
    steps = ", ".join(f"CASE WHEN {_test(s[1:])} THEN {i} END" for i, s in enumerate(grade.steps))
    pts = ", ".join("NULL" if s[0] is None else str(s[0]) for s in grade.steps)
    found = f"list_min([{steps}])"
    core = f"CASE WHEN {found} IS NULL THEN {lit(grade.rest)} ELSE ([{pts}])[{found} + 1] END"
    blank = f"coalesce({', '.join(grade.blank)}) IS NULL" if grade.blank else "FALSE"
    if grade.blank_last:
        blank = f"({blank} AND {found} IS NULL)"
    return f"CAST(CASE WHEN {blank} THEN NULL ELSE {core} END AS INTEGER) AS {name}"


def driver(name, grade) -> str:
    measure = grade.blank[0].rsplit("_", 1)[0]
    steps = " ".join(f"WHEN {_test(s[1:])} THEN {s[1][0]}" for s in grade.steps)
    return (f"CASE WHEN {grade.blank[0]} IS NULL THEN NULL {steps} "
            f"ELSE ({measure}_min + {measure}_max) / 2 END AS {name}")


def summed(parts) -> str:
    return "CAST(" + " + ".join(f"ifnull({p}, 0)" for p in parts) + " AS INTEGER)"


def ranges(rs) -> str:
    return " OR ".join(f"icd9_code BETWEEN {lit(a)} AND {lit(b)}" for a, b in rs)


_age = "(CAST(intime AS DATE) - CAST(dob AS DATE)) / 365.242::DOUBLE"
_kg = f"CASE WHEN itemid = {it.WEIGHT_LB} THEN valuenum * {it.LB_TO_KG!r}::DOUBLE WHEN itemid = {it.WEIGHT_OZ} THEN valuenum * {it.OZ_TO_KG!r}::DOUBLE ELSE valuenum END"
_cv = ", ".join(
    f"max(CASE WHEN itemid IN {in_list(plain)} THEN rate "
    + (f"WHEN itemid IN {in_list(by_kg)} THEN rate / nullif(coalesce(w.weight, e.weight), 0) " if by_kg else "")
    + f"END) AS cv_{name}" for name, (plain, by_kg) in it.VASO_CV.items())
_mv = ", ".join(f"max(rate) FILTER (itemid = {c}) AS mv_{n}" for n, c in it.VASO_MV.items())
_rates = ", ".join(f"coalesce(cv_{n}, mv_{n}) AS rate_{n}" for n in it.VASO_CV)
_weights = in_list([*it.WEIGHT_KG, it.WEIGHT_LB, it.WEIGHT_OZ])
_cv_codes = in_list([c for pair in it.VASO_CV.values() for g in pair for c in g])
_shared = ", ".join(sc.ALL_SCORES_SHARED)
_join = " ".join(f"LEFT JOIN {t} USING (icustay_id)" for t in ("gcs_first_day", "urine_output_first_day", "vent_first_day"))

SCORES: dict[str, tuple[tuple[str, ...], str]] = {
    "persons": (("icustays", "admissions", "patients"), """
        SELECT s.subject_id, s.hadm_id, s.icustay_id, s.intime, s.outtime, a.* EXCLUDE (hadm_id), p.dob
        FROM icustays s JOIN admissions a USING (hadm_id) JOIN patients p USING (subject_id)"""),
    "oasis": (("persons", "services", "gcs_first_day", "vitals_first_day", "urine_output_first_day", "vent_first_day"), f"""
        SELECT *, 1 / (1 + exp(-({sc.OASIS_LOGIT[0]!r}::DOUBLE + {sc.OASIS_LOGIT[1]!r}::DOUBLE * oasis))) AS oasis_prob
        FROM (SELECT *, {summed(sc.OASIS)} AS oasis FROM (
          SELECT subject_id, hadm_id, icustay_id, icustay_age_group, hospital_expire_flag, icustay_expire_flag, age, preiculos,
                 mingcs AS gcs, {', '.join(driver(n, sc.OASIS[p]) for n, p in sc.OASIS_DRIVERS.items())},
                 urineoutput, mechvent, electivesurgery, {', '.join(graded(n, g) for n, g in sc.OASIS.items())}
          FROM (SELECT p.*, epoch_us(intime) // 1000000 - epoch_us(admittime) // 1000000 AS preiculos,
                       CAST(floor({_age}) AS BIGINT) AS age,
                       CASE WHEN {_age} <= 1 THEN 'neonate' WHEN {_age} <= 15 THEN 'middle' ELSE 'adult' END AS icustay_age_group,
                       CASE WHEN (deathtime <= outtime AND deathtime >= intime) OR deathtime <= intime
                                 OR (dischtime <= outtime AND discharge_location = 'DEAD/EXPIRED') THEN 1 ELSE 0 END AS icustay_expire_flag,
                       CASE WHEN admission_type = 'ELECTIVE' AND surgical = 1 THEN 1
                            WHEN admission_type IS NULL OR surgical IS NULL THEN NULL ELSE 0 END AS electivesurgery,
                       mingcs, urineoutput, mechvent, v.* EXCLUDE (subject_id, hadm_id, icustay_id)
                FROM persons p
                JOIN (SELECT s.icustay_id, max(CASE WHEN curr_service ILIKE '%surg%' OR curr_service = 'ORTHO' THEN 1 ELSE 0 END) AS surgical
                      FROM icustays s LEFT JOIN services c ON c.hadm_id = s.hadm_id AND transfertime < intime + INTERVAL 24 HOUR
                      GROUP BY s.icustay_id) USING (icustay_id)
                LEFT JOIN vitals_first_day v USING (icustay_id) {_join})))"""),
    "cpap": (("chartevents", "icustays"), f"""
        SELECT icustay_id, min(charttime) - INTERVAL 1 HOUR AS c0, max(charttime) + INTERVAL 4 HOUR AS c1, 1 AS cpap
        FROM chartevents JOIN (SELECT icustay_id, intime FROM icustays) USING (icustay_id)
        WHERE itemid IN {in_list(it.CPAP_CODES)} AND error <> 1 AND (lower(value) LIKE '%cpap mask%' OR lower(value) LIKE '%bipap mask%')
          AND CAST(charttime AS DATE) - CAST(intime AS DATE) IN (0, 1) GROUP BY icustay_id"""),
    "saps": (("persons", "cpap", "gcs_first_day", "vitals_first_day", "urine_output_first_day", "vent_first_day", "labs_first_day"), f"""
        SELECT subject_id, hadm_id, icustay_id, {', '.join(sc.SAPS)}, {summed(sc.SAPS)} AS saps FROM icustays LEFT JOIN (
          SELECT icustay_id, {', '.join(graded(n, g) for n, g in sc.SAPS.items())} FROM (
            SELECT p.icustay_id, round({_age}, 2) AS age, cpap, mingcs, urineoutput, mechvent,
                   v.* EXCLUDE (subject_id, hadm_id, icustay_id, glucose_max, glucose_min),
                   l.* EXCLUDE (subject_id, hadm_id, icustay_id, glucose_max, glucose_min),
                   coalesce(v.glucose_max, l.glucose_max) AS glucose_max, coalesce(v.glucose_min, l.glucose_min) AS glucose_min
            FROM persons p LEFT JOIN cpap USING (icustay_id) LEFT JOIN vitals_first_day v USING (icustay_id)
            LEFT JOIN labs_first_day l USING (icustay_id) {_join})) USING (icustay_id)"""),
    "gas_aided": (("bloodgas_arterial", "vent_durations"), """
        SELECT b.icustay_id, b.charttime, b.pao2fio2, EXISTS (SELECT 1 FROM vent_durations d WHERE d.icustay_id = b.icustay_id
               AND b.charttime BETWEEN d.starttime AND d.endtime) AS vented FROM bloodgas_arterial b"""),
    "saps2": (("persons", "cpap", "gas_aided", "services", "diagnoses_icd", "gcs_first_day", "vitals_first_day",
               "urine_output_first_day", "vent_first_day", "labs_first_day"), f"""
        SELECT subject_id, hadm_id, icustay_id, {', '.join(sc.SAPS2)}, sapsii,
               1 / (1 + exp(-({sc.SAPS2_LOGIT[0]!r}::DOUBLE + {sc.SAPS2_LOGIT[1]!r}::DOUBLE * sapsii + {sc.SAPS2_LOGIT[2]!r}::DOUBLE * ln(sapsii + 1)))) AS sapsii_prob
        FROM icustays LEFT JOIN (
          SELECT *, {summed(sc.SAPS2)} AS sapsii FROM (SELECT icustay_id, {', '.join(graded(n, g) for n, g in sc.SAPS2.items())} FROM (
            SELECT p.icustay_id, round({_age}, 2) AS age, pao2fio2_vent_min, aids, hem, mets, mingcs, urineoutput, mechvent,
                   CASE WHEN surgical AND admission_type = 'ELECTIVE' THEN 'ScheduledSurgical'
                        WHEN surgical AND admission_type <> 'ELECTIVE' THEN 'UnscheduledSurgical' ELSE 'Medical' END AS admissiontype,
                   v.* EXCLUDE (subject_id, hadm_id, icustay_id, glucose_max, glucose_min),
                   l.* EXCLUDE (subject_id, hadm_id, icustay_id, glucose_max, glucose_min)
            FROM persons p
            LEFT JOIN (SELECT g.icustay_id, min(pao2fio2) AS pao2fio2_vent_min FROM gas_aided g LEFT JOIN cpap c USING (icustay_id)
                       WHERE vented OR charttime BETWEEN c0 AND c1 GROUP BY g.icustay_id) USING (icustay_id)
            LEFT JOIN (SELECT hadm_id, first(curr_service ILIKE '%surg%' ORDER BY transfertime, curr_service NULLS FIRST) AS surgical
                       FROM services GROUP BY hadm_id) USING (hadm_id)
            LEFT JOIN (SELECT hadm_id, max(CASE WHEN {ranges(dx.AIDS_RANGES)} THEN 1 END) AS aids,
                              max(CASE WHEN {ranges(dx.HEM_RANGES)} THEN 1 END) AS hem,
                              max(CASE WHEN {ranges(dx.METS_RANGES)} THEN 1 END) AS mets FROM diagnoses_icd GROUP BY hadm_id) USING (hadm_id)
            LEFT JOIN vitals_first_day v USING (icustay_id) LEFT JOIN labs_first_day l USING (icustay_id) {_join}))) USING (icustay_id)"""),
    "echo_notes": (("noteevents",), """
        SELECT row_id, subject_id, hadm_id, chartdate,
               strptime(strftime(chartdate, '%Y-%m-%d') || ' ' || regexp_extract(text, 'Date/Time: [^a-z]+ at ([0-9:]+)', 1), '%Y-%m-%d %H:%M') AS charttime,
               try_cast(regexp_extract(text, 'Height: \\(in\\) ([^\\n]*)', 1) AS DOUBLE) AS height,
               try_cast(regexp_extract(text, 'Weight \\(lb\\): ([^\\n]*)', 1) AS DOUBLE) AS weight,
               try_cast(regexp_extract(text, 'BSA \\(m2\\): ([^\\n]*) m2', 1) AS DOUBLE) AS bsa,
               nullif(regexp_extract(text, 'BP \\(mm Hg\\): ([^\\n]*)', 1), '') AS bp,
               try_cast(regexp_extract(text, 'BP \\(mm Hg\\): (\\d+)/', 1) AS DOUBLE) AS bpsys,
               try_cast(regexp_extract(text, 'BP \\(mm Hg\\): \\d+/(\\d+)', 1) AS DOUBLE) AS bpdias,
               try_cast(regexp_extract(text, 'HR \\(bpm\\): (\\d+)', 1) AS DOUBLE) AS hr,
               nullif(regexp_extract(text, 'Indication: ([^\\n]*)', 1), '') AS indication,
               nullif(regexp_extract(text, 'Status: ([^\\n]*)', 1), '') AS status,
               nullif(regexp_extract(text, 'Test: ([^\\n]*)', 1), '') AS test,
               nullif(regexp_extract(text, 'Doppler: ([^\\n]*)', 1), '') AS doppler,
               nullif(regexp_extract(text, 'Contrast: ([^\\n]*)', 1), '') AS contrast,
               nullif(regexp_extract(text, 'Technical Quality: ([^\\n]*)', 1), '') AS technicalquality
        FROM noteevents WHERE category = 'Echo'"""),
    "weights": (("chartevents", "icustays"), f"""
        SELECT icustay_id, avg({_kg}) AS weight FROM chartevents JOIN (SELECT icustay_id, intime FROM icustays) USING (icustay_id)
        WHERE itemid IN {_weights} AND valuenum <> 0 AND error <> 1
          AND abs(CAST(charttime AS DATE) - CAST(intime AS DATE)) <= 1 GROUP BY icustay_id"""),
    "echo_weights": (("echo_notes", "icustays"), f"""
        SELECT icustay_id, avg(weight * {it.LB_TO_KG!r}::DOUBLE) AS weight FROM icustays s JOIN echo_notes n ON n.hadm_id = s.hadm_id
         AND charttime > intime - INTERVAL 7 DAY AND charttime < intime + INTERVAL 1 DAY GROUP BY icustay_id"""),
    "sofa": (("icustays", "inputevents_cv", "inputevents_mv", "weights", "echo_weights", "gas_aided", "vitals_first_day",
              "labs_first_day", "gcs_first_day", "urine_output_first_day", "vent_first_day"), f"""
        SELECT subject_id, hadm_id, icustay_id, {', '.join(sc.SOFA)}, {summed(sc.SOFA)} AS sofa FROM (
          SELECT subject_id, hadm_id, icustay_id, {', '.join(graded(n, g) for n, g in sc.SOFA.items())} FROM (
            SELECT s.subject_id, s.hadm_id, s.icustay_id, {_rates}, meanbp_min, creatinine_max, bilirubin_max, platelet_min,
                   urineoutput, mingcs, pao2fio2_novent_min, pao2fio2_vent_min
            FROM icustays s
            LEFT JOIN (SELECT c.icustay_id, {_cv} FROM inputevents_cv c JOIN icustays i ON i.icustay_id = c.icustay_id
                        AND c.charttime BETWEEN i.intime AND i.intime + INTERVAL 1 DAY
                       LEFT JOIN weights w ON w.icustay_id = c.icustay_id LEFT JOIN echo_weights e ON e.icustay_id = c.icustay_id
                       WHERE itemid IN {_cv_codes} AND rate IS NOT NULL GROUP BY c.icustay_id) USING (icustay_id)
            LEFT JOIN (SELECT m.icustay_id, {_mv} FROM inputevents_mv m JOIN icustays i ON i.icustay_id = m.icustay_id
                        AND m.starttime BETWEEN i.intime AND i.intime + INTERVAL 1 DAY
                       WHERE statusdescription <> 'Rewritten' GROUP BY m.icustay_id) USING (icustay_id)
            LEFT JOIN (SELECT icustay_id, min(pao2fio2) FILTER (NOT vented) AS pao2fio2_novent_min,
                              min(pao2fio2) FILTER (vented) AS pao2fio2_vent_min FROM gas_aided GROUP BY icustay_id) USING (icustay_id)
            LEFT JOIN vitals_first_day v USING (icustay_id) LEFT JOIN labs_first_day l USING (icustay_id) {_join}))"""),
    "all_scores": (("oasis", "saps", "saps2", "sofa"), f"""
        SELECT * FROM oasis
        FULL JOIN (SELECT * EXCLUDE (subject_id, hadm_id, {_shared}) FROM saps) USING (icustay_id)
        FULL JOIN (SELECT * EXCLUDE (subject_id, hadm_id, {_shared}) FROM saps2) USING (icustay_id)
        FULL JOIN (SELECT * EXCLUDE (subject_id, hadm_id) FROM sofa) USING (icustay_id)"""),
}
