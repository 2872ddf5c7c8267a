"""Feature tables as DuckDB common table expressions (checks for the feature plans)."""

from __future__ import annotations

from icuflow.catalog.clinical_sql import in_list, lit
from icuflow.rules import items as it


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def pivot(names, stats) -> str:
    sql = {"min": "min", "max": "max", "mean": "avg"}
    return ",\n".join(f"{sql[s]}(num) FILTER (concept = '{n}') AS {n}_{s}" for n in names for s in stats)


_vital_rows = [
    (code, name, -1e9 if lo is None else float(lo), lo_closed, 1e9 if hi is None else float(hi), hi_closed,
     code in it.FAHRENHEIT_CODES)
    for name, specs in it.VITALS.items() for codes, lo, lo_closed, hi, hi_closed in specs for code in codes
]
_lab_rows = [(code, name, float(limit)) for name, (codes, limit) in it.LABS.items() for code in codes]
_gas_limits = [(c, -1e9 if lo is None else lo, 1e9 if hi is None else hi) for c, (lo, hi) in it.GAS_LIMITS.items()]
_term = " ".join(
    f"+ coalesce({w!r}::DOUBLE * {t}, {w!r}::DOUBLE * {m!r}::DOUBLE + {a!r}::DOUBLE)"
    for t, (w, m, a) in it.SPECIMEN_TERMS.items()
)
_fraction = "coalesce(fio2, fio2_chartevents)"
_sure_vent = [c for c in it.VENT_SETTING_CODES] + [it.VENT_MODE]
_gcs_names = [(c, n) for n, cs in it.GCS.items() for c in cs]
_order = "charttime, extubated, selfextubated, mechvent, oxygentherapy"

FEATURES: dict[str, tuple[tuple[str, ...], str]] = {
    "vital_map": ((), f"SELECT * FROM ({values(_vital_rows)}) AS m(code, concept, lo, lo_in, hi, hi_in, degf)"),
    "lab_map": ((), f"SELECT * FROM ({values(_lab_rows)}) AS m(code, concept, hi)"),
    "vital_rows": (("vital_map", "chartevents", "icustays"), """
        SELECT c.subject_id, c.hadm_id, c.icustay_id, c.charttime, s.intime, concept,
               CASE WHEN NOT ((valuenum > lo OR (lo_in AND valuenum = lo)) AND (valuenum < hi OR (hi_in AND valuenum = hi)))
                    THEN NULL WHEN degf THEN (valuenum - 32) / 1.8 ELSE valuenum END AS num
        FROM chartevents c JOIN vital_map ON itemid = code
        JOIN icustays s USING (subject_id, hadm_id, icustay_id) WHERE error <> 1"""),
    "vitals_first_day": (("vital_rows",), f"""
        SELECT subject_id, hadm_id, icustay_id, {pivot(it.VITALS, ['min', 'max', 'mean'])}
        FROM vital_rows GROUP BY ALL"""),
    "vitals_all": (("vital_rows", "admissions"), f"""
        SELECT subject_id, hadm_id, icustay_id, CAST(item_date - CAST(admittime AS DATE) AS INTEGER) AS days_since_admission,
               x.* EXCLUDE (subject_id, hadm_id, icustay_id, item_date)
        FROM (SELECT subject_id, hadm_id, icustay_id, CAST(charttime AS DATE) AS item_date, {pivot(it.VITALS, ['min', 'max', 'mean'])}
              FROM vital_rows WHERE CAST(charttime AS DATE) - CAST(intime AS DATE) BETWEEN 0 AND 2 GROUP BY ALL) x
        LEFT JOIN admissions USING (hadm_id)"""),
    "lab_window": (("labevents", "icustays"), """
        SELECT s.icustay_id, l.itemid, l.charttime, l.value, l.valuenum FROM labevents l
        JOIN icustays s ON s.subject_id = l.subject_id AND s.hadm_id = l.hadm_id
         AND l.charttime >= s.intime - INTERVAL 6 HOUR AND l.charttime <= s.intime + INTERVAL 24 HOUR"""),
    "labs_first_day": (("lab_window", "lab_map", "icustays"), f"""
        SELECT s.subject_id, s.hadm_id, s.icustay_id, x.* EXCLUDE (icustay_id) FROM icustays s LEFT JOIN (
            SELECT icustay_id, {pivot(it.LABS, ['min', 'max'])}
            FROM (SELECT icustay_id, concept, CASE WHEN valuenum <= hi THEN valuenum END AS num
                  FROM lab_window JOIN lab_map ON itemid = code WHERE valuenum > 0) GROUP BY icustay_id) x USING (icustay_id)"""),
    "bloodgas_first_day": (("lab_window", "icustays"), f"""
        SELECT s.subject_id, s.hadm_id, s.icustay_id, x.* EXCLUDE (icustay_id) FROM icustays s LEFT JOIN (
            SELECT icustay_id, charttime, max(value) FILTER (itemid = {it.GAS['specimen']}) AS specimen,
                   {', '.join(f"max(num) FILTER (itemid = {c}) AS {n}" for n, c in it.GAS.items() if n != 'specimen')}
            FROM (SELECT w.*, CASE WHEN (valuenum > 0 OR itemid = {it.GAS_NEGATIVE_ALLOWED})
                                    AND valuenum BETWEEN coalesce(lo, -1e9) AND coalesce(hi, 1e9) THEN valuenum END AS num
                  FROM lab_window w LEFT JOIN ({values(_gas_limits)}) g(code, lo, hi) ON itemid = code
                  WHERE itemid IN {in_list(it.GAS_CODES)})
            GROUP BY icustay_id, charttime) x USING (icustay_id)"""),
    "spo2_times": (("chartevents",), f"""
        SELECT icustay_id, charttime AS spo2_at, max(valuenum) FILTER (valuenum > 0 AND valuenum <= 100) AS spo2
        FROM chartevents WHERE itemid IN {in_list(it.SPO2_CODES)} GROUP BY ALL"""),
    "fio2_times": (("chartevents",), f"""
        SELECT icustay_id, charttime AS fio2_at, max(CASE
                   WHEN itemid = {it.FIO2_MIXED} AND valuenum > 0 AND valuenum <= 1 THEN valuenum * 100
                   WHEN itemid = {it.FIO2_MIXED} AND valuenum BETWEEN 21 AND 100 THEN valuenum
                   WHEN itemid IN {in_list(it.FIO2_PERCENT)} THEN valuenum
                   WHEN itemid = {it.FIO2_FRACTION} AND valuenum > 0.2::DOUBLE AND valuenum < 1 THEN valuenum * 100 END) AS fio2_chartevents
        FROM chartevents WHERE itemid IN {in_list([it.FIO2_MIXED, it.FIO2_FRACTION, *it.FIO2_PERCENT])} AND error <> 1 GROUP BY ALL"""),
    "bloodgas_arterial": (("bloodgas_first_day", "spo2_times", "fio2_times"), f"""
        SELECT *, CASE WHEN specimen IS NOT NULL THEN specimen WHEN specimen_prob > 0.75 THEN 'ART' END AS specimen_pred,
               ({_fraction} / 100) * 713 - pco2 / 0.8 - po2 AS aado2_calc, 100 * po2 / {_fraction} AS pao2fio2
        FROM (SELECT *, 1 / (1 + exp(-({it.SPECIMEN_INTERCEPT!r}::DOUBLE + {it.SPECIMEN_PO2_WEIGHT!r}::DOUBLE * po2 {_term}))) AS specimen_prob
              FROM (SELECT g.*, CASE WHEN charttime - spo2_at <= INTERVAL 2 HOUR THEN spo2 END AS spo2,
                           CASE WHEN charttime - fio2_at <= INTERVAL 4 HOUR THEN fio2_chartevents END AS fio2_chartevents
                    FROM (SELECT * FROM bloodgas_first_day WHERE po2 IS NOT NULL) g
                    ASOF LEFT JOIN spo2_times a ON a.icustay_id = g.icustay_id AND g.charttime >= a.spo2_at
                    ASOF LEFT JOIN fio2_times b ON b.icustay_id = g.icustay_id AND g.charttime >= b.fio2_at))
        WHERE specimen = 'ART' OR specimen_prob > 0.75"""),
    "gcs_first_day": (("chartevents", "icustays"), f"""
        SELECT icustay_id, gcsmotor, gcsverbal, gcseyes, CASE WHEN gcsverbal = 0 THEN 1 ELSE 0 END AS endotrachflag, gcs AS mingcs
        FROM (SELECT *, row_number() OVER (PARTITION BY icustay_id ORDER BY gcs, charttime) AS place
              FROM (SELECT *, CASE WHEN coalesce(gcsverbal, v0) = 0 AND (gcsverbal = 0 OR gcsverbal IS NULL) THEN 15
                                   ELSE coalesce(gcsmotor, CASE WHEN v0 IS DISTINCT FROM 0 THEN m0 END, 6)
                                      + coalesce(gcsverbal, CASE WHEN v0 IS DISTINCT FROM 0 THEN v0 END, 5)
                                      + coalesce(gcseyes, CASE WHEN v0 IS DISTINCT FROM 0 THEN e0 END, 4) END AS gcs
                    FROM (SELECT *, lag(gcsmotor) OVER w AS m0, lag(gcsverbal) OVER w AS v0, lag(gcseyes) OVER w AS e0
                          FROM (SELECT icustay_id, charttime, {', '.join(f"max(num) FILTER (concept = '{n}') AS {n}" for n in it.GCS)}
                                FROM (SELECT c.icustay_id, charttime, concept,
                                             CASE WHEN (itemid = 723 AND value = '1.0 ET/Trach') OR (itemid = 223900 AND value = 'No Response-ETT')
                                                  THEN 0 ELSE valuenum END AS num
                                      FROM chartevents c JOIN ({values(_gcs_names)}) g(code, concept) ON itemid = code
                                      JOIN icustays s ON s.icustay_id = c.icustay_id
                                      WHERE error IS DISTINCT FROM 1 AND CAST(charttime AS DATE) - CAST(intime AS DATE) BETWEEN 0 AND 1)
                                GROUP BY icustay_id, charttime)
                          WINDOW w AS (PARTITION BY icustay_id ORDER BY charttime))))
        WHERE place = 1"""),
    "urine_output_first_day": (("outputevents", "icustays"), f"""
        SELECT subject_id, hadm_id, icustay_id, sum(CASE WHEN itemid = {it.URINE_IRRIGANT} THEN -abs(value) ELSE value END) AS urineoutput
        FROM outputevents JOIN icustays USING (subject_id, hadm_id, icustay_id)
        WHERE itemid IN {in_list(it.URINE_CODES)} AND CAST(charttime AS DATE) - CAST(intime AS DATE) BETWEEN 0 AND 1 GROUP BY ALL"""),
    "vent_settings": (("chartevents", "procedureevents_mv"), f"""
        SELECT icustay_id, charttime,
               CAST(bool_or(itemid IN {in_list(_sure_vent)} OR (itemid = 720 AND value <> 'Other/Remarks')
                            OR (itemid = 223848 AND value <> 'Other') OR (itemid = 467 AND value = 'Ventilator')) AS INTEGER) AS mechvent,
               CAST(bool_or((itemid = 226732 AND value IN {in_list(it.OXYGEN_TEXT_MV)})
                            OR (itemid = 467 AND value IN {in_list(it.OXYGEN_TEXT_CV)})) AS INTEGER) AS oxygentherapy,
               CAST(bool_or(itemid = 640 AND value IN ('Extubated', 'Self Extubation')) AS INTEGER) AS extubated,
               CAST(bool_or(itemid = 640 AND value = 'Self Extubation') AS INTEGER) AS selfextubated
        FROM chartevents WHERE value <> '' AND error <> 1 AND itemid IN {in_list(it.VENT_READ_CODES)} GROUP BY ALL
        UNION ALL
        SELECT icustay_id, starttime, 0, 0, 1, CASE WHEN itemid = 225468 THEN 1 ELSE 0 END
        FROM procedureevents_mv WHERE itemid IN {in_list(it.EXTUBATION_PROCEDURES)}"""),
    "vent_durations": (("vent_settings",), f"""
        SELECT icustay_id, CAST(row_number() OVER (PARTITION BY icustay_id ORDER BY t0) AS INTEGER) AS ventnum,
               t0 AS starttime, t1 AS endtime, (epoch(t1) - epoch(t0)) / 3600 AS duration_hours
        FROM (SELECT icustay_id, spell, min(charttime) AS t0, max(charttime) AS t1, max(mechvent) AS v
              FROM (SELECT *, sum(fresh) OVER (PARTITION BY icustay_id ORDER BY charttime) AS spell
                    FROM (SELECT *, CASE WHEN lag(extubated) OVER (PARTITION BY icustay_id, active ORDER BY {_order}) = 1 THEN 1
                                         WHEN mechvent = 0 AND oxygentherapy = 1 THEN 1
                                         WHEN mechvent = 1 AND date_sub('hour', lag(charttime) OVER (PARTITION BY icustay_id, mechvent ORDER BY {_order}), charttime) > 8
                                         THEN 1 ELSE 0 END AS fresh
                          FROM (SELECT *, (mechvent = 1 OR extubated = 1) AS active FROM vent_settings WHERE icustay_id IS NOT NULL)))
              WHERE active GROUP BY icustay_id, spell)
        WHERE t0 <> t1 AND v = 1"""),
    "vent_first_day": (("vent_durations", "icustays"), """
        SELECT icustay_id, CASE WHEN EXISTS (SELECT 1 FROM vent_durations d WHERE d.icustay_id = s.icustay_id
               AND starttime <= intime + INTERVAL 1 DAY AND endtime >= intime) THEN 1 ELSE 0 END AS mechvent FROM icustays s"""),
}


def rounded(table: str, names, keep=(), times=()) -> str:
    """Measured and nullable columns as doubles rounded to eight places, dates and times as text."""
    cols = [*keep, *[f"round(CAST({n} AS DOUBLE), 8) AS {n}" for n in names], *[f"CAST({t} AS VARCHAR) AS {t}" for t in times]]
    return f"SELECT {', '.join(cols)} FROM {table}"
