"""The clinical views once more, as DuckDB common table expressions for the checks.

Written from the view rules, not from the Spark code; only the constant lists are shared.
"""

from __future__ import annotations

from icuflow.sources import clinical as c


def lit(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def arr(values, index) -> str:
    """Entry of a constant list at a zero-based index."""
    return f"([{', '.join(lit(v) for v in values)}])[CAST({index} AS INTEGER) + 1]"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def _reading(items):
    n = len(items)
    return (f"({arr([float(i[1]) for i in items], f'event_id % {n}')}"
            f" + {arr([float(i[2]) for i in items], f'event_id % {n}')} * share)")


_chart_code = arr([i[0] for i in c.CHART_ITEMS], f"event_id % {len(c.CHART_ITEMS)}")
_n_special = len(c.SPECIAL_CODES)


def _code(n):
    return (f"CASE WHEN {n} < {_n_special} THEN {arr(c.SPECIAL_CODES, n)} "
            f"ELSE lpad(CAST({n} AS VARCHAR), 3, '0') || CAST({n} % 10 AS VARCHAR) || ' ' END")


# name -> (needed views, query)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "icustays": ((), f"""
        SELECT user_id - CASE WHEN user_id % 5 = 1 THEN 1 ELSE 0 END AS subject_id, user_id + 1000 AS hadm_id,
               user_id AS icustay_id, t0 AS intime,
               t0 + to_days(CAST(1 + user_id % 9 AS INTEGER)) + to_hours(CAST(user_id % 24 AS INTEGER)) AS outtime,
               (1 + user_id % 9) + (user_id % 24) / 24.0::DOUBLE AS los,
               {arr(c.CARE_UNITS, 'user_id % 5')} AS curr_careunit,
               CAST(10 + user_id % 40 AS INTEGER) AS last_wardid, CAST(-(user_id % 7) AS INTEGER) AS diff
        FROM (SELECT user_id, date_trunc('second', min(ts)) AS t0 FROM events GROUP BY user_id)"""),
    "patients": (("icustays",), """
        SELECT DISTINCT subject_id, CASE WHEN subject_id % 3 = 0 THEN 'F' ELSE 'M' END AS gender,
               CAST(DATE '1930-01-01' + CAST((subject_id * 211) % 30000 AS INTEGER) AS TIMESTAMP) AS dob
        FROM icustays"""),
    "admissions": (("icustays",), f"""
        SELECT hadm_id, intime - to_minutes(CAST((icustay_id % 30) * (icustay_id % 30) * 30 AS INTEGER)) AS admittime,
               outtime + to_hours(CAST((icustay_id % 3 - 1) * 6 AS INTEGER)) AS dischtime,
               CASE WHEN icustay_id % 2 = 0 THEN NULL WHEN icustay_id % 11 = 1 THEN intime - INTERVAL 2 HOUR
                    WHEN icustay_id % 4 = 1 THEN outtime - INTERVAL 1 HOUR ELSE outtime + INTERVAL 5 HOUR END AS deathtime,
               CASE WHEN icustay_id % 2 = 1 THEN 'DEAD/EXPIRED' ELSE {arr(c.DISCHARGES, 'icustay_id % 3')} END AS discharge_location,
               CAST(icustay_id % 2 AS INTEGER) AS hospital_expire_flag,
               {arr(c.INSURANCES, 'icustay_id % 5')} AS insurance, {arr(c.ADMISSION_TYPES, 'icustay_id % 6')} AS admission_type
        FROM icustays"""),
    "services": (("icustays",), f"""
        SELECT hadm_id, intime + to_hours(CAST((icustay_id % 4 - 1) * 12 AS INTEGER)) AS transfertime,
               {arr(['MED', 'CSURG', 'ORTHO', None], 'icustay_id % 4')} AS curr_service FROM icustays
        UNION ALL
        SELECT hadm_id, intime + to_seconds(CAST((icustay_id % 5) * 21600 + 60 AS INTEGER)),
               {arr(['TSURG', 'MED', 'NSURG'], 'icustay_id % 3')} FROM icustays"""),
    "timed": (("icustays",), """
        SELECT subject_id, hadm_id, icustay_id, intime, event_id, event_type, ts, value,
               CAST(json_extract(props, '$.k') AS INTEGER) AS k, (value % 100) / 100 AS share,
               CAST((epoch_us(ts) // 1000000 - epoch_us(intime) // 1000000) // 86400 AS INTEGER) AS day,
               intime + to_seconds(((epoch_us(ts) // 1000000 - epoch_us(intime) // 1000000) // 18000) * 1800 - 43200) AS tm
        FROM events JOIN icustays ON user_id = icustay_id"""),
    "chartevents": (("timed",), f"""
        SELECT subject_id, hadm_id, icustay_id, itemid, tm AS charttime,
               CASE WHEN k = 13 THEN NULL
                    WHEN itemid IN (467, 469) THEN {arr(c.TEXT_467, 'k % 7')}
                    WHEN itemid = 226732 THEN {arr(c.TEXT_226732, 'k % 5')}
                    WHEN itemid = 720 THEN {arr(c.TEXT_720, 'k % 3')}
                    WHEN itemid = 640 THEN {arr(c.TEXT_640, 'k % 3')}
                    WHEN itemid IN (723, 223900) THEN {arr(c.TEXT_GCS, 'k % 4')}
                    ELSE 'n' || CAST(k AS VARCHAR) END AS value,
               CASE WHEN k = 17 THEN NULL WHEN itemid IN (454, 223901, 723, 223900, 184, 220739) THEN floor(reading)
                    ELSE reading END AS valuenum,
               CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS error,
               event_id % ((SELECT count(*) FROM supplier) + 3) AS cgid
        FROM (SELECT *, {_chart_code} AS itemid, {_reading(c.CHART_ITEMS)} AS reading FROM timed)"""),
    "labevents": (("timed",), f"""
        SELECT subject_id, hadm_id, {arr([i[0] for i in c.LAB_ITEMS], f'event_id % {len(c.LAB_ITEMS)}')} AS itemid,
               tm AS charttime, CASE WHEN k % 3 = 0 THEN 'VEN' ELSE 'ART' END AS value,
               CASE WHEN k = 7 THEN NULL ELSE {_reading(c.LAB_ITEMS)} END AS valuenum FROM timed"""),
    "outputevents": (("timed",), f"""
        SELECT subject_id, hadm_id, icustay_id, {arr(c.OUTPUT_ITEMS, f'event_id % {len(c.OUTPUT_ITEMS)}')} AS itemid,
               tm AS charttime, CASE WHEN k = 5 THEN NULL ELSE value * 2 END AS value FROM timed"""),
    "inputevents_cv": (("timed",), f"""
        SELECT icustay_id, CASE WHEN icustay_id % 3 = 0 THEN {arr(c.CV_ITEMS, f'event_id % {len(c.CV_ITEMS)}')} ELSE 30018 END AS itemid,
               tm AS charttime, CASE WHEN k % 5 = 0 THEN NULL ELSE value / 20 END AS rate FROM timed"""),
    "inputevents_mv": (("timed",), f"""
        SELECT icustay_id, CASE WHEN icustay_id % 3 = 1 THEN {arr(c.MV_ITEMS, f'event_id % {len(c.MV_ITEMS)}')} ELSE 225158 END AS itemid,
               tm AS starttime, value / 400 AS rate,
               CASE WHEN k % 4 = 0 THEN 'Rewritten' ELSE 'FinishedRunning' END AS statusdescription FROM timed"""),
    "procedureevents_mv": (("timed",), f"""
        SELECT subject_id, hadm_id, CASE WHEN k = 11 THEN NULL ELSE icustay_id END AS icustay_id,
               {arr(c.PROCEDURE_ITEMS, f'event_id % {len(c.PROCEDURE_ITEMS)}')} AS itemid, tm AS starttime,
               tm + to_days(CASE WHEN k % 20 = 19 THEN -2 ELSE k % 5 END) AS endtime,
               {arr(c.PROCEDURE_CLASSES, f'event_id % {len(c.PROCEDURE_CLASSES)}')} AS ordercategoryname FROM timed"""),
    "d_items": (("procedureevents_mv",), """
        SELECT DISTINCT itemid, 'item ' || CAST(itemid AS VARCHAR) AS label FROM procedureevents_mv WHERE itemid <> 225402"""),
    "diagnoses_icd": ((), f"""
        SELECT hadm_id, CAST(number + 1 AS INTEGER) AS seq_num, {_code('number')} AS icd9_code
        FROM (SELECT DISTINCT 1000 + l_orderkey % (SELECT max(user_id) + 1 FROM events) AS hadm_id,
                     l_partkey % {c.CODE_COUNT} AS number FROM lineitem)"""),
    "d_icd_diagnoses": ((), f"""
        SELECT {_code('number')} AS icd9_code, 'Dx ' || CAST(number // 2 AS VARCHAR) AS short_title,
               'Diagnosis number ' || CAST(number AS VARCHAR) AS long_title
        FROM (SELECT DISTINCT p_partkey % {c.CODE_COUNT} AS number FROM part)"""),
    "caregivers": ((), f"""
        SELECT s_suppkey AS cgid, {arr(['Doctor', 'Nurse', 'Other'], 's_suppkey % 3')} AS class FROM supplier"""),
    "noteevents": ((), """
        SELECT doc_id AS row_id, doc_id % n AS subject_id, 1000 + doc_id % n AS hadm_id,
               DATE '2024-01-01' + CAST(doc_id % 5 AS INTEGER) AS chartdate,
               CASE WHEN doc_id % 2 = 0 THEN 'Echo' ELSE 'Nursing' END AS category,
               concat('Indication: ', lang, chr(10), 'Height: (in) ',
                      CASE WHEN doc_id % 7 = 0 THEN '[** Numeric **]' ELSE CAST(55 + doc_id % 20 AS VARCHAR) END, chr(10), 'Weight (lb): ',
                      CASE WHEN doc_id % 5 = 0 THEN '[** Numeric **]' ELSE CAST(90 + doc_id % 150 AS VARCHAR) END,
                      CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(chr(10), 'BSA (m2): 1.', 10 + doc_id % 80, ' m2') END,
                      chr(10), 'BP (mm Hg): ', 90 + doc_id % 60, '/', 50 + doc_id % 40, chr(10), 'HR (bpm): ', 50 + doc_id % 70,
                      chr(10), CASE WHEN doc_id % 4 = 0 THEN 'Status: Inpatient' ELSE 'Status: Outpatient' END,
                      chr(10), 'Date/Time: [**2024-1-', doc_id % 28, '**] at ', lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0'), ':',
                      lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0'), chr(10), 'Test: TTE', doc_id, chr(10), 'Doppler: Full Doppler',
                      chr(10), 'Contrast: None', chr(10), 'Technical Quality: ',
                      CASE WHEN doc_id % 6 = 0 THEN 'Suboptimal' ELSE 'Adequate' END, chr(10), chr(10), text) AS text
        FROM documents, (SELECT max(user_id) + 1 AS n FROM events)"""),
    "run_agent": (("timed",), """
        SELECT CAST(event_id % 4 AS INTEGER) AS run_number, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS step,
               icustay_id AS agent_id, CASE WHEN event_type = 'error' AND k < 10 THEN 1 ELSE 0 END AS out_flag,
               day AS days_in_hospital,
               CASE event_type WHEN 'signup' THEN 'CSRU' WHEN 'view' THEN 'MICU' WHEN 'click' THEN 'SICU'
                    WHEN 'purchase' THEN 'TSICU' ELSE 'Other' END AS careunit,
               value / 500 AS cum_caretime_doctors, value / 5 AS cum_caretime_nurses FROM timed"""),
    "run_model": (("run_agent",), """
        SELECT run_number, step, CASE WHEN run_number % 2 = 0 THEN 1 + 2 * run_number ELSE 200 + 100 * run_number END AS n_doctors,
               CASE WHEN run_number % 2 = 0 THEN 200 + 100 * run_number ELSE 1 + 2 * run_number END AS n_nurses,
               80 + 20 * (run_number % 3) AS max_agents,
               count(*) FILTER (careunit <> 'Other') / count(*)::DOUBLE AS demand_serviced
        FROM run_agent GROUP BY run_number, step"""),
}


def with_views(body: str, *names: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """A statement with the needed views, each once, in front of ``body``."""
    known = {**VIEWS, **(extra or {})}
    done: list[str] = []

    def add(name):
        if name in done:
            return
        for need in known[name][0]:
            add(need)
        done.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({known[n][1]})" for n in done)
    return f"WITH {ctes}\n{body}"
