"""Clinical input tables laid over the benchmark tables.

The clinical tables of the pipelines are access-restricted, so every one is derived here from
the given parquet files by plain projections: stays from the users of ``events``, measurements from
its rows, diagnoses from ``lineitem``, caregivers from ``supplier``, notes from ``documents``. Each
view reads its whole table. On real data pass the tables themselves under the same names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.functions.values import epoch, plus_seconds
from icuflow.operators.joins import join_stays
from icuflow.sources.tables import scan

CARE_UNITS = ["CCU", "CSRU", "MICU", "SICU", "TSICU"]
INSURANCES = ["Medicare", "Private", "Medicaid", "Government", "Self Pay"]
ADMISSION_TYPES = ["ELECTIVE", "EMERGENCY", "URGENT", "ELECTIVE", "NEWBORN", None]
DISCHARGES = ["HOME", "SNF", "REHAB"]

# item code, smallest value, spread: a reading is smallest + spread * share, partly implausible
CHART_ITEMS = [
    (211, 20, 150), (220045, 30, 280), (51, 40, 180), (455, 60, 140), (220179, -10, 430), (8368, 20, 100),
    (220180, 30, 120), (456, 15, 140), (52, 30, 100), (220052, 40, 270), (615, 4, 36), (618, 6, 70),
    (220210, 3, 45), (223761, 85, 40), (678, 92, 14), (223762, 28, 14), (676, 33, 8), (646, 75, 28),
    (220277, 80, 20), (807, 30, 400), (811, 20, 780), (225664, 50, 200), (454, 1, 6), (223901, 1, 5),
    (723, 0, 5), (223900, 0, 5), (184, 1, 4), (220739, 1, 3), (467, 0, 10), (469, 0, 10), (226732, 0, 10),
    (720, 0, 10), (640, 0, 10), (223849, 1, 3), (445, 2, 10), (639, 300, 400), (444, 5, 30), (459, 1, 9),
    (543, 10, 20), (506, 0, 15), (223835, 0, 100), (223835, 0, 2), (3420, 21, 79), (190, 0, 1.2), (762, 0, 120),
    (3581, 90, 200), (3582, 1500, 3000),
]
LAB_ITEMS = [
    (50868, 5, 20), (50862, 1, 11), (51144, 0, 110), (50882, 3, 40), (50885, 0, 160), (50912, 0, 8), (50902, 80, 40),
    (50931, 20, 400), (51221, 15, 50), (51222, 5, 50), (51265, 5, 400), (50971, 2, 6), (51275, 20, 140), (51237, 0, 8),
    (51274, 9, 150), (50983, 105, 100), (51006, 2, 100), (51301, 0, 45), (51300, -1, 30), (50800, 0, 1),
    (50801, 100, 500), (50802, -12, 24), (50803, 10, 30), (50804, 10, 35), (50805, 0, 5), (50806, 80, 40),
    (50807, 0, 1), (50808, 0, 2), (50809, 30, 300), (50810, 15, 90), (50811, 5, 12), (50812, 0, 1), (50813, 0, 12),
    (50814, 0, 3), (50815, 0, 80), (50816, 10, 100), (50817, 70, 34), (50818, 20, 50), (50819, 0, 15), (50820, 7, 0.6),
    (50821, 30, 800), (50822, 2, 6), (50823, 0, 50), (50824, 110, 100), (50825, 33, 7), (50826, 300, 400),
    (50827, 8, 22), (50828, 0, 20), (51545, 0, 1), (50821, 40, 90), (50821, 50, 110), (50821, 60, 240),
    (50800, 0, 1), (50800, 0, 1), (50816, 25, 70), (51265, 10, 200), (50912, 0, 5), (50885, 0, 14), (50882, 10, 25),
]
OUTPUT_ITEMS = [
    40055, 43175, 40069, 40094, 40715, 40473, 40085, 40057, 40056, 40405, 40428, 40086, 40096, 40651, 226559, 226560,
    226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227488, 227489, 40054, 226599, 40066,
]
CV_ITEMS = [30047, 30120, 30044, 30119, 30309, 30043, 30307, 30042, 30306, 30051, 30021]
MV_ITEMS = [221906, 221289, 221662, 221653, 222315, 225158, 225943]
PROCEDURE_ITEMS = [225792, 227194, 225794, 225468, 225477, 225402, 225459]
PROCEDURE_CLASSES = ["Ventilation", "Significant Events", "Invasive Lines"]
SPECIAL_CODES = [
    "042  ", "0449 ", "20010", "20245", "20302", "2386 ", "1970 ", "20979", "78951", "V3001", "E8500", "0380 ",
]
CODE_COUNT = 997
TEXT_467 = ["Ventilator", "Cannula", "None", "Face Tent", "CPAP mask", "Bipap Mask", ""]
TEXT_226732 = ["Nasal cannula", "Trach mask ", "None", "Bipap mask ", "High flow neb"]
TEXT_720 = ["Other/Remarks", "Drager", "7200A"]
TEXT_640 = ["Extubated", "Self Extubation", "Other"]
TEXT_GCS = ["1.0 ET/Trach", "No Response-ETT", "Oriented", "Confused"]


def pick(values, index):
    """Entry of a constant list by a zero-based index column."""
    listed = ", ".join("NULL" if v is None else repr(v) if not isinstance(v, float) else f"{v}D" for v in values)
    return F.element_at(F.expr(f"array({listed})"), index.cast("int") + 1)


def reading(items):
    """Synthetic measurement: smallest value plus spread times the share, both looked up by event."""
    n, e = len(items), F.col("event_id")
    return pick([float(i[1]) for i in items], e % n) + pick([float(i[2]) for i in items], e % n) * F.col("share")


def code(number):
    """Diagnosis code of a number; a few special codes, else three digits, one more and a blank."""
    plain = F.concat(F.lpad(number.cast("string"), 3, "0"), (number % 10).cast("string"), F.lit(" "))
    special = pick(SPECIAL_CODES, F.least(number, F.lit(len(SPECIAL_CODES) - 1)))
    return F.when(number < len(SPECIAL_CODES), special).otherwise(plain)


class ClinicalViews(Mapping):
    """The clinical tables by name, each built when first asked for."""

    names = (
        "icustays", "patients", "admissions", "services", "chartevents", "labevents", "outputevents", "inputevents_cv",
        "inputevents_mv", "procedureevents_mv", "diagnoses_icd", "d_icd_diagnoses", "d_items", "caregivers",
        "noteevents", "run_model", "run_agent",
    )

    def __init__(self, spark: SparkSession, folder: str, hold: Callable[[DataFrame, str], DataFrame]):
        self.spark, self.folder, self.hold = spark, folder, hold

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self):
        return iter(self.names)

    def __len__(self):
        return len(self.names)

    @cached_property
    def events(self) -> DataFrame:
        return scan(self.spark, self.folder, "events").withColumn(
            "k", F.regexp_extract("props", r"(\d+)", 1).cast("int")
        )

    @cached_property
    def icustays(self) -> DataFrame:
        u = F.col("user_id")
        return self.hold(self.events.groupBy("user_id").agg(F.date_trunc("second", F.min("ts")).alias("intime")).select(
            (u - F.when(u % 5 == 1, 1).otherwise(0)).alias("subject_id"),
            (u + 1000).alias("hadm_id"),
            u.alias("icustay_id"),
            "intime",
            plus_seconds(F.col("intime"), (1 + u % 9) * 86400 + (u % 24) * 3600).alias("outtime"),
            ((1 + u % 9) + (u % 24) / 24.0).alias("los"),
            pick(CARE_UNITS, u % 5).alias("curr_careunit"),
            (10 + u % 40).cast("int").alias("last_wardid"),
            (-(u % 7)).cast("int").alias("diff"),
        ), "icustays")

    @cached_property
    def patients(self) -> DataFrame:
        s = F.col("subject_id")
        return self.icustays.select("subject_id").distinct().select(
            "subject_id",
            F.when(s % 3 == 0, "F").otherwise("M").alias("gender"),
            F.date_add(F.lit("1930-01-01").cast("date"), ((s * 211) % 30000).cast("int")).cast("timestamp_ntz").alias("dob"),
        )

    @cached_property
    def admissions(self) -> DataFrame:
        v = F.col("icustay_id")
        dies = v % 2 == 1
        return self.icustays.select(
            "hadm_id",
            plus_seconds(F.col("intime"), -(v % 30) * (v % 30) * 1800).alias("admittime"),
            plus_seconds(F.col("outtime"), (v % 3 - 1) * 21600).alias("dischtime"),
            F.when(~dies, None).when(v % 11 == 1, plus_seconds(F.col("intime"), F.lit(-7200)))
            .when(v % 4 == 1, plus_seconds(F.col("outtime"), F.lit(-3600)))
            .otherwise(plus_seconds(F.col("outtime"), F.lit(18000))).alias("deathtime"),
            F.when(dies, "DEAD/EXPIRED").otherwise(pick(DISCHARGES, v % 3)).alias("discharge_location"),
            (v % 2).cast("int").alias("hospital_expire_flag"),
            pick(INSURANCES, v % 5).alias("insurance"),
            pick(ADMISSION_TYPES, v % 6).alias("admission_type"),
        )

    @cached_property
    def services(self) -> DataFrame:
        v = F.col("icustay_id")
        return self.icustays.select("hadm_id", F.explode(F.array(
            F.struct(
                plus_seconds(F.col("intime"), (v % 4 - 1) * 43200).alias("transfertime"),
                pick(["MED", "CSURG", "ORTHO", None], v % 4).alias("curr_service"),
            ),
            F.struct(
                plus_seconds(F.col("intime"), (v % 5) * 21600 + 60).alias("transfertime"),
                pick(["TSURG", "MED", "NSURG"], v % 3).alias("curr_service"),
            ),
        )).alias("s")).select("hadm_id", "s.*")

    @cached_property
    def timed(self) -> DataFrame:
        v = F.col("icustay_id")
        since = epoch(F.col("ts")) - epoch(F.col("intime"))
        return self.hold(join_stays(
            self.events, self.icustays.select(v.alias("user_id"), "subject_id", "hadm_id", "icustay_id", "intime"),
            ["user_id"], ["event_id"],
        ).select(
            "subject_id", "hadm_id", "icustay_id", "event_id", "event_type", "ts", "value", "k",
            F.floor(since / 86400).cast("int").alias("day"),
            plus_seconds(F.col("intime"), F.floor(since / 18000) * 1800 - 43200).alias("at"),
            ((F.col("value") % 100) / 100).alias("share"),
        ), "timed")

    @cached_property
    def chartevents(self) -> DataFrame:
        e = F.col("event_id")
        k = F.col("k")
        chart_code = pick([i[0] for i in CHART_ITEMS], e % len(CHART_ITEMS))
        n_suppliers = scan(self.spark, self.folder, "supplier", "s_suppkey").agg(F.count(F.lit(1))).scalar()
        whole = chart_code.isin(454, 223901, 723, 223900, 184, 220739)
        return self.timed.select(
            "subject_id", "hadm_id", "icustay_id", chart_code.alias("itemid"), F.col("at").alias("charttime"),
            F.when(k == 13, None)
            .when(chart_code.isin(467, 469), pick(TEXT_467, k % 7))
            .when(chart_code == 226732, pick(TEXT_226732, k % 5))
            .when(chart_code == 720, pick(TEXT_720, k % 3))
            .when(chart_code == 640, pick(TEXT_640, k % 3))
            .when(chart_code.isin(723, 223900), pick(TEXT_GCS, k % 4))
            .otherwise(F.concat(F.lit("n"), k.cast("string"))).alias("value"),
            F.when(k == 17, None).when(whole, F.floor(reading(CHART_ITEMS)).cast("double"))
            .otherwise(reading(CHART_ITEMS)).alias("valuenum"),
            F.when(e % 10 == 0, None).when(e % 10 == 1, 1).otherwise(0).alias("error"),
            (e % (n_suppliers + 3)).alias("cgid"),
        )

    @cached_property
    def labevents(self) -> DataFrame:
        e = F.col("event_id")
        k = F.col("k")
        return self.timed.select(
            "subject_id", "hadm_id", pick([i[0] for i in LAB_ITEMS], e % len(LAB_ITEMS)).alias("itemid"),
            F.col("at").alias("charttime"),
            F.when(k % 3 == 0, "VEN").otherwise("ART").alias("value"),
            F.when(k == 7, None).otherwise(reading(LAB_ITEMS)).alias("valuenum"),
        )

    @cached_property
    def outputevents(self) -> DataFrame:
        e = F.col("event_id")
        k = F.col("k")
        return self.timed.select(
            "subject_id", "hadm_id", "icustay_id", pick(OUTPUT_ITEMS, e % len(OUTPUT_ITEMS)).alias("itemid"),
            F.col("at").alias("charttime"), F.when(k == 5, None).otherwise(F.col("value") * 2).alias("value"),
        )

    @cached_property
    def inputevents_cv(self) -> DataFrame:
        v = F.col("icustay_id")
        e = F.col("event_id")
        k = F.col("k")
        return self.timed.select(
            "icustay_id",
            F.when(v % 3 == 0, pick(CV_ITEMS, e % len(CV_ITEMS))).otherwise(30018).alias("itemid"),
            F.col("at").alias("charttime"),
            F.when(k % 5 == 0, None).otherwise(F.col("value") / 20).alias("rate"),
        )

    @cached_property
    def inputevents_mv(self) -> DataFrame:
        v = F.col("icustay_id")
        e = F.col("event_id")
        k = F.col("k")
        return self.timed.select(
            "icustay_id",
            F.when(v % 3 == 1, pick(MV_ITEMS, e % len(MV_ITEMS))).otherwise(225158).alias("itemid"),
            F.col("at").alias("starttime"),
            (F.col("value") / 400).alias("rate"),
            F.when(k % 4 == 0, "Rewritten").otherwise("FinishedRunning").alias("statusdescription"),
        )

    @cached_property
    def procedureevents_mv(self) -> DataFrame:
        e = F.col("event_id")
        k = F.col("k")
        return self.timed.select(
            "subject_id", "hadm_id", F.when(k == 11, None).otherwise(F.col("icustay_id")).alias("icustay_id"),
            pick(PROCEDURE_ITEMS, e % len(PROCEDURE_ITEMS)).alias("itemid"), F.col("at").alias("starttime"),
            plus_seconds(F.col("at"), (F.when(k % 20 == 19, -2).otherwise(k % 5) * 86400)).alias("endtime"),
            pick(PROCEDURE_CLASSES, e % len(PROCEDURE_CLASSES)).alias("ordercategoryname"),
        )

    @cached_property
    def d_items(self) -> DataFrame:
        return self.procedureevents_mv.filter(F.col("itemid") != 225402).select("itemid").distinct().select(
            "itemid", F.concat(F.lit("item "), F.col("itemid").cast("string")).alias("label")
        )

    @cached_property
    def diagnoses_icd(self) -> DataFrame:
        coded = scan(self.spark, self.folder, "lineitem", "l_orderkey", "l_partkey").select(
            (1000 + F.col("l_orderkey") % self.n_users).alias("hadm_id"),
            (F.col("l_partkey") % CODE_COUNT).alias("number"),
        ).distinct()
        return coded.select("hadm_id", (F.col("number") + 1).cast("int").alias("seq_num"), code(F.col("number")).alias("icd9_code"))

    @cached_property
    def d_icd_diagnoses(self) -> DataFrame:
        return scan(self.spark, self.folder, "part", "p_partkey").select(
            (F.col("p_partkey") % CODE_COUNT).alias("number")
        ).distinct().select(
            code(F.col("number")).alias("icd9_code"),
            F.concat(F.lit("Dx "), F.floor(F.col("number") / 2).cast("string")).alias("short_title"),
            F.concat(F.lit("Diagnosis number "), F.col("number").cast("string")).alias("long_title"),
        )

    @cached_property
    def caregivers(self) -> DataFrame:
        return scan(self.spark, self.folder, "supplier", "s_suppkey").select(
            F.col("s_suppkey").alias("cgid"), pick(["Doctor", "Nurse", "Other"], F.col("s_suppkey") % 3).alias("class"),
        )

    @cached_property
    def noteevents(self) -> DataFrame:
        d = F.col("doc_id")
        number = d.cast("string")
        return scan(self.spark, self.folder, "documents", "doc_id", "text", "lang").select(
            d.alias("row_id"), (d % self.n_users).alias("subject_id"), (1000 + d % self.n_users).alias("hadm_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), (d % 5).cast("int")).alias("chartdate"),
            F.when(d % 2 == 0, "Echo").otherwise("Nursing").alias("category"),
            F.concat(
                F.lit("Indication: "), F.col("lang"),
                F.lit("\nHeight: (in) "), F.when(d % 7 == 0, "[** Numeric **]").otherwise((55 + d % 20).cast("string")),
                F.lit("\nWeight (lb): "), F.when(d % 5 == 0, "[** Numeric **]").otherwise((90 + d % 150).cast("string")),
                F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("\nBSA (m2): 1."), (10 + d % 80).cast("string"), F.lit(" m2"))),
                F.lit("\nBP (mm Hg): "), (90 + d % 60).cast("string"), F.lit("/"), (50 + d % 40).cast("string"),
                F.lit("\nHR (bpm): "), (50 + d % 70).cast("string"),
                F.when(d % 4 == 0, "\nStatus: Inpatient").otherwise("\nStatus: Outpatient"),
                F.lit("\nDate/Time: [**2024-1-"), (d % 28).cast("string"), F.lit("**] at "),
                F.lpad((d % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((d % 60).cast("string"), 2, "0"),
                F.lit("\nTest: TTE"), number, F.lit("\nDoppler: Full Doppler\nContrast: None\nTechnical Quality: "),
                F.when(d % 6 == 0, "Suboptimal").otherwise("Adequate"), F.lit("\n\n"), F.col("text"),
            ).alias("text"),
        )

    @cached_property
    def run_agent(self) -> DataFrame:
        v = F.col("icustay_id")
        e = F.col("event_id")
        k = F.col("k")
        step = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
        units = {"signup": "CSRU", "view": "MICU", "click": "SICU", "purchase": "TSICU"}
        unit = F
        for name, label in units.items():
            unit = unit.when(F.col("event_type") == name, label)
        return self.timed.select(
            (e % 4).cast("int").alias("run_number"), step.alias("step"), v.alias("agent_id"),
            F.when((F.col("event_type") == "error") & (k < 10), 1).otherwise(0).alias("out_flag"),
            F.col("day").alias("days_in_hospital"),
            unit.otherwise("Other").alias("careunit"),
            (F.col("value") / 500).alias("cum_caretime_doctors"), (F.col("value") / 5).alias("cum_caretime_nurses"),
        )

    @cached_property
    def run_model(self) -> DataFrame:
        r = F.col("run_number")
        return self.run_agent.groupBy("run_number", "step").agg(
            F.count(F.lit(1)).alias("seen"), F.sum(F.when(F.col("careunit") != "Other", 1).otherwise(0)).alias("served")
        ).select(
            "run_number", "step",
            F.when(r % 2 == 0, 1 + 2 * r).otherwise(200 + 100 * r).alias("n_doctors"),
            F.when(r % 2 == 0, 200 + 100 * r).otherwise(1 + 2 * r).alias("n_nurses"),
            (80 + 20 * (r % 3)).alias("max_agents"),
            (F.col("served") / F.col("seen")).alias("demand_serviced"),
        )

    @cached_property
    def n_users(self):
        """Number of users as a scalar subquery; ids are dense from zero."""
        return self.events.agg(F.max("user_id") + 1).scalar()


def clinical_views(
    spark: SparkSession, folder: str, hold: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> ClinicalViews:
    """Views over the tables in ``folder``.

    ``hold`` is applied to the two views all others start from; pass
    :func:`icuflow.sources.tables.stage` where a plan reads them many times.
    """
    return ClinicalViews(spark, folder, hold)
