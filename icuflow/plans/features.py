"""Feature tables per stay, stay-day or charted time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.functions.ladder import logistic
from icuflow.functions.values import flag, hours, plus, whole_hours, within_days
from icuflow.operators.concepts import concept_columns, lab_map, max_columns, to_concepts, vital_map
from icuflow.operators.joins import asof_lookback, join_stays
from icuflow.operators.ordered import CHUNK, Hold, keep, previous_values, running_totals, time_chunk
from icuflow.rules import items

STAY = ["subject_id", "hadm_id", "icustay_id"]
VITAL_STATS = ["min", "max", "mean"]
Inputs = dict[str, DataFrame]


def no_error(df: DataFrame) -> DataFrame:
    """Drops flagged rows and rows whose flag is unknown (``error <> 1``)."""
    return df.filter(F.col("error") != 1)


# ------------------------------------------------------------------------------ vital signs


def _vital_rows(v: Inputs) -> DataFrame:
    chart = no_error(v["chartevents"]).filter(F.col("itemid").isin(items.VITAL_CODES))
    return chart.select(*STAY, "itemid", "charttime", "valuenum")


def vitals_all(v: Inputs, days: int = 2) -> DataFrame:
    """Vital signs per stay-day of the admission day and the ``days`` after it."""
    rows = join_stays(
        _vital_rows(v), v["icustays"].select(*STAY, "intime"), STAY, ["charttime", "itemid"],
        within_days(F.col("charttime"), F.col("intime"), 0, days),
    ).withColumn("item_date", F.to_date("charttime"))
    daily = to_concepts(rows, vital_map(rows.sparkSession)).groupBy(*STAY, "item_date").agg(
        *concept_columns(list(items.VITALS), VITAL_STATS)
    )
    admitted = v["admissions"].select("hadm_id", F.to_date("admittime").alias("_admitted"))
    return daily.join(admitted, "hadm_id", "left").withColumn(
        "days_since_admission", F.date_diff("item_date", "_admitted")
    ).drop("_admitted", "item_date")


def vitals_first_day(v: Inputs, days: int | None = None) -> DataFrame:
    """24 vital-sign columns per stay.

    The reference sets no time bound although the table is called first-day; ``days`` adds one.
    """
    within = None if days is None else within_days(F.col("charttime"), F.col("intime"), 0, days)
    rows = join_stays(
        _vital_rows(v), v["icustays"].select(*STAY, "intime"), STAY, ["charttime", "itemid"], within
    )
    return to_concepts(rows, vital_map(rows.sparkSession)).groupBy(*STAY).agg(
        *concept_columns(list(items.VITALS), VITAL_STATS)
    )


# ----------------------------------------------------------------------------- laboratory


def _lab_window(v: Inputs, codes) -> DataFrame:
    labs = v["labevents"].filter(F.col("itemid").isin(codes)).select(
        "subject_id", "hadm_id", "itemid", "charttime", "value", "valuenum"
    )
    t, start = F.col("charttime"), F.col("intime")
    return join_stays(
        labs, v["icustays"].select(*STAY, "intime"), ["subject_id", "hadm_id"], ["charttime", "itemid"],
        (t >= plus(start, hours=-6)) & (t <= plus(start, days=1)),
    )


def labs_first_day(v: Inputs) -> DataFrame:
    """Smallest and largest value of 19 laboratory measures per stay; stays without labs are kept."""
    rows = _lab_window({**v, "labevents": v["labevents"].filter(F.col("valuenum") > 0)}, items.LAB_CODES)
    found = to_concepts(rows, lab_map(rows.sparkSession)).groupBy("icustay_id").agg(
        *concept_columns(list(items.LABS), ["min", "max"])
    )
    return v["icustays"].select(*STAY).join(found, "icustay_id", "left")


def bloodgas_first_day(v: Inputs) -> DataFrame:
    """Blood gas per stay and charted time; unnamed codes still open a row, stays without any keep one."""
    code, value = F.col("itemid"), F.col("valuenum")
    plausible = ~((value <= 0) & (code != items.GAS_NEGATIVE_ALLOWED))
    for c, (low, high) in items.GAS_LIMITS.items():
        if low is not None:
            plausible = plausible & ~((code == c) & (value < low))
        if high is not None:
            plausible = plausible & ~((code == c) & (value > high))
    rows = _lab_window(v, items.GAS_CODES).withColumn("num", F.when(plausible, value))
    found = rows.groupBy("icustay_id", "charttime").agg(
        F.max(F.when(code == items.GAS["specimen"], F.col("value"))).alias("specimen"),
        *[F.expr(f"max(CASE WHEN itemid = {c} THEN num END) AS {n}") for n, c in items.GAS.items() if n != "specimen"],
    )
    return v["icustays"].select(*STAY).join(found, "icustay_id", "left")


def specimen_probability() -> Column:
    """Chance that an unlabelled sample is arterial; each missing term is replaced by its mean."""
    x = F.lit(items.SPECIMEN_INTERCEPT) + items.SPECIMEN_PO2_WEIGHT * F.col("po2")
    for term, (weight, mean, adjust) in items.SPECIMEN_TERMS.items():
        x = x + F.coalesce(weight * F.col(term), F.lit(weight) * mean + adjust)
    return logistic(x)


def fio2_percent(code: Column, value: Column) -> Column:
    """Charted inspired oxygen as percent, null when it makes no sense."""
    mixed = F.when((value > 0) & (value <= 1), value * 100).when((value >= 21) & (value <= 100), value)
    return (
        F.when(code == items.FIO2_MIXED, mixed)
        .when(code.isin(*items.FIO2_PERCENT), value)
        .when((code == items.FIO2_FRACTION) & (value > 0.20) & (value < 1), value * 100)
    )


def bloodgas_arterial(v: Inputs, gas: DataFrame | None = None) -> DataFrame:
    """Arterial blood gas with the latest charted SpO2 (2 h) and FiO2 (4 h) before it.

    SpO2 staging keeps rows flagged as error, FiO2 staging drops them (as defined).
    """
    gas = bloodgas_first_day(v) if gas is None else gas
    value = F.col("valuenum")
    chart = v["chartevents"].select("icustay_id", "charttime", "itemid", "valuenum", "error")
    spo2 = chart.filter(F.col("itemid").isin(*items.SPO2_CODES)).groupBy("icustay_id", "charttime").agg(
        F.max(F.when((value > 0) & (value <= 100), value)).alias("spo2")
    )
    fio2_codes = [items.FIO2_MIXED, items.FIO2_FRACTION, *items.FIO2_PERCENT]
    fio2 = no_error(chart).filter(F.col("itemid").isin(fio2_codes)).groupBy("icustay_id", "charttime").agg(
        F.max(fio2_percent(F.col("itemid"), value)).alias("fio2_chartevents")
    )
    seen = asof_lookback(gas.filter(F.col("po2").isNotNull()), spo2, ["icustay_id"], "charttime", ["spo2"],
                         items.SPO2_LOOKBACK_HOURS * 3600)
    seen = asof_lookback(seen, fio2, ["icustay_id"], "charttime", ["fio2_chartevents"],
                         items.FIO2_LOOKBACK_HOURS * 3600)
    fraction = F.coalesce("fio2", "fio2_chartevents")
    graded = seen.withColumn("specimen_prob", specimen_probability()).filter(
        (F.col("specimen") == "ART") | (F.col("specimen_prob") > items.SPECIMEN_CUT)
    )
    return graded.select(
        *gas.columns, "spo2", "fio2_chartevents", "specimen_prob",
        F.when(F.col("specimen").isNotNull(), F.col("specimen"))
        .when(F.col("specimen_prob") > items.SPECIMEN_CUT, "ART").alias("specimen_pred"),
        ((fraction / 100) * (items.AIR_PRESSURE - items.WATER_PRESSURE)
         - F.col("pco2") / items.RESPIRATORY_QUOTIENT - F.col("po2")).alias("aado2_calc"),
        (100 * F.col("po2") / fraction).alias("pao2fio2"),
    )


# ----------------------------------------------------------------------- coma scale, urine


def gcs_first_day(v: Inputs) -> DataFrame:
    """Lowest coma scale of the first two calendar days, with the components behind it.

    A missing component takes the previous charted one, then the normal value; an intubated
    patient counts as 15; after intubation the previous components are not used. Rows whose error
    flag is unknown are kept here. At most one row per second of two days is ordered per stay.
    """
    names = {c: n for n, codes in items.GCS.items() for c in codes}
    code, value = F.col("itemid"), F.col("valuenum")
    intubated = F.lit(False)
    for c, text in items.GCS_INTUBATED.items():
        intubated = intubated | ((code == c) & (F.col("value") == text))
    chart = v["chartevents"].filter(code.isin(items.GCS_CODES) & ~F.col("error").eqNullSafe(1))
    rows = join_stays(
        chart.select("icustay_id", "itemid", "charttime", "value", "valuenum"),
        v["icustays"].select("icustay_id", "intime"), ["icustay_id"], ["charttime", "itemid"],
        within_days(F.col("charttime"), F.col("intime"), 0, 1),
    ).withColumn("num", F.when(F.coalesce(intubated, F.lit(False)), 0.0).otherwise(value))
    concept = F
    for c, n in names.items():
        concept = concept.when(code == c, n)
    charted = rows.withColumn("concept", concept).groupBy("icustay_id", "charttime").agg(
        *max_columns(list(items.GCS))
    )
    earlier = W.partitionBy("icustay_id").orderBy("charttime")
    charted = charted.select("*", *[F.lag(n).over(earlier).alias(f"{n}_prev") for n in items.GCS])
    return charted.select(
        "icustay_id", "charttime", *items.GCS, flag(F.col("gcsverbal") == 0).alias("endotrachflag"),
        coma_total().alias("gcs"),
    ).groupBy("icustay_id").agg(
        F.min_by(F.struct(*items.GCS, "endotrachflag"), F.struct("gcs", "charttime")).alias("at"),
        F.min("gcs").alias("mingcs"),
    ).select("icustay_id", "at.*", "mingcs")


def coma_total() -> Column:
    verbal, verbal_prev = F.col("gcsverbal"), F.col("gcsverbal_prev")
    normal = items.GCS_NORMAL
    now = sum((F.coalesce(F.col(n), F.lit(float(d))) for n, d in normal.items()), F.lit(0.0))
    carried = sum((F.coalesce(F.col(n), F.col(f"{n}_prev"), F.lit(float(d))) for n, d in normal.items()), F.lit(0.0))
    sedated = (verbal == 0) | (verbal.isNull() & (verbal_prev == 0))
    return F.when(sedated, float(items.GCS_SEDATED)).when(verbal_prev == 0, now).otherwise(carried)


def urine_output_first_day(v: Inputs) -> DataFrame:
    """Urine volume of the first two calendar days, irrigant counted as negative."""
    value = F.col("value")
    out = v["outputevents"].filter(F.col("itemid").isin(*items.URINE_CODES))
    rows = join_stays(
        out.select(*STAY, "itemid", "charttime", "value"), v["icustays"].select(*STAY, "intime"), STAY,
        ["charttime", "itemid"], within_days(F.col("charttime"), F.col("intime"), 0, 1),
    )
    return rows.groupBy(*STAY).agg(
        F.sum(F.when((F.col("itemid") == items.URINE_IRRIGANT) & (value > 0), -value).otherwise(value)).alias("urineoutput")
    )


# ---------------------------------------------------------------------------- ventilation


def vent_settings(v: Inputs) -> DataFrame:
    """Ventilation, oxygen and extubation flags per stay and charted time."""
    code, text = F.col("itemid"), F.col("value")
    vent = code.isin(*items.VENT_SETTING_CODES) | (code == items.VENT_MODE)
    for c, unless in items.VENT_TYPE_UNLESS.items():
        vent = vent | ((code == c) & (text != unless))
    vent = vent | ((code == items.O2_DEVICE_CV) & (text == items.O2_DEVICE_VENT_TEXT))
    oxygen = ((code == items.O2_DEVICE_MV) & text.isin(*items.OXYGEN_TEXT_MV)) | (
        (code == items.O2_DEVICE_CV) & text.isin(*items.OXYGEN_TEXT_CV)
    )
    out = (code == items.EXTUBATION_CODE) & text.isin(items.EXTUBATED_TEXT, items.SELF_EXTUBATED_TEXT)
    self_out = (code == items.EXTUBATION_CODE) & (text == items.SELF_EXTUBATED_TEXT)
    charted = no_error(v["chartevents"]).filter(code.isin(items.VENT_READ_CODES) & (text != "")).groupBy(
        "icustay_id", "charttime"
    ).agg(
        F.max(flag(vent)).alias("mechvent"), F.max(flag(oxygen)).alias("oxygentherapy"),
        F.max(flag(out)).alias("extubated"), F.max(flag(self_out)).alias("selfextubated"),
    )
    removed = v["procedureevents_mv"].filter(code.isin(*items.EXTUBATION_PROCEDURES)).select(
        "icustay_id", F.col("starttime").alias("charttime"), F.lit(0).alias("mechvent"),
        F.lit(0).alias("oxygentherapy"), F.lit(1).alias("extubated"),
        flag(code == items.SELF_EXTUBATION_PROCEDURE).alias("selfextubated"),
    )
    return charted.unionByName(removed)


def vent_spells(settings: DataFrame, chunk_seconds: int = 86400, hold: Hold = keep) -> DataFrame:
    """Ventilator rows with their spell number.

    A row opens a new spell after an extubation, when oxygen starts without ventilation, or when
    more than eight whole hours passed since the last ventilated row. Numbers are running sums of
    that flag; rows of one time share it.
    """
    order = ["charttime", "extubated", "selfextubated", "mechvent", "oxygentherapy"]
    vent, out = F.col("mechvent") == 1, F.col("extubated") == 1
    rows = settings.filter(F.col("icustay_id").isNotNull()).withColumn(CHUNK, time_chunk("charttime", chunk_seconds))
    rows = previous_values(rows, ["icustay_id"], order, CHUNK, {
        "lastvent": (F.col("charttime"), vent),
        "lastextubated": (F.col("extubated"), vent | out),
    })
    gap = whole_hours(F.col("charttime"), F.col("lastvent"))
    rows = rows.withColumn("newvent", flag(
        ((vent | out) & (F.col("lastextubated") == 1))
        | ((F.col("mechvent") == 0) & (F.col("oxygentherapy") == 1))
        | (vent & (gap > items.SPELL_GAP_HOURS))
    ))
    rows = hold(rows, "newvent")
    rows = running_totals(rows, ["icustay_id"], ["charttime"], CHUNK, {"spell": F.col("newvent")}, ties_together=True)
    return rows.withColumn("spell", F.when(vent | out, F.col("spell"))).drop(CHUNK, "lastvent", "lastextubated")


def vent_durations(
    v: Inputs, settings: DataFrame | None = None, per_stay: bool = False, hold: Hold = keep
) -> DataFrame:
    """Ventilation spells with start, end and hours; at least two times and one ventilated row.

    ``per_stay=True`` gives one row per stay, the form in which the reference groups. The chunked
    windows read their input twice; ``hold`` lets the caller stage it instead of computing it twice.
    """
    rows = vent_spells(hold(vent_settings(v), "settings") if settings is None else settings, hold=hold)
    keys = ["icustay_id"] if per_stay else ["icustay_id", "spell"]
    if not per_stay:
        rows = rows.filter(F.col("spell").isNotNull())
    spells = rows.groupBy(*keys).agg(
        F.min("charttime").alias("starttime"), F.max("charttime").alias("endtime"), F.max("mechvent").alias("_vent")
    ).filter((F.col("starttime") != F.col("endtime")) & (F.col("_vent") == 1))
    number = F.row_number().over(W.partitionBy("icustay_id").orderBy("starttime"))
    return spells.select(
        "icustay_id", number.alias("ventnum"), "starttime", "endtime",
        hours(F.col("endtime"), F.col("starttime")).alias("duration_hours"),
    )


def vent_first_day(v: Inputs, durations: DataFrame) -> DataFrame:
    """1 for stays with a ventilation spell that overlaps the first 24 hours, else 0."""
    stays = v["icustays"].select("icustay_id", "intime")
    hit = stays.join(durations.select("icustay_id", "starttime", "endtime"), "icustay_id").filter(
        (F.col("starttime") <= plus(F.col("intime"), days=1)) & (F.col("endtime") >= F.col("intime"))
    ).select("icustay_id").distinct()
    return stays.select("icustay_id").join(hit.withColumn("_hit", F.lit(1)), "icustay_id", "left").select(
        "icustay_id", F.coalesce("_hit", F.lit(0)).alias("mechvent")
    )


