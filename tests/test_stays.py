"""Ventilation spells, coma scale, stay-days."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from icuflow.operators.generate import daily_snapshots, densify, repeat_days
from icuflow.plans import features

T0 = datetime(2024, 1, 1, 20)


def at(h, m=0):
    return T0 + timedelta(hours=h, minutes=m)


def settings(spark, rows):
    return spark.createDataFrame(rows, "icustay_id long, charttime timestamp, mechvent int, oxygentherapy int, extubated int, selfextubated int"
                                 ).withColumn("charttime", F.col("charttime").cast("timestamp_ntz"))


def spells(spark, rows, chunk=86400):
    got = features.vent_spells(settings(spark, rows), chunk).orderBy("charttime", "extubated").collect()
    return [r["spell"] for r in got]


def test_gap_of_nine_hours_opens_a_spell(spark):
    for chunk in (3600, 86400):
        assert spells(spark, [(1, at(0), 1, 0, 0, 0), (1, at(8, 59), 1, 0, 0, 0)], chunk) == [0, 0]
        assert spells(spark, [(1, at(0), 1, 0, 0, 0), (1, at(9), 1, 0, 0, 0)], chunk) == [0, 1]


def test_extubation_and_oxygen(spark):
    rows = [(1, at(0), 1, 0, 0, 0), (1, at(1), 0, 0, 1, 0), (1, at(2), 1, 0, 0, 0), (1, at(3), 0, 1, 0, 0), (1, at(4), 1, 0, 0, 0)]
    assert spells(spark, rows) == [0, 0, 1, None, 2]


def test_equal_times_share_a_spell(spark):
    rows = [(1, at(0), 1, 0, 0, 0), (1, at(10), 1, 0, 0, 0), (1, at(10), 0, 0, 1, 0), (1, at(11), 1, 0, 0, 0)]
    assert spells(spark, rows) == [0, 1, 1, 2]


def test_durations(spark):
    rows = [(1, at(0), 1, 0, 0, 0), (1, at(2), 1, 0, 0, 0), (1, at(20), 1, 0, 0, 0), (1, at(21), 1, 0, 0, 0), (2, at(0), 1, 0, 0, 0),
            (3, at(0), 0, 0, 1, 0), (3, at(1), 0, 0, 1, 0)]
    got = [(r["icustay_id"], r["ventnum"], r["duration_hours"]) for r in
           features.vent_durations({}, settings(spark, rows)).orderBy("icustay_id", "ventnum").collect()]
    assert got == [(1, 1, 2.0), (1, 2, 1.0)]
    whole = features.vent_durations({}, settings(spark, rows), per_stay=True).collect()
    assert [(r["icustay_id"], r["duration_hours"]) for r in whole] == [(1, 21.0)]


def test_coma_scale(spark):
    chart = spark.createDataFrame([
        (1, 454, at(0), "x", 5.0, 0), (1, 723, at(0), "x", 4.0, None), (1, 184, at(0), "x", 3.0, 0),   # 12
        (1, 454, at(1), "x", 2.0, 0),                                                                    # 2 + 4 + 3 = 9
        (2, 723, at(0), "1.0 ET/Trach", 1.0, 0), (2, 454, at(0), "x", 1.0, 0),                           # intubated: 15
        (2, 454, at(1), "x", 3.0, 0),                                                                    # verbal missing after 0: 15
        (2, 723, at(2), "x", 2.0, 0),                                                                    # previous verbal missing: 3 + 2 + 4 = 9
        (3, 454, at(0), "x", 1.0, 1), (3, 184, at(0), "x", None, 0),                                     # error row out, all normal: 15
        (4, 454, at(60), "x", 1.0, 0),                                                                   # outside the window
    ], "icustay_id long, itemid int, charttime timestamp, value string, valuenum double, error int").withColumn(
        "charttime", F.col("charttime").cast("timestamp_ntz"))
    stays = spark.createDataFrame([(i, T0) for i in range(1, 5)], "icustay_id long, intime timestamp").withColumn(
        "intime", F.col("intime").cast("timestamp_ntz"))
    got = {r["icustay_id"]: (r["mingcs"], r["endotrachflag"]) for r in
           features.gcs_first_day({"chartevents": chart, "icustays": stays}).collect()}
    assert got == {1: (9.0, 0), 2: (9.0, 0), 3: (15.0, 0)}


def test_snapshots_have_one_flag_per_stay(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "2024-01-03", 1), (2, "2024-01-01", "2024-01-01", 0), (3, "2024-01-05", "2024-01-01", 0)],
                               "s int, a string, b string, d int")
    got = daily_snapshots(df, "s", "a", "b", F.col("d") == 1).orderBy("s", "date").collect()
    assert [(r["s"], r["day_of_stay"], r["out_flag"]) for r in got] == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, -1)]


def test_repeat_and_densify(spark):
    df = spark.createDataFrame([(1, 2, 4), (2, 3, 3), (3, 5, 4), (4, None, 2)], "s int, a int, b int")
    days = repeat_days(df, "a", "b", "day")
    assert sorted((r["s"], r["day"]) for r in days.collect()) == [(1, 2), (1, 3), (1, 4), (2, 3)]
    full = densify(days.withColumn("n", F.lit(1)), df.select("s"), "s", "day", 5, ["n"])
    assert full.count() == 24 and full.agg(F.sum("n")).first()[0] == 4
