"""Cut points of the graded parts, written out by hand."""

import pytest
from pyspark.sql import functions as F

from icuflow.functions import ladder
from icuflow.rules import scores as sc

CASES = [
    (sc.OASIS, "heartrate_score", {"heartrate_min": 60.0}, "heartrate_max",
     {88.9: 0, 89.0: 1, 106.0: 1, 106.5: 0, 107.0: 3, 125.0: 3, 125.1: 6, None: None}),
    (sc.OASIS, "heartrate_score", {"heartrate_max": 126.0}, "heartrate_min", {32.0: 6}),
    (sc.OASIS, "heartrate_score", {"heartrate_max": 100.0}, "heartrate_min", {32.9: 4, 33.0: 1}),
    (sc.OASIS, "preiculos_score", {}, "preiculos",
     {611: 5, 612: 3, 17819: 3, 17820: 0, 86399: 0, 86400: 1, 1122479: 1, 1122480: 2, None: None}),
    (sc.OASIS, "meanbp_score", {"meanbp_max": 100.0}, "meanbp_min", {20.64: 4, 20.65: 3, 50.9: 3, 51.0: 2, 61.33: 0}),
    (sc.OASIS, "age_score", {}, "age", {23: 0, 24: 3, 53: 3, 54: 6, 77: 6, 78: 9, 89: 9, 90: 7}),
    (sc.OASIS, "gcs_score", {}, "mingcs", {7: 10, 8: 4, 13: 4, 14: 3, 15: 0}),
    (sc.OASIS, "electivesurgery_score", {}, "electivesurgery", {1: 0, 0: 6, None: None}),
    (sc.SAPS, "hr_score", {"heartrate_min": 80.0}, "heartrate_max", {109.0: 0, 109.5: None, 110.0: 2, 139.9: 2, 140.0: 3, 180.0: 4}),
    (sc.SAPS, "gcs_score", {}, "mingcs", {2: None, 3: 4, 4: 3, 7: 2, 10: 1, 13: 0, 16: None}),
    (sc.SAPS, "vent_score", {"cpap": None}, "mechvent", {1: 3, 0: 0, None: None}),
    (sc.SAPS2, "temp_score", {"tempc_min": 38.0}, "tempc_max", {41.0: 0}),
    (sc.SAPS2, "temp_score", {"tempc_min": 39.0}, "tempc_max", {41.0: 3}),
    (sc.SAPS2, "bilirubin_score", {}, "bilirubin_max", {3.9: 0, 4.0: 4, 6.0: 9}),
    (sc.SAPS2, "comorbidity_score", {"hem": 1, "mets": 1}, "aids", {None: 10, 1: 17}),
    (sc.SOFA, "liver", {}, "bilirubin_max", {1.19: 0, 1.2: 1, 2.0: 2, 6.0: 3, 12.0: 4, None: None}),
    (sc.SOFA, "respiration", {"pao2fio2_vent_min": None}, "pao2fio2_novent_min", {68.0: 2, 299.0: 2, 300.0: 1, 400.0: 0, None: None}),
    (sc.SOFA, "cns", {}, "mingcs", {15: 0, 14: 1, 13: 1, 12: 2, 9: 3, 5: 4, None: None}),
    (sc.SOFA, "cardiovascular",
     {"rate_dopamine": None, "rate_dobutamine": None, "rate_norepinephrine": None, "meanbp_min": 80.0},
     "rate_epinephrine", {0.11: 4, 0.1: 3, None: 0}),
]


@pytest.mark.parametrize("table,part,fixed,column,expected", CASES, ids=[f"{c[1]}-{i}" for i, c in enumerate(CASES)])
def test_cut_points(spark, table, part, fixed, column, expected):
    kinds = {c: "string" if isinstance(v, str) else "double" for c, v in fixed.items()}
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(expected)]
    df = spark.createDataFrame(rows, f"id int, {column} double").select(
        "id", column, *[F.lit(v).cast(kinds[c]).alias(c) for c, v in fixed.items()])
    got = [r["p"] for r in df.select("id", ladder.points(table[part]).alias("p")).orderBy("id").collect()]
    assert got == list(expected.values())


def test_deciding_value_and_total(spark):
    df = spark.createDataFrame([(1, 60.0, 130.0), (2, 30.0, 100.0), (3, 60.0, 80.0), (4, None, None)],
                               "id int, heartrate_min double, heartrate_max double")
    got = df.select("id", ladder.deciding_value(sc.OASIS["heartrate_score"]).alias("v")).orderBy("id").collect()
    assert [r["v"] for r in got] == [130.0, 30.0, 70.0, None]
    parts = spark.createDataFrame([(1, None), (2, 3)], "a int, b int").select(ladder.total(["a", "b"]).alias("t"))
    assert [r["t"] for r in parts.collect()] == [1, 5]


def test_every_part_gives_only_listed_points(spark):
    """Random inputs: a part is null or one of its points, and the total is the sum of the parts."""
    columns = sorted({t[0] for g in sc.SAPS.values() for s in g.steps for t in s[1:]} | {c for g in sc.SAPS.values() for c in g.blank})
    df = spark.range(300).select(*[(F.rand(i) * 200).alias(c) for i, c in enumerate(columns)])
    out = df.select(*[ladder.points(g).alias(p) for p, g in sc.SAPS.items()]).withColumn("t", ladder.total(sc.SAPS))
    for row in out.collect():
        for part, grade in sc.SAPS.items():
            assert row[part] in {s[0] for s in grade.steps} | {grade.rest, None}
        assert row["t"] == sum(row[p] or 0 for p in sc.SAPS)
