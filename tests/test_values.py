from pyspark.sql import functions as F

from icuflow.functions import values as val
from icuflow.operators.concepts import lab_map, to_concepts, vital_map
from icuflow.rules import diagnoses as dx


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_plausible_ranges_and_units(spark):
    rows = [(211, 0.0), (211, 0.1), (211, 299.9), (211, 300.0), (646, 100.0), (646, 100.1), (223761, 70.0), (223761, 70.1),
            (678, 120.0), (223762, 37.0), (807, 5000.0), (999, 1.0), (211, None)]
    df = spark.createDataFrame(rows, "itemid int, valuenum double")
    got = {(r["itemid"], r["valuenum"]): r["num"] for r in to_concepts(df, vital_map(spark)).collect()}
    assert (999, 1.0) not in got and got[211, None] is None
    assert got[211, 0.0] is None and got[211, 0.1] == 0.1 and got[211, 299.9] == 299.9 and got[211, 300.0] is None
    assert got[646, 100.0] == 100.0 and got[646, 100.1] is None
    assert got[223761, 70.0] is None and got[223761, 70.1] == (70.1 - 32) / 1.8 and got[678, 120.0] is None
    assert got[223762, 37.0] == 37.0 and got[807, 5000.0] == 5000.0


def test_lab_limits_are_closed(spark):
    df = spark.createDataFrame([(50862, 10.0), (50862, 10.1)], "itemid int, valuenum double")
    assert sorted([r["num"] for r in to_concepts(df, lab_map(spark)).collect()], key=str) == [10.0, None]


def test_code_ranges_keep_blanks(spark):
    codes = ["042  ", "042", "0449 ", "0450 ", "20238", "20239", "20302"]
    inside = column(spark, codes, "string", lambda c: val.in_code_ranges(c, dx.AIDS_RANGES))
    assert inside == [True, False, True, False, False, False, False]
    hem = column(spark, codes, "string", lambda c: val.in_code_ranges(c, dx.HEM_RANGES))
    assert hem == [False, False, False, False, True, False, True]


def test_prefix_number_and_chapter(spark):
    codes = ["038", "V30", "E88", "0010", "1390", "1400", "9990", None, "7"]
    assert column(spark, codes, "string", val.code_prefix_number) == [38, None, None, 1, 139, 140, 999, None, 7]
    chapters = column(spark, codes, "string", lambda c: val.chapter(val.code_prefix_number(c)))
    assert chapters[0] == "Infectious And Parasitic Diseases"
    assert chapters[1:8] == ["Other"] * 7


def test_years_and_bands(spark):
    df = spark.createDataFrame([("2000-12-31", "2001-01-01"), ("1910-06-01", "2001-01-01")], "a string, b string")
    got = df.select(val.years_by_boundary(F.to_date("b"), F.to_date("a")).alias("y")).collect()
    assert [r["y"] for r in got] == [1, 91]
    ages = [0, 1, 2, 14, 15, 39, 40, 64, 65, 89, 90, None]
    assert column(spark, ages, "int", lambda c: val.banded(c, dx.AGE_BANDS, dx.AGE_BAND_ABOVE)) == [
        "neonate", "neonate", "1-14", "1-14", "15-39", "15-39", "40-64", "40-64", "65-89", "65-89", ">89", None]


def test_captured_numbers(spark):
    texts = ["Height: (in) 70\n", "Height: (in) [** Numeric **]\n", "none\n", "Height: (in) abc\n", "x" * 100000 + "Height: (in) 61\n"]
    expr = lambda c: val.masked_number(val.capture(c, r"Height: \(in\) (.*?)\n"))
    assert column(spark, texts, "string", expr) == [70.0, None, None, None, 61.0]


def test_class_rules(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.1, 0.2, 0.7), (0.0, 0.05, 0.95), (0.2, 0.4, 0.4)], "a double, b double, c double")
    p = [F.col(c) for c in "abc"]
    got = df.select(val.argmax_class(p).alias("m"), val.cautious_class(p).alias("k")).collect()
    assert [(r["m"], r["k"]) for r in got] == [(0, 0), (2, 1), (2, 2), (1, 1)]
    w = df.select(*val.reweight_classes(p, [1 / 3] * 3, [1 / 3] * 3)).first()
    assert abs(sum(w) - 1) < 1e-12 and abs(w[0] - 0.4) < 1e-12
    assert abs(df.select(val.reweight(F.lit(0.5), 0.1, 0.5)).first()[0] - 0.1) < 1e-12


def test_unknown_categories_are_all_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("z",)], "x string")
    got = df.select(*val.one_hot(F.col("x"), ["b", "a", "c"], "x_")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 0), (0, 0), (0, 0)]
