import random

import pytest
from pyspark.sql import functions as F

from icuflow.operators import metrics, prepare, sampling


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_pr(rows):
    total, area, r0, p0 = sum(y for y, _ in rows), 0.0, 0.0, 1.0
    for t in sorted({s for _, s in rows}, reverse=True):
        called = [y for y, s in rows if s >= t]
        r, p = sum(called) / total, sum(called) / len(called)
        area, r0, p0 = area + (r - r0) * (p + p0) / 2, r, p
    return area


def tables():
    rng = random.Random(5)
    mixed = [(int(rng.random() < 0.4), rng.randrange(20) / 20) for _ in range(200)]
    return {"mixed": mixed, "tied": [(i % 2, 0.5) for i in range(10)], "perfect": [(0, 0.1)] * 4 + [(1, 0.9)] * 3}


@pytest.mark.parametrize("name", ["mixed", "tied", "perfect"])
def test_areas(spark, name):
    rows = tables()[name]
    df = spark.createDataFrame(rows, "y int, s double")
    assert abs(metrics.roc_auc(metrics.threshold_counts(df, "y", "s")).first()[0] - brute_auc(rows)) < 1e-12
    assert abs(metrics.pr_auc(metrics.threshold_counts(df, "y", "s"), "s").first()[0] - brute_pr(rows)) < 1e-12


def test_no_positives(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.4)], "y int, s double")
    assert metrics.roc_auc(metrics.threshold_counts(df, "y", "s")).first()[0] is None
    row = metrics.confusion(df, F.col("y"), F.lit(0)).first()
    assert row["tn"] == 2 and row["recall"] == 0.0 and row["precision"] == 0.0
    assert metrics.f1_sweep(df, "y", "s", [0.0, 0.5]).agg(F.sum("f1")).first()[0] == 0.0


def test_first_best_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.9), (0, 0.1)], "y int, s double")
    best = metrics.f1_sweep(df, "y", "s", [0.0, 0.2, 0.4]).filter("best = 1").collect()
    assert len(best) == 1 and best[0]["threshold"] == 0.2 and best[0]["f1"] == 1.0


def test_undersample_takes_the_smallest_class_size(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(F.when(F.col("id") % 3 == 0, 2).otherwise(0)).alias("y"))
    got = {r["y"]: r["count"] for r in prepare.undersample(df, "y", "id").groupBy("y").count().collect()}
    assert got == {0: 100, 1: 100, 2: 100}


def test_scaling_uses_the_population_deviation(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = prepare.scale(train, ["a", "b"], train)[0].orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_inverse_cdf_edges(spark):
    seen = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "v string").withColumn("band", F.lit(1))
    draws = spark.createDataFrame([(1, 0.0), (2, 0.49), (3, 0.5), (4, 0.75), (5, 0.9999)], "id int, u double").withColumn("band", F.lit(1))
    got = {r["id"]: r["v"] for r in sampling.draw_categories(draws, seen, ["band"], "u", "v").collect()}
    assert got == {1: "a", 2: "a", 3: "b", 4: "c", 5: "c"}
    numbers = spark.createDataFrame([(10,), (10,), (30,), (40,)], "v int")
    got = {r["id"]: r["v"] for r in sampling.draw_numbers(draws.drop("band"), numbers, "u", "v").collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 30, 5: 40}


def test_donor_rules(spark):
    donors = spark.createDataFrame([("a", i, float(i)) for i in range(12)] + [("b", 100, 4.0), ("b", 101, 8.0)], "g string, d long, v double")
    draws = spark.createDataFrame([(i, "a", i / 50) for i in range(50)] + [(60, "b", 0.3), (61, "c", 0.3)], "id int, g string, u double")
    got = {r["id"]: r for r in sampling.matched_donor(draws, donors, ["g"], "u", "id", "d", ["v"]).collect()}
    assert len(got) == 52 and {got[i]["d"] for i in range(50)} == set(range(12)) and all(got[i]["v"] == got[i]["d"] for i in range(50))
    assert (got[60]["matched"], got[60]["v"], got[60]["d"]) == ("mean", 6.0, None)
    assert (got[61]["matched"], got[61]["v"]) == ("none", None)
