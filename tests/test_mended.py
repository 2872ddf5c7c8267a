"""Draws, look-backs, axes, logs and folders in the cases that once went wrong."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from icuflow.functions.values import hashed_uniform
from icuflow.learn.evaluate import with_folds
from icuflow.operators import prepare
from icuflow.operators.generate import densify
from icuflow.operators.joins import asof_lookback
from icuflow.operators.sampling import draw_categories, draw_numbers, widened_std, with_noise
from icuflow.operators.tables import binary_encode, category_codes
from icuflow.session import scratch_root
from icuflow.sources.tables import load_run_logs, write_csv

T0 = datetime(2024, 1, 1)


def test_split_balance_and_folds_are_independent(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    train = rows.filter(prepare.split_name("id") == "train")
    assert 14_500 < train.count() < 15_500
    balanced = with_folds(prepare.undersample(train, "y", "id"), "id")
    counts = {(r.fold, r.y): r["count"] for r in balanced.groupBy("fold", "y").count().collect()}
    mean = sum(counts.values()) / 10
    assert len(counts) == 10 and all(abs(n - mean) < 5 * math.sqrt(mean) for n in counts.values())
    text = spark.createDataFrame([("a|1",), (None,)], "k string").select(hashed_uniform(F.col("k"), "x").alias("u")).collect()
    assert 0 <= text[0].u < 1 and text[1].u is None


@pytest.mark.parametrize("strategy", ["window", "join"])
def test_look_back_to_the_microsecond_without_null_keys_on_a_hot_key(spark, strategy):
    ntz = lambda df: df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    probes = [(1, T0 + timedelta(hours=2, microseconds=800_000)), (2, T0 + timedelta(hours=2)), (None, T0)]
    measures = [(1, T0, 5.0), (2, T0, 6.0), (None, T0, 7.0), (9, None, 8.0)]
    hot = [(3, T0 + timedelta(minutes=7 * i, microseconds=i)) for i in range(300)]
    given = [(3, T0 + timedelta(minutes=11 * i), float(i)) for i in range(0, 200, 3)]
    got = asof_lookback(
        ntz(spark.createDataFrame(probes + hot, "k int, t timestamp")), ntz(spark.createDataFrame(measures + given, "k int, t timestamp, v double")),
        ["k"], "t", ["v"], 7200, strategy=strategy,
    ).collect()
    assert len(got) == 303
    want = {(1, probes[0][1]): None, (2, probes[1][1]): 6.0, (None, T0): None}
    for _, t in hot:
        near = [(s, v) for _, s, v in given if s <= t and t - s <= timedelta(hours=2)]
        want[3, t] = max(near)[1] if near else None
    assert {(r.k, r.t): r.v for r in got} == want


def test_densify_keeps_days_past_the_bound(spark):
    days = spark.createDataFrame([(1, 0, 4), (1, 9, 5)], "s int, day int, n int")
    got = {r.day: r.n for r in densify(days, days.select("s").distinct(), "s", "day", 2, ["n"]).collect()}
    assert got == {0: 4, 1: 0, 2: 0, 9: 5}


def test_run_logs_by_path(spark, tmp_path):
    paths = []
    for i in [*range(12), 12]:
        path = str(tmp_path / (f"run_{i}" if i < 12 else "with blank"))
        paths.append(write_csv(spark.createDataFrame([(0, i)], "run_number int, v int"), path))
    got = {r.v: r.run_number for r in load_run_logs(spark, paths, "run_number int, v int").collect()}
    assert got == {i: 9 * i for i in range(13)}


def test_staging_folder():
    assert scratch_root("spark://x", "hdfs://a/b/", "file:/w") == "hdfs://a/b"
    assert scratch_root("local[4]", None, "file:/w") == "file:/w/_staged" and scratch_root("yarn", None, "s3a://w/") == "s3a://w/_staged"
    for warehouse in ("file:/w", "/w"):
        with pytest.raises(ValueError):
            scratch_root("spark://x", None, warehouse)


def test_deviation_of_large_constant_measures(spark):
    donors = spark.createDataFrame([("a", 30, 1e9 + 0.1), ("a", 50, 1e9 + 0.1), ("a", 50, 1e9 + 0.1)], "k string, age int, x double")
    band = lambda age: F.floor(age / 20)
    got = widened_std(donors, donors, ["k"], "age", band, "x").collect()
    assert all(r.std is not None and abs(r.std) < 1e-6 for r in got)


def test_encoder_of_many_categories(spark):
    df = spark.range(3000).select(F.format_string("v%05d", "id").alias("c")).union(spark.createDataFrame([(None,)], "c string"))
    got = binary_encode(df, category_codes(df, "c"), "c", "b").where("c = 'v02047' or c is null").collect()
    bits = {r.c: int("".join(str(r[f"b_{i}"]) for i in range(12)), 2) for r in got}
    assert bits == {"v02047": 2048, None: 0}


def test_draws_of_a_continuous_measure(spark):
    observed = spark.range(700).select(((F.col("id") * 37) % 613 + F.col("id") / 1000).alias("v"))
    draws = spark.range(400).select("id", F.when(F.col("id") < 398, ((F.col("id") * 17) % 400) / 400).alias("u"), F.when(F.col("id") % 50 != 7, 1).alias("k"))
    values = sorted(r.v for r in observed.collect())
    got = {r.id: r.v for r in draw_numbers(draws, observed, "u", "v").collect()}
    assert got == {i: values[max(-(-(i * 17 % 400) * 7 // 4) - 1, 0)] for i in range(398)}
    named = observed.select("v", F.lit(1).alias("k"))
    got = {r.id: r.v for r in draw_categories(draws, named, ["k"], "u", "v").collect()}
    assert got == {i: values[(i * 17 % 400) * 7 // 4] for i in range(398) if i % 50 != 7}


@pytest.mark.parametrize("rows", [1_000_000, 3])
def test_undersampling_takes_the_lowest_hashes(spark, rows):
    df = spark.range(900).select("id", F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("id") % 2).cast("int").alias("y"))
    lowest = {}
    for r in df.withColumn("u", hashed_uniform(F.col("id"), "balance")).collect():
        lowest.setdefault(r.y, []).append((r.u, r.id))
    want = {i for found in lowest.values() for _, i in sorted(found)[:100]}
    assert len(lowest) == 3 and {r.id for r in prepare.undersample(df, "y", "id", rows).collect()} == want


def test_noise_for_small_cohorts_only(spark):
    drawn = spark.range(3000).select(
        "id", (F.col("id") % 3).alias("k"), F.lit(5.0).alias("v"), F.when(F.col("id") % 3 == 0, "donor").otherwise("mean").alias("matched"))
    spread = spark.createDataFrame([(0, 9.0), (1, 2.0), (2, None)], "k long, std double")
    rows = with_noise(drawn, spread, ["k"], "id", "v").collect()
    assert len(rows) == 3000 and all(r.v == 5.0 for r in rows if r.k != 1)
    noisy = [r.v for r in rows if r.k == 1]
    mean = sum(noisy) / 1000
    assert abs(mean - 5) < 0.25 and abs(math.sqrt(sum((x - mean) ** 2 for x in noisy) / 999) - 2) < 0.2
