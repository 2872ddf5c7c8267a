import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from icuflow.operators.joins import asof_lookback, interval_join, join_stays

T0 = datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def test_stay_join_is_exact_with_a_hot_stay(spark):
    rng = random.Random(1)
    events = [(0 if i % 3 == 0 else rng.randrange(50), i) for i in range(3000)]
    stays = [(s, s * 10) for s in range(0, 40)]
    e = spark.createDataFrame(events, "stay long, id long")
    s = spark.createDataFrame(stays, "stay long, v long")
    expected = sorted((s_, i, s_ * 10) for s_, i in events if s_ < 40)
    assert sorted(map(tuple, join_stays(e, s, ["stay"], ["id"]).select("stay", "id", "v").collect())) == expected
    left = join_stays(e, s, ["stay"], ["id"], how="left")
    assert left.count() == 3000 and left.filter(F.col("v").isNull()).count() == sum(1 for s_, _ in events if s_ >= 40)


def test_stay_join_spreads_the_hot_stay(spark):
    e = spark.range(4000).select(F.lit(7).alias("stay"), F.col("id"))
    s = spark.createDataFrame([(7, 1)], "stay int, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = join_stays(e, s, ["stay"], ["id"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2500


def test_interval_ends_are_closed_and_overlaps_repeat(spark):
    points = ntz(spark.createDataFrame([(1, at(0)), (1, at(100)), (1, at(101)), (1, at(-1)), (2, at(50)), (1, at(60))],
                                       "k int, t timestamp"), "t")
    spells = ntz(spark.createDataFrame([(1, at(0), at(100), "a"), (1, at(50), at(70), "b"), (1, at(500), at(400), "never")],
                                       "k int, s timestamp, e timestamp, n string"), "s", "e")
    got = interval_join(points, spells, ["k"], "t", "s", "e", bucket_seconds=30)
    assert got.count() == 7
    assert sorted((r["k"], (r["t"] - T0).total_seconds(), r["n"] or "") for r in got.collect()) == [
        (1, -1.0, ""), (1, 0.0, "a"), (1, 60.0, "a"), (1, 60.0, "b"), (1, 100.0, "a"), (1, 101.0, ""), (2, 50.0, "")]


@pytest.mark.parametrize("strategy", ["window", "join"])
def test_asof_edges(spark, strategy):
    probes = ntz(spark.createDataFrame([(1, at(7200)), (2, at(7201)), (3, at(100)), (4, at(50)), (5, at(10))], "k int, t timestamp"), "t")
    measures = ntz(spark.createDataFrame(
        [(1, at(0), 1.0), (2, at(0), 2.0), (3, at(90), 3.0), (3, at(95), 4.0), (4, at(50), 5.0), (5, at(11), 6.0)],
        "k int, t timestamp, v double"), "t")
    got = asof_lookback(probes, measures, ["k"], "t", ["v"], 7200, strategy=strategy)
    assert {r["k"]: r["v"] for r in got.collect()} == {1: 1.0, 2: None, 3: 4.0, 4: 5.0, 5: None}


def test_asof_strategies_agree_with_brute_force(spark):
    rng = random.Random(7)
    probes = sorted({(0 if rng.random() < .4 else rng.randrange(5), rng.randrange(40000)) for _ in range(400)})
    measures = sorted({(0 if rng.random() < .4 else rng.randrange(5), rng.randrange(40000)) for _ in range(300)})
    p = ntz(spark.createDataFrame([(k, at(s)) for k, s in probes], "k int, t timestamp"), "t")
    m = ntz(spark.createDataFrame([(k, at(s), float(i)) for i, (k, s) in enumerate(measures)], "k int, t timestamp, v double"), "t")
    expected = []
    for k, s in probes:
        fit = [(ms, i) for i, (mk, ms) in enumerate(measures) if mk == k and s - 3600 <= ms <= s]
        expected.append((k, s, float(max(fit)[1]) if fit else None))
    for strategy in ("window", "join"):
        got = asof_lookback(p, m, ["k"], "t", ["v"], 3600, strategy=strategy).collect()
        assert sorted((r["k"], int((r["t"] - T0).total_seconds()), r["v"]) for r in got) == sorted(expected)


def test_long_spells_cost_two_rows_and_all_lengths_join(spark):
    rng = random.Random(5)
    spells = [(rng.randrange(3), s, s + rng.choice([0, 1, 29, 30, 31, 1000, 40_000, 3_155_760_000])) for s in (rng.randrange(-50_000, 50_000) for _ in range(80))]
    points = [(rng.choice([0, 1, 2, None]), rng.choice([rng.randrange(-60_000, 60_000), spells[i % 80][1], spells[i % 80][2], None])) for i in range(200)] * 2
    when = lambda x: None if x is None else at(x)
    p = ntz(spark.createDataFrame([(k, when(t), i) for i, (k, t) in enumerate(points)], "k int, t timestamp, i int"), "t")
    s = ntz(spark.createDataFrame([(k, at(a), at(b), n) for n, (k, a, b) in enumerate(spells)], "k int, s timestamp, e timestamp, n int"), "s", "e")
    want = []
    for i, (k, t) in enumerate(points):
        hits = [n for n, (j, a, b) in enumerate(spells) if k is not None and t is not None and j == k and a <= t <= b]
        want += [(i, n) for n in hits] or [(i, -1)]
    got = interval_join(p, s, ["k"], "t", "s", "e", bucket_seconds=30)
    assert sorted((r.i, -1 if r.n is None else r.n) for r in got.collect()) == sorted(want)
    inner = interval_join(p, s, ["k"], "t", "s", "e", bucket_seconds=30, how="inner")
    assert sorted((r.i, r.n) for r in inner.collect()) == sorted(w for w in want if w[1] >= 0) and inner.columns == got.columns
    assert interval_join(p, s.where("n = 999"), ["k"], "t", "s", "e").count() == len(points)
    century = s.where(F.col("e") > F.col("s") + F.expr("INTERVAL 100 DAYS"))
    text = interval_join(p, century, ["k"], "t", "s", "e")._jdf.queryExecution().toString()
    assert "Generate explode(sequence" in text


def test_salted_stays_are_never_broadcast(spark, tmp_path):
    """Spark's estimate leaves out the sixteen copies, so stays below its threshold are joined once each, and salted ones are shuffled."""
    spark.range(4000).selectExpr("id % 1000 as stay", "id").write.parquet(f"{tmp_path}/events")
    spark.range(1000).selectExpr("id as stay", "id * 7 as v").write.parquet(f"{tmp_path}/stays")
    e, s = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("events", "stays"))
    seen = {}
    for limit in ("1m", "1k"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            joined = join_stays(e, s, ["stay"], ["id"])
            plan = joined._jdf.queryExecution().executedPlan().toString()
            seen[limit] = ("BroadcastExchange" in plan, "Generate" in plan, sorted(map(tuple, joined.collect())), joined.columns)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen["1m"][:2] == (True, False) and seen["1k"][:2] == (False, True)
    assert seen["1m"][2:] == seen["1k"][2:] and len(seen["1m"][2]) == 4000
