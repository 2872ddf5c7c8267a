import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from icuflow.operators import ordered, tables


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds a third of all rows; several rows share a time."""
    rng = random.Random(3)
    data = [(0 if i % 3 == 0 else rng.randrange(1, 20), rng.randrange(500), i, rng.choice([None, 1.5, 2.5, 4.0])) for i in range(1500)]
    df = spark.createDataFrame(data, "k int, t int, id int, v double")
    pdf = pd.DataFrame(data, columns=["k", "t", "id", "v"]).sort_values(["k", "t", "id"]).reset_index(drop=True)
    return df, pdf


@pytest.mark.parametrize("width", [7, 100, 10000])
def test_previous_and_running_do_not_depend_on_chunks(rows, width):
    df, pdf = rows
    df = df.withColumn("_chunk", F.floor(F.col("t") / width))
    got = ordered.previous_values(df, ["k"], ["t", "id"], "_chunk", {
        "last_id": (F.col("id"), F.lit(True)), "last_high": (F.col("v"), F.col("v") > 2), "before": (F.col("v"), F.lit(True)),
    })
    got = ordered.running_totals(got, ["k"], ["t"], "_chunk", {"upto": F.lit(1)}, ties_together=True)
    got = ordered.number_rows(got, ["k"], ["t", "id"], "_chunk", "place").toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    groups = pdf.groupby("k")
    assert got["last_id"].fillna(-1).tolist() == groups["id"].shift().fillna(-1).tolist()
    assert got["before"].fillna(-1).tolist() == groups["v"].shift().fillna(-1).tolist()
    high = pdf["v"].where(pdf["v"] > 2).groupby(pdf["k"]).ffill().groupby(pdf["k"]).shift()
    assert got["last_high"].fillna(-1).tolist() == high.fillna(-1).tolist()
    assert got["place"].tolist() == (groups.cumcount() + 1).tolist()
    assert got["upto"].tolist() == groups["t"].rank(method="max").astype(int).tolist()


def test_first_and_last(rows):
    df, pdf = rows
    first = {r["k"]: r["id"] for r in ordered.first_per_key(df, ["k"], ["t", "id"]).collect()}
    last = {r["k"]: r["id"] for r in ordered.last_per_key(df, ["k"], ["t", "id"]).collect()}
    assert first == pdf.groupby("k")["id"].first().to_dict() and last == pdf.groupby("k")["id"].last().to_dict()


def test_ecdf_is_monotone_and_ends_at_one(rows):
    df, pdf = rows
    got = ordered.ecdf(df, "t", ["k"]).toPandas().sort_values(["k", "t"])
    for _, part in got.groupby("k"):
        assert part["ecdf"].is_monotonic_increasing and part["ecdf"].iloc[-1] == 1.0
    assert got["n"].sum() == len(pdf)
    expected = pdf.groupby("k")["t"].rank(method="max", pct=True)
    joined = pdf.assign(e=expected).drop_duplicates(["k", "t"]).merge(got, on=["k", "t"])
    assert ((joined["e"] - joined["ecdf"]).abs() < 1e-12).all()


def test_quantile_curve_writes_every_row(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(float(i),) for i in range(10)], "v double")
    got = ordered.quantile_curve(df, "v", block=7).toPandas().sort_values("i")
    assert got["i"].tolist() == list(range(60))
    assert got["y"].tolist() == sorted([1.0] * 50 + [float(i) for i in range(10)])


def test_chunks_follow_the_rows(spark):
    """The plan of a small table has one chunk; of a larger one as many as its rows take, equal values in one."""
    df = spark.createDataFrame([(i % 2, i // 3) for i in range(900)], "k int, v int")
    assert {r[0] for r in ordered.with_value_chunks(df, "v").select("_chunk").distinct().collect()} == {0}
    cut = ordered.with_value_chunks(df, "v", ["k"], rows=100)
    of = {}
    for r in cut.collect():
        of.setdefault((r.k, r.v), set()).add(r["_chunk"])
    assert all(len(c) == 1 for c in of.values())
    assert 7 <= len(set.union(*of.values())) <= 9  # nine ranges of a hundred rows
    places = [min(of[key]) for key in sorted(of)]
    assert places == sorted(places)
    more = ordered.with_value_chunks(df.unionByName(df.withColumn("v", df.v + 1000)), "v", rows=100)
    assert more.select("_chunk").distinct().count() > 15


def test_curves_and_quantiles_do_not_depend_on_chunks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v int")
    for keys in ([], ["k"]):
        one, many = (sorted(map(str, ordered.ecdf(df, "v", keys, rows=r).collect())) for r in (10**6, 7))
        assert one == many
    counts = df.groupBy("k", "v").count().withColumnRenamed("count", "n")
    got = {r.k: (r.low, r.mid, r.high) for r in ordered.exact_quantiles(counts, "v", ["k"], {"low": 0.0, "mid": 0.37, "high": 1.0}, rows=9).collect()}
    for k in "ab":
        values = [v for j, v in rows if j == k and v is not None]
        assert np.allclose(got[k], np.quantile(values, [0, 0.37, 1]))


def test_encoder_numbers_over_ranges_and_bounds_the_driver(spark):
    df = spark.createDataFrame([(f"v{i:03}",) for i in range(300)] * 2 + [(None,)], "c string")
    codes = {r.value: r.ordinal for r in tables.category_codes(df, "c", rows=20).collect()}
    assert codes == {f"v{i:03}": i + 1 for i in range(300)}
    assert len(tables.fit_categories(df, "c")) == 300
    with pytest.raises(ValueError, match="column c has more than 299 values"):
        tables.fit_categories(df, "c", most=299)
