import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from icuflow.operators import pairs
from icuflow.operators.tables import group_rate
from icuflow.plans.diagnoses import diagnosis_features


def make(seed, stays, codes, deaths=0.6):
    rng = random.Random(seed)
    held = {s: {f"c{rng.randrange(codes):03d}" for _ in range(rng.randrange(1, 30))} for s in range(stays)}
    return held, {s: int(rng.random() < deaths) for s in held}


@pytest.mark.parametrize("k", [5, 62, 130])
def test_counts_match_brute_force(spark, k):
    held, died = make(k, 120, 150)
    df = spark.createDataFrame([(s, c, died[s]) for s in held for c in held[s]], "s long, c string, d int")
    ranked = pairs.ranked_codes(group_rate(df, ["c"], "d", 1), "c", k)
    order = {r["place"]: r["c"] for r in ranked.collect()}
    masks = pairs.stay_masks(df, ranked, "s", "c", k, [F.max("d").alias("d")])
    got = {(order[r["a"]], order[r["b"]]): (r["n"], r["events"]) for r in pairs.pair_counts(masks, k, "d").collect()}
    expected = {}
    for a, b in combinations([order[i] for i in sorted(order)], 2):
        both = [s for s in held if a in held[s] and b in held[s]]
        if both:
            expected[a, b] = (len(both), sum(died[s] for s in both))
    assert got == expected
    chosen = pairs.pair_counts(masks, k, "d").filter(F.col("n") >= 3).select("a", "b")
    found = {(order[r["a"]], order[r["b"]], r["s"]) for r in pairs.stays_with_pairs(masks, chosen, "s", k).collect()}
    assert found == {(a, b, s) for (a, b), (n, _) in expected.items() if n >= 3 for s in held if a in held[s] and b in held[s]}
    lists = pairs.bounded_lists(pairs.stays_with_pairs(masks, chosen, "s", k), ["a", "b"], "s", size=10)
    assert lists.filter(F.size("ss") > 10).count() == 0 and lists.agg(F.sum(F.size("ss"))).first()[0] == len(found)


def test_diagnosis_features_brute_force(spark):
    held, died = make(11, 90, 60, 0.3)
    rows = [(s, c, died[s], i + 1, c) for s in held for i, c in enumerate(sorted(held[s]))]
    df = spark.createDataFrame(rows, "icustay_id long, short_title string, hospital_expire_flag int, seq_num int, icd9_code string")
    got = {r["icustay_id"]: tuple(r[f"deathrate_{x}"] for x in ("cat_1", "cat_2", "int_cat_1", "int_cat_2"))
           for r in diagnosis_features(df, 3, 3, 10).collect()}
    rate = {}
    for c in {c for h in held.values() for c in h}:
        members = [s for s in held if c in held[s]]
        if sum(died[s] for s in members) >= 3:
            rate[c] = sum(died[s] for s in members) / len(members)
    best = sorted(rate, key=lambda c: (-rate[c], c))[:10]
    bins = {}
    for a, b in combinations(best, 2):
        both = [s for s in held if a in held[s] and b in held[s]]
        if len(both) >= 3:
            r = sum(died[s] for s in both) / len(both)
            if r > rate[a] + 0.25 or r > rate[b] + 0.25:
                for s in both:
                    bins.setdefault(s, set()).add(2 if r >= 0.9 else 1 if r >= 0.5 else 0)
    for s in held:
        ones = sum(1 for c in held[s] if c in rate and 0.5 <= rate[c] < 0.7)
        twos = sum(1 for c in held[s] if c in rate and rate[c] >= 0.7)
        assert got[s] == (ones, twos, int(1 in bins.get(s, ())), int(2 in bins.get(s, ())))
    assert any(v[3] for v in got.values())
