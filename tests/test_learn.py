import random
import threading

import numpy as np
from pyspark.ml.functions import array_to_vector

from icuflow.learn import models
from icuflow.learn.evaluate import importance_table, lasso_cv
from icuflow.learn.impute import fit_imputer, shrunk, unpacked
from icuflow.learn.models import MODELS, assemble


def test_imputer_recovers_a_linear_relation(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        a, b = rng.random(), rng.random()
        rows.append((i, a, b, None if i % 6 == 0 else 2 * a - b + 1, None))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, empty double")
    imputer, full = fit_imputer(df, ["a", "b", "c", "empty"], rounds=2)
    assert full.columns == df.columns
    for r in full.collect():
        assert abs(r["c"] - (2 * r["a"] - r["b"] + 1)) < 1e-3 and r["empty"] == 0.0
    again = {r["id"]: r["c"] for r in imputer.apply(df).collect()}
    assert all(abs(again[r["id"]] - r["c"]) < 1e-9 for r in full.collect())


def blobs(spark, classes):
    rng = random.Random(9)
    rows = [(i, i % classes, rng.gauss(3 * (i % classes), 0.4), rng.gauss(0, 1)) for i in range(150)]
    return assemble(spark.createDataFrame(rows, "id long, y int, x0 double, x1 double"), ["x0", "x1"], "y", "id")


def test_models_separate_blobs(spark):
    for name, classes in [("random_forest", 3), ("gradient_boosting", 3), ("logistic_regression", 2), ("linear_svm", 2)]:
        df = blobs(spark, classes)
        fitted = MODELS[name](df, classes=classes, rounds=3, trees=5)
        out = fitted.predict(df).select("label", "prob").collect()
        assert all(len(r["prob"]) == classes and abs(sum(r["prob"]) - 1) < 1e-9 for r in out)
        right = sum(max(range(classes), key=lambda c: r["prob"][c]) == r["label"] for r in out)
        assert right / len(out) > 0.9, name


def test_importances_are_scaled_by_the_largest(spark):
    table = importance_table(spark, [0.2, 0.8], ["a", "b"]).collect()
    assert [(r["feature"], r["importance"]) for r in table] == [("b", 1.0), ("a", 0.25)]


def test_imputer_equals_chained_regressions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e4, 1, (200, 4)) @ rng.normal(0, 1, (4, 4))
    gap = np.zeros((200, 4), bool)
    gap[::5, 0], gap[1::7, 2], gap[::11, 3] = True, True, True
    names = ["a", "b", "c", "d"]
    rows = [[i, *[None if g else float(v) for v, g in zip(*r)]] for i, r in enumerate(zip(x, gap))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    got = np.array([[r[c] for c in names] for r in fit_imputer(df, names, rounds=2)[1].orderBy("id").collect()])
    want = np.where(gap, np.nanmean(np.where(gap, np.nan, x), 0), x)
    for _ in range(2):
        for j in np.argsort(gap.sum(0), kind="stable")[1:]:  # fewest gaps first; b has none
            others = [i for i in range(4) if i != j]
            centre = want[:, others].mean(0)
            z = np.column_stack([np.ones(200), want[:, others] - centre])
            w = np.linalg.lstsq(z[~gap[:, j]], want[~gap[:, j], j], rcond=None)[0]
            want[gap[:, j], j] = z[gap[:, j]] @ w
    assert np.allclose(got, want, rtol=0, atol=2e-3 * np.std(x)) and np.array_equal(got[~gap], x[~gap])


def test_imputer_jobs_do_not_follow_columns_and_spread_solving_agrees(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (150, 6)) @ rng.normal(0, 1, (6, 6))
    gap = rng.random((150, 6)) < 0.2
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([[i, *[None if g else float(v) for v, g in zip(*r)]] for i, r in enumerate(zip(x, gap))], "id int, " + ", ".join(f"{n} double" for n in names))
    tracker = spark.sparkContext.statusTracker()

    def jobs(columns, rounds, **more):
        group = f"impute-{len(columns)}-{rounds}-{len(more)}"
        spark.sparkContext.setJobGroup(group, group)
        found = fit_imputer(df.repartition(3), columns, rounds, **more)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(tracker.getJobIdsForGroup(group))
    few, n = jobs(names[:2], 1)
    (imputer, full), m = jobs(names, 4)
    assert m == n and len(imputer.steps) == 24
    (spread, again), k = jobs(names, 4, held_cells=1)
    assert k > m and all(np.allclose(a.weights, b.weights, atol=1e-9) and a.column == b.column for a, b in zip(imputer.steps, spread.steps))
    a, b = ([[r[c] for c in names] for r in d.orderBy("id").collect()] for d in (full, again))
    assert np.allclose(a, b) and len(few[0].steps) == 2


def test_shrunk_rows_keep_products(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 1, (400, 3))
    x[::2, 1] = np.nan
    df = spark.createDataFrame([[float(v) if v == v else None for v in r] for r in x.tolist()], "a double, b double, c double")
    rows = shrunk(df.repartition(5), ["a", "b", "c"], np.array([3.0, 3.0, 3.0])).toArrow()
    z, gap = unpacked(rows["pattern"].to_pylist(), rows["z"].to_pylist(), 4)
    assert len(z) <= 8 and sorted(map(tuple, {tuple(g) for g in gap.tolist()})) == [(False, False, False), (False, True, False)]
    for miss in (False, True):
        part = x[np.isnan(x[:, 1]) == miss]
        full = np.column_stack([np.ones(len(part)), np.where(np.isnan(part), 0, part - 3)])
        mine = z[gap[:, 1] == miss]
        assert np.allclose(mine.T @ mine, full.T @ full)


def test_lasso_from_moments_is_at_its_optimum(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (200, 4)) * [1, 2, 1, 1]
    y = x @ [1.0, -0.5, 0, 0] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, x array<double>, label double")
    df = df.withColumn("features", array_to_vector("x"))
    found = lasso_cv(df.repartition(3), "id", list("abcd"), alphas=(1, 0.1, 0.01))
    w = np.array([r.coefficient for r in found.collect()])
    alpha = found.first().alpha
    assert alpha == 0.01
    xc, yc = x - x.mean(0), y - y.mean()
    slope = xc.T @ (yc - xc @ w) / len(y)
    assert all(abs(g - alpha * np.sign(v)) < 1e-9 if v else abs(g) <= alpha + 1e-9 for g, v in zip(slope, w))
    assert lasso_cv(df.where("id < 0"), "id", list("abcd")).select("coefficient").distinct().collect()[0][0] == 0.0


def test_independent_fits_run_side_by_side(spark, monkeypatch):
    """The folds' machines and the one on all rows wait for each other, which they can't one after the other; results come in order."""
    wait, fit = threading.Barrier(4), models._svm

    def together(train, c):
        wait.wait(120)
        return fit(train, c)

    monkeypatch.setattr(models, "_svm", together)
    rows = spark.createDataFrame([(i, i / 60 + (i % 7) / 50, int(i > 30)) for i in range(60)], "id long, x double, label int")
    fitted = models.linear_svm(models.assemble(rows, ["x"], "label", "id"), key="id")
    got = fitted.predict(models.assemble(rows, ["x"], "label", "id")).orderBy("id").collect()
    assert sum(int(r.prob[1] > 0.5) == r.label for r in got) >= 50
    assert models.side_by_side(rows, [lambda i=i: i * i for i in range(20)]) == [i * i for i in range(20)] and models.side_by_side(rows, []) == []
