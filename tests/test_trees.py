import math
import random
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from icuflow.catalog.tree_sql import boosted_sql, forest_sql, table_sql
from icuflow.learn import trees
from icuflow.learn.evaluate import Stack, gain_table, grid_search, grid_search_r2, kfold_accuracy, with_folds
from icuflow.learn.models import MODELS, drawn_waves, ensemble, waves
from icuflow.learn.trees import BINS, PRIME, SCALE, Ensemble, Packed, fold_scores, grow, leaves_by_joins, predictor, scramble
from icuflow.operators.metrics import roc_auc_by


def rows_of(n=120, size=5, classes=2, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [round(rng.gauss(0, 1), 1) if j else float(rng.randint(0, 3)) for j in range(size)]
        out.append((i, x, int(x[0] > 1) + int(x[1] > 0.3) * (classes > 2) if rng.random() < 0.9 else rng.randrange(classes)))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    return with_folds(df.withColumn("features", array_to_vector("x")), "id", 3)


def matrix(rows):
    return np.array([x for _, x, _ in rows])


def duck_margins(df, spec, classes):
    """Margins or leaf shares by the statement, as a matrix in order of id."""
    held = df.select("id", "x", F.col("label").alias("y"), "fold").toPandas()
    held["x"] = held["x"].map(list)
    con = duckdb.connect()
    con.register("held", held)
    source = "SELECT id, CAST(x AS DOUBLE[]) AS x, y, true AS learnt, fold FROM held"
    if spec.kind == "boost":
        got = con.sql(f"WITH RECURSIVE {table_sql(source)}, {boosted_sql('g', [spec])} SELECT m FROM g WHERE r = {spec.rounds} ORDER BY id, k").fetchnumpy()["m"]
        return trees.probabilities(spec, np.array(got).reshape(-1, spec.outputs))
    p = ", ".join(f"sum(p{c} ORDER BY t) / {spec.rounds} AS p{c}" for c in range(classes))
    got = con.sql(f"WITH RECURSIVE {table_sql(source)}, {forest_sql('g', [spec])} SELECT {p} FROM g WHERE p0 IS NOT NULL GROUP BY id ORDER BY id").fetchnumpy()
    return np.stack([got[f"p{c}"] for c in range(classes)], 1)


SPECS = [
    Ensemble(rounds=6, depth=3, least=0.01, prior=True, fold=1),
    Ensemble(rounds=13, depth=4, least=1.0, l2=1.0, rows=0.8, columns=0.7),
    Ensemble(classes=3, rounds=5, depth=3, least=1.0, l2=1.5, rows=0.7, prior=True),
    Ensemble(rounds=6, depth=3, least=4.0, l2=1.0, columns=0.7, loss="squared"),
    Ensemble("forest", classes=3, rounds=7, depth=6, columns=0.5, fold=2),
    Ensemble("extra", classes=2, rounds=7, depth=6, columns=0.7),
]


def test_all_kinds_equal_the_statements_in_one_shared_run(spark):
    """Ensembles of all kinds grow in the same passes; each is what DuckDB grows alone."""
    for classes in (2, 3):
        rows = rows_of(classes=classes)
        df = frame(spark, rows)
        specs = [s for s in SPECS if s.classes == classes]
        for spec, model in zip(specs, grow(df, specs, "id", "fold")):
            assert np.abs(model.predict(matrix(rows)) - duck_margins(df, spec, classes)).max() < 1e-12, spec


def test_parts_and_small_tasks_give_the_same_trees(spark):
    df = frame(spark, rows_of(classes=3))
    specs = [SPECS[2], SPECS[4]]
    want = [[(t.heap, t.feature, t.cut, t.value, t.gain) for t in m.trees] for m in grow(df, specs, "id", "fold")]
    for changes in ({"part_rows": 25}, {"limit": 5 * BINS * 4 * 3}, {"part_rows": 40, "limit": 5 * BINS * 4 * 2}):
        again = grow(df.repartition(5), specs, "id", "fold", **changes)
        assert [[(t.heap, t.feature, t.cut, t.value, t.gain) for t in m.trees] for m in again] == want, changes


def test_first_split_is_the_best_of_all_by_hand(spark):
    rows = rows_of()
    model = grow(frame(spark, rows), [Ensemble(rounds=1, depth=1, least=1.0, l2=1.0)], "id")[0]
    x, y = matrix(rows), np.array([r[2] for r in rows])
    g = 0.5 - y
    found = []
    for f in range(x.shape[1]):
        for cut in model.cuts[f]:
            left = x[:, f] <= cut
            h = left.sum() / 4, (~left).sum() / 4
            if min(h) >= 1:
                gl, gr = g[left].sum(), g[~left].sum()
                found.append((gl**2 / (h[0] + 1) + gr**2 / (h[1] + 1) - g.sum() ** 2 / (len(y) / 4 + 1), -f, -cut, -0.1 * gl / (h[0] + 1), -0.1 * gr / (h[1] + 1)))
    gain, f, cut, left, right = max(found)
    tree = model.trees[0]
    assert (tree.feature[0], model.cuts[tree.feature[0]][tree.cut[0]]) == (-f, -cut) and abs(tree.gain[0] - gain) < 1e-9
    assert abs(tree.value[1][0] - left) < 1e-9 and abs(tree.value[2][0] - right) < 1e-9


def test_nodes_as_a_relation_score_alike(spark):
    rows = rows_of(60)
    df = frame(spark, rows)
    model = grow(df, [SPECS[1]], "id")[0]
    leaves = leaves_by_joins(df.withColumn("features", F.col("x")), "id", model.nodes(spark), 4)
    margin = leaves.groupBy("id").agg(F.sum(F.get("value", F.lit(0))).alias("m"))
    got = {r.id: 1 / (1 + math.exp(-r.m)) for r in margin.collect()}
    for i, p in enumerate(model.predict(matrix(rows))):
        assert abs(got[i] - p[1]) < 1e-12
    by = {r.id: r.prob for r in predictor(model)(df).select("id", "prob").collect()}
    assert all(np.allclose(by[i], p) for i, p in enumerate(model.predict(matrix(rows))))


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, nan], 0), (1, [2.0, nan], 1), (2, [nan, nan], 0), (3, [2.0, nan], 1), (4, [5.0, nan], None), (None, [1.0, nan], 0), (None, [1.0, nan], 0)] * 6
    df = spark.createDataFrame(rows, "id long, x array<double>, label int").withColumn("features", array_to_vector("x"))
    boost, forest = grow(df, [Ensemble(rounds=3, depth=2, least=0.1), Ensemble("forest", rounds=3, depth=3, columns=1.0)], "id")
    p = boost.predict(np.array([[1.0, 0], [2.0, 0], [nan, 0]]))[:, 1]
    assert p[0] < 0.5 < p[1] and p[2] == p[0]  # nulls go with the smallest values
    assert not any(f == 1 for t in boost.trees for f in t.feature)  # a column without values splits nothing
    assert np.allclose(forest.predict(np.array([[2.0, 0.0]])).sum(), 1)
    empty = grow(df.where("id = 99"), [Ensemble(rounds=2), Ensemble("extra", rounds=2)], "id")
    assert [m.trees for m in empty] == [[], []]
    one = grow(df.where("label = 1"), [Ensemble("forest", rounds=2, depth=3), Ensemble(rounds=2, prior=True)], "id")
    assert one[0].predict(np.array([[2.0, 0.0]])).tolist() == [[0.0, 1.0]] and one[1].predict(np.array([[2.0, 0.0]]))[0, 1] > 0.5
    without_key = grow(df.dropna(subset=["id"]), [Ensemble(rounds=2, depth=2, rows=0.5, least=0.1)])[0]
    assert len(without_key.trees) == 2


def test_draws_are_even_and_independent():
    base = np.arange(0, PRIME, PRIME // 20_000)
    u = [scramble(base, scramble(42, r)) / PRIME for r in range(3)]
    assert all(abs((x < 0.8).mean() - 0.8) < 0.02 for x in u) and abs(np.corrcoef(u[0], u[1])[0, 1]) < 0.03
    times = np.searchsorted(trees.POISSON, u[2], "right")
    assert abs(times.mean() - 1) < 0.03 and abs(times.var() - 1) < 0.05
    assert scramble(5, 7) == int(scramble(np.array([5]), 7)[0]) and SCALE == 2**24


def test_whole_ensembles_take_few_jobs_and_grow_the_same_trees(spark):
    """A small table: levels and rounds are no jobs; trees and held-out scores are those of the passes, also for unlabelled rows."""
    tracker = spark.sparkContext.statusTracker()
    for classes in (2, 3):
        df = frame(spark, rows_of(classes=classes)).withColumn("label", F.when(F.col("id") % 11 > 0, F.col("label")))
        specs = [s for s in SPECS if s.classes == classes]
        spark.sparkContext.setJobGroup(f"whole-{classes}", "whole")
        whole = grow(df, specs, "id", "fold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(tracker.getJobIdsForGroup(f"whole-{classes}")) <= 15
        passes = grow(df, specs, "id", "fold", part_rows=25)
        held = lambda models: [[(t.number, t.output, t.heap, t.feature, t.cut, t.left, t.value, t.gain, t.weight) for t in m.trees] for m in models]
        assert held(whole) == held(passes)
        cells = [(i, replace(s, fold=f)) for i, s in enumerate(specs) for f in range(3)]
        scored, again = (sorted((r.cell, r.id, r.fold, r.label, r.prob) for r in d.where("label is not null").collect()) for d in (
            trees.held_out_scores(df, cells, "id", "fold"), fold_scores(df, "id", "fold", [(i, m) for (i, _), m in zip(cells, grow(df, [s for _, s in cells], "id", "fold"))])))
        assert scored == again and trees.held_out_scores(df, cells, "id", "fold").count() == len(specs) * df.count()


def test_out_of_fold_rows_were_never_learnt(spark):
    """Turning the labels of one fold doesn't move that fold's scores."""
    rows = rows_of()
    df = frame(spark, rows)
    spec = [Ensemble(rounds=4, depth=3, least=0.1, prior=True, fold=1)]
    turned = df.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    scores = [{r.id: r.prob for r in fold_scores(d, "id", "fold", [(0, grow(d, spec, "id", "fold")[0])]).collect()} for d in (df, turned)]
    assert scores[0] == scores[1] and set(scores[0]) == {r.id for r in df.where("fold = 1").collect()}


def test_stack_learns_from_out_of_fold_scores(spark):
    rows = rows_of(150)
    df = frame(spark, rows).drop("fold")
    stack = Stack(df, "id", 2, bases=("random_forest", "logistic_regression"), propagate=[0], folds=3, trees=9, rounds=5)
    assert stack.meta.model.spec.kind == "extra" and stack.meta.model.spec.rounds == 9 and stack.meta.model.spec.columns == 0.7
    assert stack.scores.groupBy("name").count().collect()[0]["count"] == 150 and len(stack.importances) == 5
    out = stack.predict(df).select("label", "prob").collect()
    assert sum((r.prob[1] > 0.5) == (r.label == 1) for r in out) > 120 and all(abs(sum(r.prob) - 1) < 1e-9 for r in out)


def test_grids_and_folds(spark):
    df = frame(spark, rows_of()).drop("fold")
    found = grid_search(df, "id", depths=(1, 3), leaves=(1,), rounds=4, folds=3).orderBy("max_depth").collect()
    assert [(r.max_depth, r.min_leaf) for r in found] == [(1, 1), (3, 1)] and all(0.6 < r.auc <= 1 for r in found)
    r2 = grid_search_r2(df, "id", rates=(0.3,), depths=(2, 3), rounds=5, folds=3).collect()
    assert len(r2) == 2 and all(0 < r.r2 <= 1 for r in r2)
    one = kfold_accuracy(df, "id", "random_forest", rounds=5).first()
    assert 0.7 < one.accuracy <= 1 and 0 <= one.two_sd < 0.5
    assert kfold_accuracy(df, "id", "logistic_regression", folds=3).first().accuracy > 0.6


def test_grid_defaults_are_the_whole_job():
    cells = [ensemble("boosting_regularized", 2, 64), ensemble("boosting_regularized", 3, 64), ensemble("gradient_boosting", 3, 64)]
    assert [(c.rounds, c.depth) for c in cells] == [(140, 5), (50, 6), (50, 3)]
    import inspect
    assert inspect.signature(grid_search).parameters["rounds"].default == 140 and inspect.signature(grid_search_r2).parameters["rounds"].default == 90


@pytest.mark.parametrize("chunk", [0.0, 0.999])
def test_auc_by_keys_counts_pairs(spark, chunk):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 1), min(1.0, chunk + rng.randint(0, 5) / 5000)) for k in range(3) for _ in range(40)] + [(9, 1, 0.5)]
    got = {r.k: r.auc for r in roc_auc_by(spark.createDataFrame(rows, "k int, y int, s double"), ["k"], "y", "s").collect()}
    for k in range(3):
        a, b = [s for j, y, s in rows if j == k and y], [s for j, y, s in rows if j == k and not y]
        assert abs(got[k] - sum((x > z) + 0.5 * (x == z) for x in a for z in b) / len(a) / len(b)) < 1e-12
    assert got[9] is None


def test_gain_table_is_the_mean_over_splits(spark):
    model = grow(frame(spark, rows_of()), [SPECS[1]], "id")[0]
    want = {}
    for t in model.trees:
        for f, g in zip(t.feature, t.gain):
            if f >= 0:
                want.setdefault(f"c{f}", []).append(g)
    got = {r.feature: r.gain for r in gain_table(spark, model, [f"c{i}" for i in range(5)], 2).collect()}
    top = sorted(want, key=lambda n: -sum(want[n]) / len(want[n]))[:2]
    assert set(got) == set(top) and all(abs(got[n] - sum(want[n]) / len(want[n])) < 1e-12 for n in top)


def test_waves_approach_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.5, (30, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    lifted = df.select("id", waves(F.col("x"), *drawn_waves(8, 0.05, 256)).alias("z"))
    assert "Python" not in lifted._jdf.queryExecution().toString()
    z = np.array([r.z for r in lifted.orderBy("id").collect()])
    kernel = np.exp(-0.05 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - kernel).mean() < 0.05 and np.abs(z @ z.T - kernel).max() < 0.25


def test_calibration_doesn_t_see_its_rows(spark):
    """On labels without any relation the curve of the machine is flat: margins of rows that were learnt from would make it steep."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)], rng.randint(0, 1)) for i in range(80)]
    fitted = MODELS["linear_svm"](frame(spark, rows), key="id")
    probs = [r.prob[1] for r in fitted.predict(frame(spark, rows)).select("prob").collect()]
    assert max(probs) - min(probs) < 0.6


def test_packed_routes_like_a_walk():
    t = trees.Tree(0, 0)
    t.split(0, 1, 3, 1.0)
    t.split(1, 0, 2, 1.0)
    packed = Packed.of([t, trees.Tree(1, 0)])
    x = np.array([[2, 3], [3, 3], [0, 4]], np.uint8)
    assert packed.leaves(x).tolist() == [[3, 4, 2], [5, 5, 5]] and t.heap == [1, 2, 3, 4, 5]
