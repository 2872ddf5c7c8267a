"""Cross-validation, grids, importance tables and stacking.

Wherever several tree ensembles are trained, on folds or grid cells, they share the passes over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.functions.values import argmax_class, hashed_uniform
from icuflow.learn.models import MODELS, TREES, Fitted, _grown, ensemble, feature_count, side_by_side
from icuflow.learn.trees import Ensemble, Model, grow, held_out_scores, matrix
from icuflow.operators import metrics
from icuflow.sources.tables import stage


def with_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """Fold number from a hash of the id that no split or balance order shares."""
    return df.withColumn("fold", F.floor(hashed_uniform(F.col(key), "fold") * folds).cast("int"))


def called_class(classes: int):
    return argmax_class([F.col("prob")[c] for c in range(classes)])


def out_of_fold(rows: DataFrame, key: str, names: Sequence[str], classes: int, folds: int = 5, full: bool = True, **changes):
    """(scores, members): for each model the probabilities of every row by the member that didn't learn from the row's fold, and the models on all rows.

    ``rows`` has ``fold``. Scores are (name, key, fold, label, prob), staged; members are left out unless ``full``.
    """
    size = feature_count(rows)
    trees = [n for n in names if n in TREES or n == "extra_trees"]
    members = {n: _grown(m) for n, m in zip(trees, grow(rows, [ensemble(n, classes, size, **changes) for n in trees], key, "fold"))} if full else {}
    number = {n: i for i, n in enumerate(names)}
    scores = held_out_scores(rows, [(number[n], ensemble(n, classes, size, fold=f, **changes)) for n in trees for f in range(folds)], key, "fold")
    for n in names:
        if n in trees:
            continue
        parts = [rows.where(F.col("fold") != f) for f in range(folds)]
        fitted = side_by_side(rows, [lambda part=part: MODELS[n](part, classes=classes, key=key) for part in [*parts, *([rows] if full else [])]])
        for f in range(folds):
            part = fitted[f].predict(rows.where(F.col("fold") == f))
            scores = scores.unionByName(part.select(F.lit(number[n]).alias("cell"), key, "fold", F.col("label").cast("double").alias("label"), "prob"))
        if full:
            members[n] = fitted[folds]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("cell") + 1)
    return stage(scores.withColumn("name", name).drop("cell"), "out-of-fold"), members


def kfold_accuracy(df: DataFrame, key: str, name: str, classes: int = 2, folds: int = 5, **changes) -> DataFrame:
    """Mean accuracy of a model over the folds and two population deviations."""
    scores, _ = out_of_fold(with_folds(df, key, folds), key, [name], classes, folds, full=False, **changes)
    each = scores.groupBy("fold").agg(F.avg((called_class(classes) == F.col("label")).cast("int")).alias("accuracy"))
    return each.agg(F.avg("accuracy").alias("accuracy"), (2 * F.stddev_pop("accuracy")).alias("two_sd"))


def importance_table(spark: SparkSession, importances, names: Sequence[str]) -> DataFrame:
    """Importances divided by the largest, in descending order; one row per feature."""
    values = [float(x) for x in importances]
    most = max(values) or 1.0
    return spark.createDataFrame([(n, v / most) for n, v in zip(names, values)], "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def moments(df: DataFrame, fold: str, size: int) -> dict[int, np.ndarray]:
    """Per fold the sums of products of (1, features, label): one pass, tasks add up their rows, and cells reach the driver."""
    plain = df.select(F.col(fold).cast("int").alias("fold"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), matrix(batch.column(1), size), batch.column(2).to_numpy()])
            folds = batch.column(0).to_numpy()
            for f in np.unique(folds).tolist():
                part = z[folds == f]
                total[f] = total.get(f, 0.0) + part.T @ part
        for f, cells in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(cells.size, f, np.int32)), pa.array(np.arange(cells.size, dtype=np.int32)), pa.array(cells.ravel())], names=["fold", "cell", "value"])

    found = plain.mapInArrow(add, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).toArrow()
    out = {f: np.zeros((size + 2) ** 2) for f in set(found["fold"].to_pylist())}
    fold_of, cell, value = (found[c].to_numpy() for c in ("fold", "cell", "value"))
    for f, cells in out.items():
        cells[cell[fold_of == f]] = value[fold_of == f]
    return {f: cells.reshape(size + 2, size + 2) for f, cells in out.items()}


def lasso(total: np.ndarray, alpha: float, sweeps: int = 10_000) -> tuple[np.ndarray, float]:
    """Weights and constant with the least mean squared error / 2 + alpha * sum of absolute weights, by coordinate descent on the moments."""
    n = total[0, 0]
    mean = total[0] / n
    cov = total / n - np.outer(mean, mean)
    q, r = cov[1:-1, 1:-1], cov[1:-1, -1]
    w = np.zeros(len(r))
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(w)):
            if q[j, j] <= 0:
                continue
            pull = r[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / q[j, j]
            most, w[j] = max(most, abs(new - w[j])), new
        if most < 1e-13:
            break
    return w, float(mean[-1] - w @ mean[1:-1])


def lasso_cv(df: DataFrame, key: str, names: Sequence[str], alphas: Sequence[float] = (1, 0.1, 0.01, 0.0005), folds: int = 5) -> DataFrame:
    """Coefficients of the lasso whose penalty has the least mean squared error over the folds, with that penalty; the first of equals.

    All fits and errors come from the folds' moments: one pass over the rows, whatever the number of folds and penalties.
    """
    parts = moments(with_folds(df, key, folds), "fold", len(names))
    whole = sum(parts.values(), np.zeros((len(names) + 2, len(names) + 2)))

    def error(alpha):
        out = []
        for held in parts.values():
            if not (whole - held)[0, 0]:
                continue
            w, b = lasso(whole - held, alpha)
            residual = np.array([-b, *-w, 1.0])
            out.append(residual @ held @ residual / held[0, 0])
        return float(np.mean(out)) if out else 0.0

    best = min(alphas, key=error)
    weights = lasso(whole, best)[0] if whole[0, 0] else np.zeros(len(names))
    rows = [(n, float(c), float(best)) for n, c in zip(names, weights)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, alpha double")


def grid_scores(df: DataFrame, key: str, cells: Sequence[Ensemble], folds: int) -> DataFrame:
    """(cell, key, fold, label, score): all rows scored under all grid cells, each by the model that didn't learn from its fold."""
    rows = with_folds(df, key, folds)
    held = held_out_scores(rows, [(i, Ensemble(**{**c.__dict__, "fold": f})) for i, c in enumerate(cells) for f in range(folds)], key, "fold")
    return stage(held.withColumn("score", F.element_at("prob", -1)).drop("prob"), "grid")


def grid_search(
    df: DataFrame, key: str, depths: Sequence[int] = (3, 5, 7, 9), leaves: Sequence[int] = (1, 3, 5), rounds: int = 140, folds: int = 5,
) -> DataFrame:
    """Mean area under the ROC curve over the folds per (depth, smallest leaf weight) of regularised boosting."""
    grid = list(product(depths, leaves))
    cells = [grid_cell(depth=d, least=float(l), rounds=rounds) for d, l in grid]
    areas = metrics.roc_auc_by(grid_scores(df, key, cells, folds), ["cell", "fold"], "label", "score")
    return _named(areas.groupBy("cell").agg(F.avg("auc").alias("auc")), grid, "max_depth int, min_leaf int")


def grid_cell(**changes) -> Ensemble:
    return ensemble("boosting_regularized", 2, 0, **changes)


def grid_cell_r2(**changes) -> Ensemble:
    return Ensemble(**{**dict(rounds=90, least=4.0, l2=1.0, rows=0.7, columns=0.7, loss="squared", seed=0), **changes})


def _named(found: DataFrame, grid: Sequence[tuple], fields: str) -> DataFrame:
    cells = found.sparkSession.createDataFrame([(i, *g) for i, g in enumerate(grid)], f"cell int, {fields}")
    return cells.join(found, "cell", "left").drop("cell")


def grid_search_r2(
    df: DataFrame, key: str, rates: Sequence[float] = (0.03, 0.05, 0.07), depths: Sequence[int] = (5, 6, 7), rounds: int = 90, folds: int = 5,
) -> DataFrame:
    """Mean r2 of the called class over the folds per (learning rate, depth) of trees boosted on the squared error of a 0/1 label."""
    grid = list(product(map(float, rates), depths))
    scores = grid_scores(df, key, [grid_cell_r2(rate=r, depth=d, rounds=rounds) for r, d in grid], folds)
    miss = F.col("label") - (F.col("score") > 0.5).cast("int")
    each = scores.groupBy("cell", "fold").agg((1 - F.try_divide(F.sum(miss * miss), F.var_pop("label") * F.count("label"))).alias("r2"))
    return _named(each.groupBy("cell").agg(F.avg("r2").alias("r2")), grid, "learning_rate double, max_depth int")


def gain_table(spark: SparkSession, model: Model, names: Sequence[str], top: int = 10) -> DataFrame:
    """Mean gain of the splits at each feature that has any, the ``top`` largest."""
    total, n = model.gains()
    rows = [(name, float(t / k)) for name, t, k in zip(names, total, n) if k]
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature").limit(top)


BASES = ("random_forest", "gradient_boosting", "boosting_regularized", "logistic_regression")


class Stack:
    """A stacked ensemble: its bases' out-of-fold probabilities, the bases on all rows, and the trees above them."""

    def __init__(self, train: DataFrame, key: str, classes: int, bases: Sequence[str] = BASES, propagate: Sequence[int] = (), folds: int = 5, trees: int = 50, **changes):
        """``propagate`` lists positions of raw features that the last step sees as well; ``changes`` are settings of the tree bases."""
        self.bases, self.classes, self.propagate = list(bases), classes, list(propagate)
        rows = with_folds(train, key, folds)
        self.scores, self.members = out_of_fold(rows, key, self.bases, classes, folds, **changes)
        wide = self.scores.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("prob"))).alias(f"_{n}") for n in self.bases])
        held = self.features(rows.join(wide, key))
        self.meta = _grown(grow(held.select(key, "features", "label"), [ensemble("extra_trees", classes, 0, rounds=trees)], key)[0])
        self.importances = self.meta.importances

    def features(self, df: DataFrame) -> DataFrame:
        raw = [vector_to_array("features")[i] for i in self.propagate]
        parts = [f"_{n}" for n in self.bases]
        joined = F.concat(*parts, F.array(*raw)) if raw else F.concat(*parts)
        return df.withColumn("_raw", F.col("features")).withColumn("features", array_to_vector(joined)).drop(*parts)

    def predict(self, df: DataFrame) -> DataFrame:
        for n, member in self.members.items():
            df = member.predict(df).withColumnRenamed("prob", f"_{n}")
        return self.meta.predict(self.features(df)).withColumn("features", F.col("_raw")).drop("_raw")

    def fitted(self) -> Fitted:
        return Fitted(self.predict, self.importances, self)
