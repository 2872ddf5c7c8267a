"""Classifiers behind one call: fit on a frame, predict class probabilities.

Frames carry a vector column ``features`` and an integer ``label``. ``predict`` adds ``prob``, an array with one probability per class.
Tree ensembles are grown by :mod:`icuflow.learn.trees`, the others are Spark ML's. ``key`` names a unique id: draws follow from it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import NamedTuple

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icuflow.functions.values import hashed_uniform
from icuflow.learn.trees import PART_ROWS, Ensemble, Model, grow, predictor
from icuflow.sources.tables import stage

SEED = 42
MOST_FITS = 6  # side by side


class Fitted(NamedTuple):
    predict: Callable[[DataFrame], DataFrame]
    importances: Sequence[float] | None = None
    model: object = None  # grown trees, or Spark's model


def assemble(df: DataFrame, columns: Sequence[str], label: str, *keep: str) -> DataFrame:
    """Feature vector and label, other columns only when named."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    return rows.select(*keep, "features", F.col(label).cast("int").alias("label"))


def _probability(model) -> Callable[[DataFrame], DataFrame]:
    def predict(df):
        rows = model.transform(df.drop("rawPrediction", "probability", "prediction"))
        return rows.withColumn("prob", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
    return predict


def _native(estimator, train: DataFrame) -> Fitted:
    model = estimator.fit(train)
    return Fitted(_probability(model), getattr(model, "featureImportances", None), model)


def _grown(model: Model) -> Fitted:
    return Fitted(predictor(model), model.gains()[0].tolist(), model)


def side_by_side(df: DataFrame, calls: Sequence[Callable]) -> list:
    """What the calls return, in their order. Their fits are independent chains of small jobs, which only together fill a cluster."""
    if not calls:
        return []
    with ThreadPoolExecutor(min(len(calls), MOST_FITS)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(df.sparkSession)(call)) for call in calls]]


def one_vs_rest(train: DataFrame, classes: int, fit: Callable[[DataFrame], Fitted]) -> Fitted:
    """One binary model per class; their probabilities are scaled to sum to one."""
    members = side_by_side(train, [lambda c=c: fit(train.withColumn("label", (F.col("label") == c).cast("int"))) for c in range(classes)])

    def predict(df):
        for c, member in enumerate(members):
            df = member.predict(df).withColumn(f"_p{c}", F.col("prob")[1]).drop("prob")
        total = sum((F.col(f"_p{c}") for c in range(1, classes)), F.col("_p0"))
        return df.withColumn("prob", F.array(*[F.col(f"_p{c}") / total for c in range(classes)])).drop(*[f"_p{c}" for c in range(classes)])
    return Fitted(predict, None, members)


def ensemble(name: str, classes: int, size: int, **changes) -> Ensemble:
    """The defined settings of a tree ensemble on ``size`` features; boosting with regularisation is deeper and shorter for three classes."""
    root = 1 / math.sqrt(max(size, 1))
    found = {
        "random_forest": Ensemble("forest", classes, rounds=20, depth=12, columns=root),
        "extra_trees": Ensemble("extra", classes, rounds=50, depth=12, columns=0.7),
        "gradient_boosting": Ensemble("boost", classes, rounds=50, depth=3, rate=0.1, least=0.01, prior=True),
        "boosting_regularized": Ensemble("boost", classes, rounds=140, depth=5, rate=0.1, least=1.0, l2=1.0, rows=0.8, columns=0.8, seed=27)
        if classes == 2 else Ensemble("boost", classes, rounds=50, depth=6, rate=0.1, least=11.0, l2=1.5, rows=0.8, columns=0.7, seed=1337),
    }[name]
    return replace(found, **changes)


TREES = ("random_forest", "gradient_boosting", "boosting_regularized")


def feature_count(df: DataFrame) -> int:
    """Length of the feature vectors; 0 for an empty table."""
    row = df.select(F.size(vector_to_array("features")).alias("n")).first()
    return row["n"] if row else 0


def _tree_model(name: str):
    def fit(train: DataFrame, classes: int = 2, key: str | None = None, **settings) -> Fitted:
        changes = {k: v for k, v in settings.items() if k in ("rounds", "depth", "least")}
        return _grown(grow(train, [ensemble(name, classes, feature_count(train), **changes)], key)[0])
    return fit


random_forest, gradient_boosting, boosting_regularized, extra_trees = map(_tree_model, [*TREES, "extra_trees"])


def logistic_regression(train: DataFrame, classes: int = 2, c: float = 100.0, **_) -> Fitted:
    """L2 with cost ``c`` on the coefficients as they are, which is 1 / (c n) in Spark's mean loss."""
    return _native(LogisticRegression(regParam=1.0 / (c * max(train.count(), 1)), maxIter=500, tol=1e-8, standardization=False), train)


def _svm(train: DataFrame, c: float):
    """Each step of the solver is a job, so the table is read in parts of PART_ROWS rows or more."""
    n = train.count()
    return LinearSVC(regParam=1.0 / (c * max(n, 1)), maxIter=100, tol=1e-4).fit(train.coalesce(-(-n // PART_ROWS) or 1))


def _margin(svm, df: DataFrame) -> DataFrame:
    rows = svm.transform(df).withColumn("_svm", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))
    return rows.drop("rawPrediction", "prediction")


def linear_svm(train: DataFrame, classes: int = 2, c: float = 10.0, folds: int = 3, key: str | None = None, **_) -> Fitted:
    """Linear SVM; a logistic curve over the margin gives the probability.

    The curve is fitted on margins that come from machines which didn't see the row: one per fold, the folds drawn by hash.
    """
    draw = hashed_uniform(F.col(key), "calibration") if key else F.pmod(F.xxhash64("features", "label"), F.lit(1 << 20)) / (1 << 20)
    rows = train.withColumn("_fold", F.floor(F.coalesce(draw, F.lit(0.0)) * folds).cast("int"))

    def part(i):
        rest, held = rows.where(F.col("_fold") != i), rows.where(F.col("_fold") == i)
        return _margin(_svm(rest, c), held).select("_svm", "label") if rest.select("label").distinct().count() > 1 else None

    *parts, svm = side_by_side(train, [*[lambda i=i: part(i) for i in range(folds)], lambda: _svm(train, c)])
    margins = None
    for found in parts:
        if found is not None:
            margins = found if margins is None else margins.unionByName(found)
    curve = LogisticRegression(featuresCol="_svm").fit(stage(margins if margins is not None else _margin(svm, train).select("_svm", "label"), "margins"))
    return Fitted(lambda df: _probability(curve)(_margin(svm, df)).drop("_svm"), None, (svm, curve))


def waves(x: Column, frequency: np.ndarray, phase: np.ndarray) -> Column:
    """Random Fourier features of an array column: their products approach the RBF kernel. Column expressions only."""
    rows = F.from_json(F.lit(json.dumps([[*f.tolist(), p] for f, p in zip(frequency, phase)])), "array<array<double>>")
    one = F.concat(x, F.array(F.lit(1.0)))
    angle = lambda w: F.aggregate(F.zip_with(one, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.transform(rows, lambda w: F.cos(angle(w)) * math.sqrt(2.0 / len(phase)))


def drawn_waves(size: int, gamma: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(0.0, np.sqrt(2 * gamma), (width, size)), rng.uniform(0.0, 2 * np.pi, width)


def rbf_svm(train: DataFrame, classes: int = 3, c: float = 1.0, gamma: float = 0.05, width: int = 256, key: str | None = None, **_) -> Fitted:
    """RBF kernel by random Fourier features and one linear SVM per class."""
    drawn = drawn_waves(feature_count(train), gamma, width)

    def lift(df):
        return df.withColumn("features", array_to_vector(waves(vector_to_array("features"), *drawn)))
    fitted = one_vs_rest(stage(lift(train), "waves"), classes, lambda part: linear_svm(part, c=c, key=key))
    return Fitted(lambda df: fitted.predict(lift(df)), None, fitted.model)


def mlp(train: DataFrame, classes: int = 2, rounds: int = 100, **_) -> Fitted:
    """Feed-forward net with two hidden layers of ten sigmoid units."""
    return _native(MultilayerPerceptronClassifier(layers=[feature_count(train), 10, 10, classes], maxIter=rounds, seed=SEED), train)


MODELS: dict[str, Callable[..., Fitted]] = {
    "random_forest": random_forest, "gradient_boosting": gradient_boosting, "boosting_regularized": boosting_regularized, "extra_trees": extra_trees,
    "logistic_regression": logistic_regression, "linear_svm": linear_svm, "rbf_svm": rbf_svm, "mlp": mlp,
}
