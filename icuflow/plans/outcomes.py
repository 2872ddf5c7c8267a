"""Outcome models end to end: impute, balance, scale, fit, reweight, evaluate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.values import argmax_class, cautious_class, flag, reweight, reweight_classes
from icuflow.learn.evaluate import Stack, called_class
from icuflow.learn.impute import fit_imputer
from icuflow.learn.models import MODELS, assemble
from icuflow.operators import metrics, prepare
from icuflow.sources.tables import stage

POPULATION_DEATHS = 0.1
THRESHOLDS = [i * 0.05 for i in range(20)]


def prepared(rows: DataFrame, key: str, label: str, columns: Sequence[str], scaled: Sequence[str], test_share: float, rounds: int):
    """Balanced, scaled training table and scaled test table, both staged."""
    sided = rows.withColumn("_side", prepare.split_name(key, test_share))
    train, test = (sided.filter(F.col("_side") == s).drop("_side") for s in ("train", "test"))
    imputer, train = fit_imputer(train, columns, rounds)
    balanced = prepare.undersample(train, label, key)
    fit_on = stage(balanced, "balanced")
    train, test = prepare.scale(fit_on, scaled, fit_on, imputer.apply(test))
    return stage(assemble(train, columns, label, key), "train"), stage(assemble(test, columns, label, key), "test")


def mortality_scores(
    rows: DataFrame, key: str, label: str, columns: Sequence[str], scaled: Sequence[str], model: str = "random_forest",
    rounds: int = 3, **settings,
) -> tuple[DataFrame, DataFrame]:
    """(key, label, score) of the balanced training rows and of the test rows, probabilities moved to the population; both staged."""
    train, test = prepared(rows, key, label, columns, scaled, 0.25, rounds)
    fitted = MODELS[model](train, classes=2, key=key, **settings)
    moved = reweight(F.col("prob")[1], POPULATION_DEATHS, 0.5).alias("score")
    return tuple(stage(fitted.predict(side).select(key, "label", moved), "scored") for side in (train, test))


def mortality_metrics(scored: DataFrame, model: str) -> DataFrame:
    """One row of metrics of scored test rows."""
    best = metrics.f1_sweep(scored, "label", "score", THRESHOLDS).filter(F.col("best") == 1).select("threshold", "f1")
    counts = metrics.threshold_counts(scored, "label", "score", stage)
    cells = metrics.confusion(scored, F.col("label"), flag(F.col("score") > 0.5))
    one = cells.withColumns({
        "auc": metrics.roc_auc(counts).scalar(), "pr_auc": metrics.pr_auc(counts, "score").scalar(),
        "_best": best.select(F.struct("threshold", "f1")).scalar(),
    })
    return one.select(F.lit(model).alias("model"), *cells.columns, "auc", "pr_auc", F.col("_best.threshold").alias("best_threshold"),
                      F.col("_best.f1").alias("best_f1"))


def mortality_model(rows: DataFrame, key: str, label: str, columns: Sequence[str], scaled: Sequence[str], model: str = "random_forest", **settings) -> DataFrame:
    """Binary mortality model end to end; one row of test metrics."""
    return mortality_metrics(mortality_scores(rows, key, label, columns, scaled, model, **settings)[1], model)


LINE_UP = ("random_forest", "gradient_boosting", "boosting_regularized", "rbf_svm", "stacking")


def outcome_model(
    rows: DataFrame, key: str, label: str, columns: Sequence[str], scaled: Sequence[str], models: Sequence[str] = LINE_UP,
    rounds: int = 3,
) -> DataFrame:
    """Three-class models (0 stays, 1 dies, 2 leaves); weighted average precision per model.

    The class is called in three ways: from the reweighted probabilities, from the plain ones, and by the rule that calls class 2
    over class 1 only when it is ten times as likely. The class shares that move the probabilities come from the test labels, as
    defined. ``rounds`` are those of the imputation. The stack's bases on all rows are the line-up's own models, fitted once. ``fitted``
    is the area of the plain way on the training rows.
    """
    train, test = prepared(rows, key, label, columns, scaled, 0.1, rounds)
    shares = test.agg(F.struct(*[F.avg(flag(F.col("label") == c)).alias(f"q{c}") for c in range(3)]).alias("q")).scalar()
    stacked = Stack(train, key, 3, propagate=[0, 1, 2]) if "stacking" in models else None
    out = None
    for name in models:
        ready = {"stacking": stacked.fitted(), **stacked.members} if stacked else {}
        fitted = ready.get(name) or MODELS[name](train, classes=3, key=key)
        learnt = fitted.predict(train).select("label", called_class(3).alias("called"))
        rows_ = fitted.predict(test).withColumn("_q", shares)
        probs = [F.col("prob")[c] for c in range(3)]
        moved = reweight_classes(probs, [F.col(f"_q.q{c}") for c in range(3)], [1 / 3] * 3)
        ways = {"reweighted": argmax_class(moved), "plain": argmax_class(probs), "cautious": cautious_class(probs)}
        scored = stage(rows_.select("label", *[c.alias(way) for way, c in ways.items()]), "scored")
        areas = {way: metrics.average_precision_weighted(scored, F.col("label"), F.col(way), [0, 1, 2]) for way in ways}
        first = areas.pop("reweighted").select(F.lit(name).alias("model"), F.col("average_precision").alias("reweighted"))
        areas["fitted"] = metrics.average_precision_weighted(learnt, F.col("label"), F.col("called"), [0, 1, 2])
        part = first.select("*", *[area.scalar().alias(way) for way, area in areas.items()])
        out = part if out is None else out.unionByName(part)
    return out
