"""Evaluation of scores and class predictions with one pass per table, no sort of raw rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icuflow.operators.ordered import CHUNK, CHUNK_ROWS, Hold, keep, running_totals, with_value_chunks


def confusion(df: DataFrame, truth: Column, called: Column) -> DataFrame:
    """Confusion counts with accuracy, recall and precision (zero where undefined)."""
    n = {name: F.count_if((truth == t) & (called == c)).alias(name)
         for name, t, c in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))}
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def share(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.agg(*n.values()).select(
        "tn", "fp", "fn", "tp", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fn).alias("recall"),
        share(tp, tp + fp).alias("precision"),
    )


def threshold_counts(df: DataFrame, truth: str, score: str, hold: Hold = keep, rows: int = CHUNK_ROWS) -> DataFrame:
    """(score, pos, neg, tp, fp): cumulative counts from the highest score down, ties in one row.

    The area and point functions below take this table; stage it (``hold``) to read the rows once.
    """
    counts = df.groupBy((-F.col(score)).alias("_down")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")
    ).withColumn("_all", F.lit(0))
    counts = with_value_chunks(hold(counts, "thresholds"), "_down", rows=rows)
    run = running_totals(counts, ["_all"], ["_down"], CHUNK, {"tp": F.col("pos"), "fp": F.col("neg")})
    return hold(run.select((-F.col("_down")).alias(score), "pos", "neg", "tp", "fp"), "thresholds")


def _totals(points: DataFrame) -> DataFrame:
    whole = points.agg(F.struct(F.max("tp").alias("p"), F.max("fp").alias("n"))).scalar()
    return points.withColumn("_whole", whole)


def roc_points(counts: DataFrame, score: str) -> DataFrame:
    p = _totals(counts)
    return p.select(score, F.try_divide(F.col("fp"), F.col("_whole.n")).alias("fpr"), F.try_divide(F.col("tp"), F.col("_whole.p")).alias("tpr"))


def roc_auc(counts: DataFrame) -> DataFrame:
    """Area under the ROC curve; the previous point follows from the row's own counts."""
    neg, pos, tp = (F.col(c).cast("double") for c in ("neg", "pos", "tp"))  # products of counts outgrow a long
    return counts.agg(F.try_divide(F.sum(neg * (2 * tp - pos) / 2), F.max("tp").cast("double") * F.max("fp")).alias("auc"))


def roc_auc_by(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """(keys, auc) of scores from 0 to 1: pairs of both classes in the right order, equal scores half; null without both classes.

    Rows are counted by score first; running counts are cut into chunks of scores, so no key is sorted in one task.
    """
    counts = df.groupBy(*keys, score).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    run = running_totals(counts.withColumn(CHUNK, F.floor(F.col(score) * 1024)), keys, [score], CHUNK, {"_upto": F.col("neg")})
    pos, neg, upto = (F.col(c).cast("double") for c in ("pos", "neg", "_upto"))  # products of counts outgrow a long
    return run.groupBy(*keys).agg(F.try_divide(F.sum(pos * (2 * upto - neg) / 2), F.sum(pos) * F.sum(neg)).alias("auc"))


def pr_points(counts: DataFrame, score: str) -> DataFrame:
    p = _totals(counts)
    tp, fp = F.col("tp"), F.col("fp")
    before_tp, before_fp = tp - F.col("pos"), fp - F.col("neg")
    return p.select(
        score, F.try_divide(tp, F.col("_whole.p")).alias("recall"), (tp / (tp + fp)).alias("precision"),
        F.try_divide(F.col("pos"), F.col("_whole.p")).alias("_step"),
        F.coalesce(F.try_divide(before_tp, before_tp + before_fp), F.lit(1.0)).alias("_before"),
    )


def pr_auc(counts: DataFrame, score: str) -> DataFrame:
    """Trapezoid area under precision over recall, starting at recall 0 and precision 1."""
    return pr_points(counts, score).agg(F.sum(F.col("_step") * (F.col("precision") + F.col("_before")) / 2).alias("pr_auc"))


def f1_sweep(df: DataFrame, truth: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """F1 per threshold from one aggregation; ``best`` marks the first threshold with the highest F1."""
    y, s = F.col(truth), F.col(score)
    cells = []
    for i, t in enumerate(thresholds):
        cells += [F.count_if((s > t) & (y == 1)).alias(f"tp{i}"), F.count_if((s > t) & (y == 0)).alias(f"fp{i}")]
    one = df.agg(F.count_if(y == 1).alias("p"), *cells)
    rows = one.select("p", F.expr(
        f"stack({len(thresholds)}, " + ", ".join(f"{t!r}D, tp{i}, fp{i}" for i, t in enumerate(thresholds)) + ") AS (threshold, tp, fp)"
    ))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), F.lit(0.0))
    rank = F.row_number().over(W.orderBy(F.desc("f1"), "threshold"))  # as many rows as thresholds
    return rows.select("threshold", f1.alias("f1")).withColumn("best", (rank == 1).cast("int"))


def average_precision_weighted(df: DataFrame, truth: Column, called: Column, classes: Sequence[int]) -> DataFrame:
    """One-vs-rest average precision of hard predictions, weighted by class size.

    A hard prediction has two thresholds, so the step sum has a called part and the rest at the
    share of the class.
    """
    cells = []
    for c in classes:
        cells += [F.count_if(truth == c).alias(f"p{c}"), F.count_if(called == c).alias(f"k{c}"),
                  F.count_if((truth == c) & (called == c)).alias(f"t{c}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *cells)

    def area(c):
        p, k, t = F.col(f"p{c}"), F.col(f"k{c}"), F.col(f"t{c}")
        recall = F.coalesce(F.try_divide(t, p), F.lit(0.0))
        return recall * F.coalesce(F.try_divide(t, k), F.lit(0.0)) + (1 - recall) * p / F.col("n")
    weighted = sum((F.col(f"p{c}") * area(c) for c in classes), F.lit(0.0))
    return one.select((weighted / F.col("n")).alias("average_precision"))
