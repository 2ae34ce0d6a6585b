"""Scores of predictions as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .scan import mid_ranks


def classification(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 of class 1."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(zero)
    return c.withColumns(
        {
            "accuracy": (tp + tn) / F.col("n"), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn), "constant_prediction": ((tp + fp) == 0) | ((fn + tn) == 0),
        }
    )


def matched_accuracy(predicted: DataFrame, prediction: str, labelled: DataFrame, label: str, key: str) -> DataFrame:
    """Predictions joined to labels by key: rows on both sides, on one side only, and the accuracy of the matched ones."""
    both = predicted.select(key, F.col(prediction).alias("_p"), F.lit(True).alias("_l")).join(labelled.select(key, F.col(label).alias("_y"), F.lit(True).alias("_r")), key, "full")
    return both.agg(
        F.count_if(F.col("_l") & F.col("_r")).alias("matched"), F.count_if(F.col("_l").isNull()).alias("unpredicted"),
        F.count_if(F.col("_r").isNull()).alias("unlabelled"), F.avg((F.col("_p") == F.col("_y")).cast("int")).alias("accuracy"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve as the normalised rank sum of class 1 (ties count half)."""
    ranks = mid_ranks(df.filter(F.col(label).isNotNull()), score, label)
    pos = F.col(label) == 1
    s = ranks.agg(
        F.coalesce(F.sum(F.when(pos, F.col("cnt"))), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum(F.when(~pos, F.col("cnt"))), F.lit(0)).alias("n_neg"),
        F.sum(F.when(pos, F.col("cnt") * F.col("mid_rank"))).alias("_r"),
    )
    p = F.col("n_pos").cast("double")
    return s.withColumn("auc", (F.col("_r") - p * (p + 1) / 2) / (p * F.col("n_neg"))).drop("_r")


def regression_errors(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))
