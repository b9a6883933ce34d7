"""Accuracy and error of predictions against the baselines a constant would reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(label: str, prediction: str) -> Column:
    return F.avg((F.col(prediction) == F.col(label)).cast("double"))


def majority_label(df: DataFrame, label: str) -> DataFrame:
    """One row ``majority``: the most frequent label, the smallest on a tie."""
    counts = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    return counts.agg(F.min_by("_l", F.struct(-F.col("_n"), F.col("_l"))).alias("majority"))


def classification_metrics(
    test: DataFrame, label: str, prediction: str, train: DataFrame
) -> DataFrame:
    """``n, accuracy, majority_baseline``: the baseline predicts the training majority."""
    majority = majority_label(train, label).scalar()
    return test.agg(
        F.count("*").alias("n"),
        accuracy(label, prediction).alias("accuracy"),
        F.avg((F.col(label) == majority).cast("double")).alias("majority_baseline"),
    )


def regression_metrics(
    test: DataFrame, label: str, prediction: str, train: DataFrame
) -> DataFrame:
    """``n, rmse, r2, baseline_rmse``: the baseline predicts the training mean."""
    mean = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = test.agg(
        F.count("*").alias("n"),
        F.sum((y - p) * (y - p)).alias("sse"),
        # Population variance is computed around a running mean, so it keeps its digits.
        (F.var_pop(y) * F.count("*")).alias("sst"),
        F.sum((y - mean) * (y - mean)).alias("base"),
    )
    n = F.col("n")
    return sums.select(
        "n",
        F.sqrt(F.col("sse") / n).alias("rmse"),
        F.when(F.col("sst") > 0, 1.0 - F.col("sse") / F.col("sst")).alias("r2"),
        F.sqrt(F.col("base") / n).alias("baseline_rmse"),
    )
