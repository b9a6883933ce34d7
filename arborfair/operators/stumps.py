"""Thresholds guessed by boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import at_most
from ..session import Scratch, spread
from .binarize import BinaryFeatures, assemble, collect_vocabulary
from .boosting import BUCKETS, Booster, boost


def fit_stump_thresholds(
    df: DataFrame, label: str, numeric: list[str], categorical: list[str], n_classes: int,
    n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 1, buckets: int = BUCKETS,
    column_elimination: bool = False,
) -> BinaryFeatures:
    """The thresholds that boosted trees of ``max_depth`` split at, plus all categories.

    Trees may split between any two values.  More than two classes share their gradients (softmax), a tree per class
    and round.  Labels are 0..n_classes-1.
    """
    thresholds: list[tuple[str, float]] = []
    if numeric:
        with Scratch(df.sparkSession) as scratch:
            model = boost(df, label, numeric, n_classes, scratch, n_estimators, learning_rate, max_depth, buckets)
            thresholds = [(numeric[i], t) for i, t in model.splits()]
            if column_elimination:
                thresholds = eliminate(df, label, thresholds, n_classes, scratch, n_estimators, learning_rate, max_depth)
    return assemble(
        thresholds, collect_vocabulary(df, categorical), [*numeric, *categorical], digits=6
    )


def eliminate(
    df: DataFrame, label: str, thresholds: list[tuple[str, float]], n_classes: int, scratch: Scratch,
    n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 1,
) -> list[tuple[str, float]]:
    """Drop the least important threshold while the training score stays at its base value.

    The threshold whose removal ended the loop is put back at the end of the list.  The models are boosted on the answers
    to the tests; rows that answer all alike are one weighted row.  A model without some test is the one before up to
    the first round that split on it, so a removal costs the rounds after that, and none if the test was not in use.
    """
    if len(thresholds) <= 1:
        return list(thresholds)
    bits = [f"if({at_most(c, t)}, 0.0D, 1.0D) AS x{i}" for i, (c, t) in enumerate(thresholds)]
    names = [f"x{i}" for i in range(len(thresholds))]
    answers = spread(df.where(F.col(label).isNotNull())).withColumn("_y", F.col(label).cast("int")).selectExpr("_y", *bits)
    kept = scratch.keep(answers.groupBy("_y", *names).agg(F.count(F.lit(1)).alias("_w")), "answers")
    booster = Booster(kept, len(names), n_classes, n_estimators, learning_rate, max_depth, [[0.0]] * len(names), scratch)
    left = list(range(len(names)))
    model = booster.fit()
    base, dropped = booster.accuracy(model), None
    score = base
    for _ in range(len(names) - 1):
        if score < base:
            break
        weights = model.importances(len(names))
        dropped = min(left, key=lambda i: (weights[i], i))
        left.remove(dropped)
        if weights[dropped]:
            model = booster.fit(left, model)
            score = booster.accuracy(model)
    return [thresholds[i] for i in left] + ([thresholds[dropped]] if dropped is not None else [])
