"""Train, score, evaluate and repair in one go; every result is a row of a table."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fairness, metrics
from ..operators.cart import fit_cart, fit_cart_on_tests
from ..operators.lookahead import BinarizerOptions, fit_binary_features, lookahead_tree
from ..operators.rollout import rollout_tree
from ..operators.tree import Tree
from ..operators.treeset import near_optimal_trees
from ..session import Scratch
from .recipe import Prepared, Recipe, prepare

METRICS_SCHEMA = "metric string, value double"


@dataclass(frozen=True)
class RunConfig:
    """One run.  ``mode``: nofair, fair (repair by rows) or lpfr (repair by leaves)."""

    model: str = "cart"
    mode: str = "nofair"
    seed: int = 42
    test_size: float = 0.2
    params: dict = field(default_factory=dict)
    binarizer: BinarizerOptions = BinarizerOptions()
    fair_metric: str = "dp"
    fair_lambda: float = 1.0
    acc_budget: float = 0.02


def fit_model(config: RunConfig, data: Prepared) -> Tree:
    """The tree named by ``config.model``; of a set of trees, the best one."""
    f, p = data.features, dict(config.params)
    if config.model == "cart":
        # CLI-level defaults of the experiments; the operator's own are larger.
        p = {"min_samples_split": 10, "min_samples_leaf": 5, "n_classes": data.n_classes, **p}
        fit = fit_cart_on_tests if p.pop("on_tests", False) else fit_cart
        return fit(data.train, data.label, f.numeric, f.categorical, **p)
    tests = fit_binary_features(
        data.train, data.label, f.numeric, f.categorical, data.n_classes, config.binarizer
    )
    if config.model in ("lookahead-greedy", "lookahead-optimal"):
        fill = config.model.split("-")[1]
        return lookahead_tree(data.train, data.label, tests, data.n_classes, leaf_fill=fill, **p)
    if config.model == "rollout":
        return rollout_tree(data.train, data.label, tests, data.n_classes, **p)
    if config.model == "treeset":
        return near_optimal_trees(data.train, data.label, tests, data.n_classes, seed=config.seed, **p)[0]
    raise ValueError(f"unknown model {config.model!r}")


def _fairness_rows(
    scored: DataFrame, label: str, prediction: str, group: str, prefix: str
) -> DataFrame:
    table = fairness.group_fairness(scored, label, prediction, group)
    wide = fairness.parity_summary(table)
    return wide.unpivot([], ["sp_diff", "di_ratio", "eo_diff"], "metric", "value").select(
        F.concat(F.lit(prefix), "metric").alias("metric"), F.col("value").cast("double")
    )


def fairness_report(
    test: DataFrame, train: DataFrame, data: Prepared, tree: Tree, config: RunConfig
) -> DataFrame:
    """``metric, value`` per sensitive column, before and, if asked for, after repair."""
    report = None

    def add(rows: DataFrame) -> None:
        nonlocal report
        report = rows if report is None else report.unionByName(rows)

    for column, group in data.groups.items():
        add(_fairness_rows(test, data.label, "prediction", group, f"{column}."))
        if config.mode == "nofair":
            continue
        if config.mode == "fair":
            prefix = f"{column}.calibrated_"
            fixed = fairness.calibrate_rows(
                test, data.label, "prediction", group, data.row_id, config.seed
            )
        else:
            prefix = f"{column}.lpfr_"
            repair = fairness.fit_leaf_repair(
                train, "leaf_id", group, data.label, "prediction", config.fair_metric,
                config.fair_lambda, config.acc_budget,
            )
            fixed = test.withColumn("fair_prediction", repair.apply("leaf_id", "prediction"))
        add(_fairness_rows(fixed, data.label, "fair_prediction", group, prefix))
        add(fixed.agg(metrics.accuracy(data.label, "fair_prediction").alias("value")).select(
            F.lit(f"{prefix}acc").alias("metric"), "value"))
        add(fixed.agg(
            (metrics.accuracy(data.label, "fair_prediction") - metrics.accuracy(data.label, "prediction")).alias("value")
        ).select(F.lit(f"{prefix}acc_delta").alias("metric"), "value"))
    return report if report is not None else test.sparkSession.createDataFrame([], METRICS_SCHEMA)


def train_and_evaluate(recipe: Recipe, table: DataFrame, config: RunConfig) -> tuple[Tree, DataFrame]:
    """The fitted tree and its test metrics in long form (``metric, value``).

    The prepared rows are written once, because the learner reads them once per level.
    """
    if config.mode not in ("nofair", "fair", "lpfr"):
        raise ValueError(f"unknown mode {config.mode!r}")
    spark = table.sparkSession
    with Scratch(spark) as scratch:
        data = prepare(recipe, table, config.test_size, config.seed, config.mode != "nofair", scratch)
        started = time.perf_counter()
        tree = fit_model(config, data)
        elapsed = time.perf_counter() - started
        test = tree.score(data.test, leaf="leaf_id")
        train = tree.score(data.train, leaf="leaf_id")
        quality = metrics.classification_metrics(test, data.label, "prediction", data.train).select(
            F.col("accuracy").alias("test_accuracy"), "majority_baseline",
            F.lit(elapsed).alias("training_time_s"), F.lit(float(tree.num_leaves())).alias("n_leaves"),
        ).unpivot(
            [], ["test_accuracy", "majority_baseline", "training_time_s", "n_leaves"], "metric", "value"
        )
        report = quality.unionByName(fairness_report(test, train, data, tree, config))
        return tree, spark.createDataFrame(report.collect(), METRICS_SCHEMA)
