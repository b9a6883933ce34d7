"""Experiment grids, seed sweeps and the tables made of their results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Output orders of models, data sets and modes.
MODEL_ORDER = ["cart", "lookahead-greedy", "lookahead-optimal", "treeset"]
DATASET_ORDER = [
    "adult", "bank", "compass", "german", "heloc", "spambase",
    "covertype", "thyroid", "communities", "heart", "lawschool", "acsincome",
]
MODES = ["nofair", "fair", "lpfr"]

# Parameters of the published experiment grid.
MODEL_PARAMETERS = {
    "cart": {"max_depth": "5"},
    "lookahead-greedy": {"budget": "5", "reg": "0.0001", "lookahead": "2", "max_features": "50"},
    "lookahead-optimal": {"budget": "5", "reg": "0.0001", "lookahead": "2"},
    "treeset": {"budget": "5", "reg": "0.0001", "lookahead": "2", "n_prefixes": "30", "tolerance": "0.02"},
}
REPAIR_PARAMETERS = {"fair_metric": "dp", "fair_lambda": "1.0", "acc_budget": "0.02"}

RUN = ["model", "dataset", "mode"]


def _string_map(values: dict[str, str]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def experiment_grid(
    datasets: DataFrame, seeds: Sequence[int], modes: Sequence[str] = tuple(MODES),
    models: Sequence[str] = tuple(MODEL_ORDER),
) -> DataFrame:
    """``dataset, mode, model, seed, params, fair_post``: every run for each row of ``datasets``.

    Each data set is expanded in place by fixed lists, so no join is involved.
    """
    def items(values: Iterable) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values]))

    grid = datasets.select("dataset", items(modes).alias("mode"))
    grid = grid.select("*", items(models).alias("model"))
    grid = grid.select("*", items(int(s) for s in seeds).alias("seed"))
    params = F.lit(None).cast("map<string,string>")
    for m, values in MODEL_PARAMETERS.items():
        params = F.when(F.col("model") == m, _string_map(values)).otherwise(params)
    repair = F.when(F.col("mode") == "lpfr", _string_map(REPAIR_PARAMETERS)).otherwise(_string_map({}))
    return grid.select(
        "dataset", "mode", "model", "seed", F.map_concat(params, repair).alias("params"),
        F.when(F.col("mode") == "fair", F.lit("sample"))
        .when(F.col("mode") == "lpfr", F.lit("leaf_pareto")).alias("fair_post"),
    )


def run_identity(
    model: Column, leaf_fill: Column, fair: Column, fair_post: Column
) -> tuple[Column, Column]:
    """The display name and the mode of a run, out of its parameters."""
    shown = F.when(
        model == "lookahead", F.concat(F.lit("lookahead-"), F.coalesce(leaf_fill, F.lit("greedy")))
    ).otherwise(model)
    mode = (
        F.when(~fair, F.lit("nofair")).when(fair_post == "leaf_pareto", F.lit("lpfr"))
        .otherwise(F.lit("fair"))
    )
    return shown.alias("model"), mode.alias("mode")


def sweep(
    spark: SparkSession, runs: Iterable[dict], run_one: Callable[[dict], DataFrame],
    fail_fast: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Run a list of configurations; ``run_metrics`` and ``run_failures`` tables come back.

    ``runs`` are rows with ``model, dataset, mode, seed``; ``run_one`` returns ``metric, value``.
    A run's own passes are the distributed part; the list of runs is a loop on the driver.
    """
    done, failed = [], []
    for run in runs:
        key = (run["model"], run["dataset"], run["mode"], int(run["seed"]))
        try:
            done += [(*key, r["metric"], r["value"]) for r in run_one(run).collect()]
        except Exception as error:  # a failed run is recorded, not fatal
            failed.append((*key, f"{type(error).__name__}: {error}"))
            if fail_fast:
                break
    return (
        spark.createDataFrame(done, "model string, dataset string, mode string, seed int, metric string, value double"),
        spark.createDataFrame(failed, "model string, dataset string, mode string, seed int, error string"),
    )


def seed_summary(run_metrics: DataFrame) -> DataFrame:
    """``model, dataset, mode, metric, mean, std, n`` over seeds.

    Sample standard deviation, 0 for a single seed; six digits.  A metric with a value that is
    missing or not finite in any seed is left out; a seed without the metric only lowers ``n``.
    """
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return (
        run_metrics.groupBy(*RUN, "metric")
        .agg(
            F.bool_and(finite).alias("_ok"), F.round(F.avg("value"), 6).alias("mean"),
            F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"),
            F.count("*").alias("n"),
        )
        .where("_ok").drop("_ok")
    )


def flatten_metrics(nested: DataFrame, keys: Sequence[str], metrics: str) -> DataFrame:
    """A map of attribute -> (map of metric -> value) as rows ``keys.., metric, value``."""
    outer = nested.select(*keys, F.explode(metrics).alias("_attribute", "_values"))
    inner = outer.select(*keys, "_attribute", F.explode("_values").alias("_metric", "value"))
    return inner.select(
        *keys,
        F.when(F.col("_attribute") == "", F.col("_metric"))
        .otherwise(F.concat_ws(".", "_attribute", "_metric")).alias("metric"),
        "value",
    )


def merge_with_fallback(fair: DataFrame, nofair: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The fair result of each key, or the nofair one where there is none; ``source`` says which."""
    values = [c for c in fair.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in values])
    f = fair.select(*keys, row.alias("_f"))
    n = nofair.select(*keys, row.alias("_n"))
    both = f.join(n, list(keys), "full_outer")
    return both.select(
        *keys, F.coalesce("_f", "_n").alias("_v"),
        F.when(F.col("_f").isNotNull(), F.lit("fair")).otherwise(F.lit("nofair")).alias("source"),
    ).select(*keys, "source", "_v.*")


def comparison_table(run_values: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per data set and model, plus a "(calibrated)" row where the fair run has one.

    ``run_values`` holds ``model, dataset, mode, metric, value``.  Columns: time, accuracy, baseline,
    then ``<attribute>_sp, _di, _eo``.  The plain row shows the fair run, else the nofair run; the
    calibrated row shows the accuracy after repair of the first attribute.
    """
    parts = {"sp": "sp_diff", "di": "di_ratio", "eo": "eo_diff"}
    metrics = ["training_time_s", "test_accuracy", "majority_baseline"]
    for a in attributes:
        metrics += [f"{a}.{m}" for m in parts.values()] + [f"{a}.calibrated_{m}" for m in parts.values()]
        metrics.append(f"{a}.calibrated_acc")
    # The metric names are known, so the pivot needs no pass to find them.
    wide = run_values.where(F.col("mode").isin("fair", "nofair")).groupBy(*RUN).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )
    keys = ["model", "dataset"]
    fair = wide.where(F.col("mode") == "fair").drop("mode")
    merged = merge_with_fallback(fair, wide.where(F.col("mode") == "nofair").drop("mode"), keys)

    def shown(model: Column, acc: str, prefix: str) -> list[Column]:
        return [
            "dataset", model.alias("model"), "training_time_s", F.col(f"`{acc}`").alias("test_accuracy"),
            "majority_baseline",
            *[F.col(f"`{a}.{prefix}{m}`").alias(f"{a}_{short}") for a in attributes for short, m in parts.items()],
        ]

    plain = merged.select(*shown(F.col("model"), "test_accuracy", ""))
    if not attributes:
        return plain
    first = attributes[0]
    repaired = fair.where(F.col(f"`{first}.calibrated_sp_diff`").isNotNull()).select(
        *shown(F.concat("model", F.lit(" (calibrated)")), f"{first}.calibrated_acc", "calibrated_")
    )
    return plain.unionByName(repaired)


def in_output_order(df: DataFrame, datasets: Sequence[str] = tuple(DATASET_ORDER),
                    models: Sequence[str] = tuple(MODEL_ORDER)) -> DataFrame:
    """Rows of known models and data sets in their fixed order; doubles rounded to six digits."""
    def position(column: str, values: Sequence[str]) -> Column:
        return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))

    rounded = [
        F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ]
    return (
        df.where(F.col("model").isin(list(models)) & F.col("dataset").isin(list(datasets)))
        .orderBy(position("model", models), position("dataset", datasets))
        .select(*rounded)
    )


def outcome_counts(runs: DataFrame) -> DataFrame:
    """``ok, n`` of a table of runs with a boolean column ``ok``."""
    return runs.groupBy("ok").agg(F.count("*").alias("n"))


def failed_runs(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("ok")).drop("ok")
