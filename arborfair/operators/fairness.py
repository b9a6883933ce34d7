"""Group fairness: sensitive groups, metrics per group, and two ways to repair predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import SCORE_DIGITS
from ..functions.ranks import exact_quantiles, take_per_group
from ..sources.tables import FeatureSpec

MAX_GROUPS = 10  # numeric attributes with more values are cut at their quartiles
SMALL_GROUP = 50
# The repair by leaves compares all groups with one another; more of them raise an error.
MAX_REPAIR_GROUPS = 20_000


def drop_sensitive(features: FeatureSpec, sensitive: list[str]) -> FeatureSpec:
    """The features to learn from; the sensitive columns stay in the rows."""
    return features.without(sensitive)


# -- groups ------------------------------------------------------------------------------


def quartile_edges(df: DataFrame, column: str, basis: str = "distinct", **kw) -> list[float]:
    """Distinct quartile borders of the column's distinct values, or of its rows."""
    if basis not in ("distinct", "rows"):
        raise ValueError(f"unknown basis {basis!r}")
    values = df.select(F.col(column).cast("double").alias("v"))
    if basis == "distinct":
        values = values.distinct()
    edges = exact_quantiles(values, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0], **kw)["v"]
    return sorted({e for e in edges if e is not None})


def interval_group(column: str, edges: list[float], digits: int) -> Column:
    """The label of the right-closed interval a value lies in; the lowest border is included."""
    value = F.col(column).cast("double")
    group = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        group = F.when(value <= F.lit(high), F.lit(f"{low:.{digits}f}-{high:.{digits}f}")).otherwise(group)
    return F.when(value >= F.lit(edges[0]), group)


def sensitive_group(df: DataFrame, column: str, basis: str = "distinct", **kw) -> Column:
    """The column as group name: numbers with more than ten values become quartile groups.

    ``basis="distinct"`` is the rule of data preparation (labels without decimals),
    ``basis="rows"`` that of evaluation (one decimal).
    """
    if isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType)):
        # Far above ten values the estimate is enough, and only few values are listed exactly.
        roughly = df.agg(F.approx_count_distinct(column)).first()[0]
        many = roughly > 3 * MAX_GROUPS or df.agg(F.count_distinct(column)).first()[0] > MAX_GROUPS
        if many:
            edges = quartile_edges(df, column, basis, **kw)
            return interval_group(column, edges, 0 if basis == "distinct" else 1)
    return F.col(column).cast("string")


# -- metrics -----------------------------------------------------------------------------


def group_fairness(
    df: DataFrame, label: str, prediction: str, group: str, positive: int = 1
) -> DataFrame:
    """``group, n, accuracy, positive_rate, tpr, small_group``; no rows for a single group.

    ``tpr`` is null in a group without positive labels.  Any number of columns may be
    audited by the caller with one such aggregate each.
    """
    hit = (F.col(prediction) == positive).cast("double")
    table = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(
        F.count("*").alias("n"),
        F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"),
        F.avg(hit).alias("positive_rate"),
        F.avg(F.when(F.col(label) == positive, hit)).alias("tpr"),
    )
    groups = df.select(group).where(F.col(group).isNotNull()).agg(
        F.min(group) < F.max(group)
    ).scalar()
    return table.where(groups).withColumn("small_group", F.col("n") < SMALL_GROUP)


def parity_summary(table: DataFrame) -> DataFrame:
    """``n_groups, sp_diff, di_ratio, eo_diff`` of a :func:`group_fairness` table.

    Groups below 50 rows are left out; with fewer than two large groups the measures are null.
    ``di_ratio`` is NaN if no group has a positive prediction.
    """
    large = F.col("n") >= SMALL_GROUP
    rate = F.when(large, F.col("positive_rate"))
    tpr = F.when(large, F.col("tpr"))
    sums = table.agg(
        F.count(rate).alias("n_groups"), F.max(rate).alias("hi"), F.min(rate).alias("lo"),
        F.count(tpr).alias("n_tpr"), F.max(tpr).alias("tpr_hi"), F.min(tpr).alias("tpr_lo"),
    )
    enough = F.col("n_groups") >= 2
    return sums.select(
        "n_groups",
        F.when(enough, F.col("hi") - F.col("lo")).alias("sp_diff"),
        F.when(
            enough,
            F.when(F.col("hi") > 0, F.col("lo") / F.col("hi")).otherwise(F.lit(float("nan"))),
        ).alias("di_ratio"),
        F.when(enough & (F.col("n_tpr") >= 2), F.col("tpr_hi") - F.col("tpr_lo")).alias("eo_diff"),
    )


def fairness_gap(
    df: DataFrame, label: str, prediction: str, group: str, metric: str = "dp"
) -> DataFrame:
    """One row ``gap``: largest minus smallest group mean of the prediction.

    ``dp`` takes all rows, ``eo`` those labelled 1.  Every group counts, however small, but a missing value is no group;
    with fewer than two groups the gap is 0.
    """
    _check_metric(metric)
    rows = df.where(F.col(group).isNotNull())
    rows = rows if metric == "dp" else rows.where(F.col(label) == 1)
    means = rows.groupBy(group).agg(F.avg(F.col(prediction).cast("double")).alias("m"))
    return means.agg(
        F.when(F.count("m") >= 2, F.max("m") - F.min("m")).otherwise(F.lit(0.0)).alias("gap")
    )


def _check_metric(metric: str) -> None:
    if metric not in ("dp", "eo"):
        raise ValueError(f"unknown fairness measure {metric!r}: dp compares all rows, eo the rows labelled 1")


# -- repair by rows ----------------------------------------------------------------------


def calibration_quotas(
    df: DataFrame, label: str | None, prediction: str, group: str, target_rate: float | None = None
) -> DataFrame:
    """``group, n, n_pos, desired, direction, quota, wrong_first`` per group.

    ``direction`` -1 takes positives away, +1 adds some.  ``quota`` is the number of rows to
    flip; ``wrong_first`` says that wrong predictions alone can supply them.
    """
    p = F.col(prediction)
    known = F.lit(None) if label is None else F.col(label)
    counts = df.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(p == 1).alias("n_pos"),
        F.count_if((p == 1) & (known == 0)).alias("false_pos"),
        F.count_if((p == 0) & (known == 1)).alias("false_neg"),
    )
    target = (
        df.agg(F.avg(p.cast("double"))).scalar() if target_rate is None else F.lit(float(target_rate))
    )
    n, n_pos = F.col("n"), F.col("n_pos")
    desired = F.bround(target * n).cast("bigint")
    rate = n_pos / n
    down, up = rate > target, rate < target
    table = counts.select(
        "*", desired.alias("desired"),
        F.when(down, F.lit(-1)).when(up, F.lit(1)).otherwise(F.lit(0)).alias("direction"),
        F.when(down, F.greatest(F.least(n_pos - desired, n_pos), F.lit(0)))
        .when(up, F.greatest(F.least(desired - n_pos, n - n_pos), F.lit(0)))
        .otherwise(F.lit(0)).cast("bigint").alias("quota"),
    )
    pool = F.when(F.col("direction") == -1, F.col("false_pos")).otherwise(F.col("false_neg"))
    return table.select(
        group, "n", "n_pos", "desired", "direction", "quota",
        ((F.col("quota") > 0) & (pool >= F.col("quota"))).alias("wrong_first"),
    )


def calibrate_rows(
    df: DataFrame, label: str | None, prediction: str, group: str, row_id: str | list[str],
    seed: int = 42, target_rate: float | None = None, output: str = "fair_prediction",
) -> DataFrame:
    """Flip just enough predictions of each group to bring it to the common positive rate.

    Reads the true label of the rows it changes: wrong predictions are flipped if they alone
    suffice.  With ``label=None`` rows are drawn from all predictions of the surplus class.
    Which rows are drawn depends on ``row_id`` and ``seed`` only.
    """
    quotas = calibration_quotas(df, label, prediction, group, target_rate)
    plan = quotas.select(group, "quota", "direction", "wrong_first")
    # One row per group; the optimizer measures it before it broadcasts it.
    marked = df.join(plan.drop("quota"), group, "left")
    p = F.col(prediction)
    surplus = F.when(F.col("direction") == -1, p == 1).otherwise(p == 0)
    known = F.lit(None) if label is None else F.col(label)
    wrong = F.coalesce(known == F.when(F.col("direction") == -1, 0).otherwise(1), F.lit(False))
    order = F.when(surplus & (wrong | ~F.col("wrong_first")), F.lit(0)).otherwise(F.lit(1))
    taken = take_per_group(marked, group, plan.select(group, "quota"), row_id, seed, order)
    return taken.select(
        *df.columns,
        F.when(F.col("taken"), F.when(F.col("direction") == -1, F.lit(0)).otherwise(F.lit(1)))
        .otherwise(p).cast("int").alias(output),
    )


# -- repair by leaves --------------------------------------------------------------------


def leaf_summary(
    df: DataFrame, leaf: str, group: str, label: str, prediction: str
) -> DataFrame:
    """``leaf_id, group, label, pred, n``: all that the repair by leaves needs of a table."""
    return df.groupBy(
        F.col(leaf).alias("leaf_id"), F.col(group).alias("group"),
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("pred"),
    ).agg(F.count("*").alias("n"))


def with_overrides(summary: DataFrame, overrides: dict[str, int]) -> DataFrame:
    """The summary after the predictions of some leaves were replaced."""
    return summary.withColumn("pred", _replaced(F.col("leaf_id"), F.col("pred"), overrides))


def override_scores(
    summary: DataFrame, base_errors: int, metric: str = "dp", fair_lambda: float = 1.0
) -> DataFrame:
    """``leaf_id, candidate, acc_drop, gap, gain, score`` of every other class for every leaf.

    A candidate changes the sums of its leaf only, so its group means are the current sums
    corrected by the leaf's part: leaves x classes x groups rows, not a second copy of the data.
    """
    _check_metric(metric)
    w = F.col("n") if metric == "dp" else F.when(F.col("label") == 1, F.col("n")).otherwise(0)
    per_group = summary.where("group IS NOT NULL").groupBy("group").agg(
        F.sum(w).alias("g_n"), F.sum(w * F.col("pred")).alias("g_pos")
    ).where(F.col("g_n") > 0)
    totals = summary.agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("pred") != F.col("label"), F.col("n")).otherwise(0)).alias("wrong")
    )
    n_rows = totals.select("n").scalar()
    wrong_now = totals.select("wrong").scalar()
    classes = summary.agg(F.array_sort(F.collect_set("label"))).scalar()

    # The current value of a leaf is its majority prediction; the smallest on a tie.
    votes = summary.groupBy("leaf_id", "pred").agg(F.sum("n").alias("n"))
    current = votes.groupBy("leaf_id").agg(F.min_by("pred", F.struct(-F.col("n"), F.col("pred"))).alias("value"))
    candidates = current.select("leaf_id", "value", F.explode(classes).alias("candidate")).where(
        F.col("candidate") != F.col("value")
    )
    # Errors of a leaf after the change, and its part of each group's sums.
    cells = summary.join(candidates, "leaf_id")
    errors = cells.groupBy("leaf_id", "candidate").agg(
        F.sum(F.when(F.col("pred") != F.col("label"), F.col("n")).otherwise(0)).alias("before"),
        F.sum(F.when(F.col("candidate") != F.col("label"), F.col("n")).otherwise(0)).alias("after"),
    )
    # Rows without a group count as errors, but change no group.
    parts = cells.groupBy("leaf_id", "candidate", "group").agg(
        F.sum(w * (F.col("candidate") - F.col("pred"))).alias("change")
    )
    # A leaf's candidates change some groups; the other groups keep their means.
    all_groups = per_group.agg(
        F.collect_list(F.struct("group", "g_n", "g_pos")).alias("all")
    ).scalar()
    changes = parts.groupBy("leaf_id", "candidate").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("group").isNotNull(), F.struct("group", "change")))).alias("delta")
    )
    means = F.transform(
        "groups",
        lambda g: (g["g_pos"] + F.coalesce(F.try_element_at("delta", g["group"]), F.lit(0))) / g["g_n"],
    )
    spread = F.when(F.size(means) >= 2, F.array_max(means) - F.array_min(means)).otherwise(F.lit(0.0))
    now_means = F.transform("groups", lambda g: g["g_pos"] / g["g_n"])
    now = F.when(F.size(now_means) >= 2, F.array_max(now_means) - F.array_min(now_means)).otherwise(F.lit(0.0))
    scored = errors.join(changes, ["leaf_id", "candidate"]).withColumn("groups", all_groups).select(
        "leaf_id", "candidate",
        ((wrong_now - F.col("before") + F.col("after") - F.lit(base_errors)) / n_rows).alias("acc_drop"),
        spread.alias("gap"), (now - spread).alias("gain"),
    )
    score = F.lit(float(fair_lambda)) * F.col("gain") / (F.greatest(F.col("acc_drop"), F.lit(0.0)) + F.lit(1e-12))
    return scored.withColumn("score", score)


def _replaced(leaf: Column, prediction: Column, overrides: dict[str, int]) -> Column:
    """The prediction, or the new one of the row's leaf: one look-up, however many leaves there are."""
    if not overrides:
        return prediction
    new = F.map_from_arrays(F.lit(list(overrides)), F.lit(list(overrides.values())))
    return F.coalesce(F.try_element_at(new, leaf), prediction)


@dataclass(frozen=True)
class LeafRepair:
    """New predictions of some leaves, and the calibration rows' state without and with them."""

    overrides: dict[str, int]
    metric: str
    gaps: tuple[float, float]
    errors: tuple[int, int]
    rows: int
    affected: int

    def apply(self, leaf: str, prediction: str) -> Column:
        """The repaired prediction of a row; leaves without an override keep theirs."""
        return _replaced(F.col(leaf), F.col(prediction), self.overrides)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            sorted(self.overrides.items()), "leaf_id string, new_prediction int"
        )

    def summary(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.metric, *self.gaps, len(self.overrides), self.affected, (self.errors[0] - self.errors[1]) / self.rows)],
            "metric string, base_gap double, final_gap double, changed_leaves int, "
            "affected_rows bigint, accuracy_delta double",
        )


def fit_leaf_repair(
    df: DataFrame, leaf: str, group: str, label: str, prediction: str, metric: str = "dp",
    fair_lambda: float = 1.0, acc_budget: float = 0.02,
) -> LeafRepair:
    """Replace leaf predictions one by one while the gap falls and accuracy stays in budget.

    Each round takes the (leaf, class) of largest gain per lost accuracy; the first leaf, then
    the smallest class wins a tie.  The table is read once, for its leaf summary; rounds work
    on the summary.  ``fair_lambda`` scales all scores alike and so never changes a choice.
    """
    _check_metric(metric)
    summary = leaf_summary(df, leaf, group, label, prediction).persist()
    try:
        wrong = F.sum(F.when(F.col("pred") != F.col("label"), F.col("n")).otherwise(0))
        n_rows, base_errors, n_groups = summary.agg(
            F.sum("n"), wrong, F.count_distinct("group")
        ).first()
        if not n_rows:
            raise ValueError("no rows to calibrate on")
        if n_groups > MAX_REPAIR_GROUPS:
            raise ValueError(f"{n_groups} groups (limit {MAX_REPAIR_GROUPS}); discretize the attribute")
        base_gap = final_gap = _summary_gap(summary, metric)
        overrides: dict[str, int] = {}
        while True:
            state = with_overrides(summary, overrides)
            allowed = override_scores(state, base_errors, metric, fair_lambda).where(
                (F.round("acc_drop", SCORE_DIGITS) <= acc_budget)
                & (F.round("gain", SCORE_DIGITS) > 0)
            )
            # Rounded parts, so that the order of summation cannot decide a near tie.
            ratio = F.round("gain", SCORE_DIGITS) / (F.greatest(F.round("acc_drop", SCORE_DIGITS), F.lit(0.0)) + F.lit(1e-12))
            best = allowed.orderBy(ratio.desc(), "leaf_id", "candidate").limit(1).collect()
            if not best:
                break
            overrides[best[0]["leaf_id"]] = best[0]["candidate"]
            final_gap = best[0]["gap"]
        state = with_overrides(summary, overrides)
        affected, errors = state.agg(
            F.sum(F.when(F.col("leaf_id").isin(list(overrides)), F.col("n")).otherwise(0)), wrong
        ).first()
        return LeafRepair(overrides, metric, (base_gap, final_gap), (base_errors, errors), n_rows, affected)
    finally:
        summary.unpersist()


def _summary_gap(summary: DataFrame, metric: str) -> float:
    rows = summary.where("group IS NOT NULL")
    rows = rows if metric == "dp" else rows.where(F.col("label") == 1)
    means = rows.groupBy("group").agg((F.sum(F.col("n") * F.col("pred")) / F.sum("n")).alias("m"))
    return means.agg(
        F.when(F.count("m") >= 2, F.max("m") - F.min("m")).otherwise(F.lit(0.0))
    ).first()[0]
