import itertools
import math

import numpy as np
import pytest

from arborfair.operators import fairness
from arborfair.sources.tables import FeatureSpec


def audited(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, p int, g string")


def sample(spark, seed=1, n=600):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = "abc"[int(rng.integers(0, 3))]
        p = int(rng.random() < {"a": 0.7, "b": 0.3, "c": 0.5}[g])
        rows.append((i, int(rng.random() < 0.5), p, g))
    return rows, audited(spark, rows)


def test_parity_needs_two_large_groups(spark):
    small = [(i, 1, 1, "a") for i in range(60)] + [(100 + i, 1, 0, "b") for i in range(49)]
    table = fairness.group_fairness(audited(spark, small), "y", "p", "g")
    assert {r["group"]: r["small_group"] for r in table.collect()} == {"a": False, "b": True}
    row = fairness.parity_summary(table).first()
    assert row["sp_diff"] is None and row["di_ratio"] is None and row["eo_diff"] is None
    assert fairness.group_fairness(audited(spark, small[:60]), "y", "p", "g").count() == 0


def test_zero_rates(spark):
    rows = [(i, 0, 0, "ab"[i % 2]) for i in range(120)]
    row = fairness.parity_summary(fairness.group_fairness(audited(spark, rows), "y", "p", "g")).first()
    assert row["sp_diff"] == 0 and math.isnan(row["di_ratio"]) and row["eo_diff"] is None


def test_gap(spark):
    df = audited(spark, [(1, 1, 1, "a"), (2, 1, 0, "a"), (3, 0, 1, "b")])
    assert fairness.fairness_gap(df, "y", "p", "g").first()[0] == 0.5
    assert fairness.fairness_gap(df, "y", "p", "g", "eo").first()[0] == 0.0  # one group has positives
    assert fairness.fairness_gap(df.where("g = 'a'"), "y", "p", "g").first()[0] == 0.0
    with pytest.raises(ValueError):
        fairness.fairness_gap(df, "y", "p", "g", "other")


@pytest.mark.parametrize("label,rate", [("y", None), (None, None), ("y", 0.9), ("y", 0.0)])
def test_calibration_reaches_the_rate(spark, label, rate):
    rows, df = sample(spark)
    fixed = {r["id"]: r for r in fairness.calibrate_rows(df, label, "p", "g", "id", 3, rate).collect()}
    assert len(fixed) == len(rows)
    target = rate if rate is not None else sum(r[2] for r in rows) / len(rows)
    for g in "abc":
        mine = [r for r in rows if r[3] == g]
        want = round(target * len(mine))
        assert sum(fixed[r[0]]["fair_prediction"] for r in mine) == want
        flips = [r for r in mine if fixed[r[0]]["fair_prediction"] != r[2]]
        assert len(flips) == abs(want - sum(r[2] for r in mine))
        wrong = [r for r in mine if r[2] != r[1] and r[2] == (flips[0][2] if flips else -1)]
        if label and len(wrong) >= len(flips):
            assert all(r[1] != r[2] for r in flips)
    again = fairness.calibrate_rows(df.repartition(5), label, "p", "g", "id", 3, rate).collect()
    assert {r["id"]: r["fair_prediction"] for r in again} == {i: r["fair_prediction"] for i, r in fixed.items()}


def brute_repair(rows, metric, budget):
    """rows: (leaf, group, y, p)."""
    def gap(pred):
        means = {}
        for (leaf, g, y, _), p in zip(rows, pred):
            if metric == "dp" or y == 1:
                means.setdefault(g, []).append(p)
        v = [np.mean(m) for m in means.values()]
        return max(v) - min(v) if len(v) > 1 else 0.0

    y = [r[2] for r in rows]
    pred = [r[3] for r in rows]
    base = np.mean(np.array(y) == np.array(pred))
    overrides, now = {}, gap(pred)
    while True:
        best = None
        for leaf, c in itertools.product(sorted({r[0] for r in rows}), sorted(set(y))):
            inside = [i for i, r in enumerate(rows) if r[0] == leaf]
            if c == np.bincount([pred[i] for i in inside]).argmax():
                continue
            trial = list(pred)
            for i in inside:
                trial[i] = c
            drop = base - np.mean(np.array(y) == np.array(trial))
            gain = now - gap(trial)
            if round(drop, 12) > budget or round(gain, 12) <= 0:
                continue
            score = gain / (max(drop, 0) + 1e-12)
            if best is None or score > best[0] * (1 + 1e-9):
                best = (score, leaf, c, trial)
        if best is None:
            return overrides, now
        overrides[best[1]], pred = best[2], best[3]
        now = gap(pred)


@pytest.mark.parametrize("seed,metric,budget", [(1, "dp", 0.1), (2, "eo", 0.2), (3, "dp", 0.0), (4, "dp", 0.4)])
def test_leaf_repair_equals_brute_force(spark, seed, metric, budget):
    rng = np.random.default_rng(seed)
    leaves = ["LL", "LR", "RL", "RR"]
    rows = []
    for _ in range(300):
        leaf = leaves[int(rng.integers(0, 4))]
        g = "ab"[int(rng.random() < 0.2 + 0.2 * leaves.index(leaf))]
        rows.append((leaf, g, int(rng.random() < 0.3 + 0.15 * leaves.index(leaf)), int(leaf > "LZ")))
    df = spark.createDataFrame(rows, "leaf string, g string, y int, p int")
    repair = fairness.fit_leaf_repair(df, "leaf", "g", "y", "p", metric, acc_budget=budget)
    want, gap = brute_repair(rows, metric, budget)
    assert repair.overrides == want
    assert repair.gaps[1] == pytest.approx(gap) and repair.gaps[1] <= repair.gaps[0]
    assert (repair.errors[0] - repair.errors[1]) / repair.rows >= -budget - 1e-12
    fixed = df.select("leaf", repair.apply("leaf", "p").alias("q")).distinct().collect()
    assert all(r["q"] == want.get(r["leaf"], int(r["leaf"] > "LZ")) for r in fixed)
    assert repair.affected == sum(r[0] in want for r in rows)


def test_a_missing_group_is_no_group(spark):
    rows = [("L", "a", 1, 1), ("L", None, 1, 0), ("R", "a", 0, 1), ("R", None, 0, 0)] * 30
    df = spark.createDataFrame(rows, "leaf string, g string, y int, p int")
    assert fairness.fairness_gap(df, "y", "p", "g").first()[0] == 0.0
    assert fairness.group_fairness(df, "y", "p", "g").count() == 0
    repair = fairness.fit_leaf_repair(df, "leaf", "g", "y", "p", "dp")
    assert repair.overrides == {} and repair.gaps == (0.0, 0.0) and repair.rows == 120
    more = df.unionAll(spark.createDataFrame([("L", "b", 1, 0), ("R", "b", 0, 1)] * 40, df.schema))
    assert fairness.fit_leaf_repair(more, "leaf", "g", "y", "p", "dp", acc_budget=1.0).gaps[0] == 0.5


def test_sensitive_groups(spark):
    df = spark.createDataFrame([(float(i),) for i in [1] * 50 + list(range(1, 13))], "a double")
    assert fairness.quartile_edges(df, "a", "distinct") == [1.0, 3.75, 6.5, 9.25, 12.0]
    names = {r[0] for r in df.select(fairness.sensitive_group(df, "a")).distinct().collect()}
    assert names == {"1-4", "4-6", "6-9", "9-12"}
    few = df.where("a < 5")
    assert {r[0] for r in few.select(fairness.sensitive_group(few, "a")).distinct().collect()} == {"1.0", "2.0", "3.0", "4.0"}
    assert fairness.drop_sensitive(FeatureSpec(["a", "b"], ["g"]), ["a", "g", "x"]).all == ["b"]
