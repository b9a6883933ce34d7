import brute
import numpy as np
import pytest

from arborfair.operators import cart
from arborfair.operators.binarize import fit_midpoints
from arborfair.operators.cart import fit_cart, fit_cart_on_tests


def data(seed, n=160, k=2, missing=True):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 12, n) / 2.0
    b = rng.integers(0, 5, n).astype(float)
    c = np.array([f"c{i}" for i in rng.integers(0, 5, n)], dtype=object)
    y = ((a > 3).astype(int) + (c == "c2") + (rng.random(n) < 0.2)) % k
    if missing:
        a[rng.random(n) < 0.1] = np.nan
        c[rng.random(n) < 0.1] = None
    return {"a": a, "b": b, "c": c}, y.astype(int)


def as_table(spark, rows, y, kind="int"):
    out = [(float(a), float(b), c, t.item()) for a, b, c, t in zip(rows["a"], rows["b"], rows["c"], y)]
    return spark.createDataFrame(out, f"a double, b double, c string, y {kind}")


@pytest.mark.parametrize("seed,k,bucket", [(1, 2, 1_000_000), (2, 2, 20), (3, 3, 1_000_000)])
def test_classification_equals_recursion(spark, seed, k, bucket):
    rows, y = data(seed, k=k)
    got = fit_cart(as_table(spark, rows, y), "y", ["a", "b"], ["c"], max_depth=3, min_samples_split=10,
                   min_samples_leaf=4, rows_per_bucket=bucket)
    want = brute.cart(rows, y, ["a", "b"], ["c"], brute.gini, 3, 10, 4, k)
    assert brute.from_cart(got) == want


@pytest.mark.parametrize("bucket", [1_000_000, 20])
def test_regression_equals_recursion(spark, bucket):
    rows, y = data(4)
    target = y * 10.0 + np.nan_to_num(rows["a"]) + 1e6
    got = fit_cart(as_table(spark, rows, target, "double"), "y", ["a", "b"], ["c"], task="regression",
                   max_depth=3, min_samples_split=10, min_samples_leaf=4, rows_per_bucket=bucket)
    want = brute.cart(rows, target, ["a", "b"], ["c"], brute.var, 3, 10, 4, 2)

    def same(a, b):
        assert a[0] == b[0]
        if a[0] == "leaf":
            assert a[1] == pytest.approx(b[1], rel=1e-12)
        else:
            assert a[1] == b[1]
            same(a[2], b[2])
            same(a[3], b[3])

    same(brute.from_cart(got), want)


def test_partitioning_does_not_matter(spark):
    rows, y = data(5)
    df = as_table(spark, rows, y)
    trees = [str(fit_cart(df.repartition(p), "y", ["a", "b"], ["c"], max_depth=3)) for p in (1, 7)]
    assert trees[0] == trees[1]


def test_missing_and_unseen_values_go_right(spark):
    rows, y = data(6, missing=False)
    tree = fit_cart(as_table(spark, rows, y), "y", ["a"], ["c"], max_depth=1, min_samples_leaf=1)
    right = next(n for n in tree.leaves if n.path == "R").prediction
    other = spark.createDataFrame([(None, "new"), (float("nan"), None)], "a double, c string")
    assert [r[0] for r in other.select(tree.predict()).collect()] == [right, right]


def test_stops(spark):
    rows, y = data(7)
    df = as_table(spark, rows, y)
    assert fit_cart(df, "y", ["a"], [], max_depth=0).num_leaves() == 1
    assert fit_cart(df, "y", ["a"], [], min_samples_split=10_000).num_leaves() == 1
    assert fit_cart(as_table(spark, rows, np.zeros(len(y), int)), "y", ["a"], [], n_classes=2).num_leaves() == 1
    with pytest.raises(ValueError):
        fit_cart(df, "y", ["a"], [], min_samples_leaf=0)
    with pytest.raises(ValueError):
        fit_cart(df, "y", ["a"], [], task="other")


def test_on_binary_tests_scores_raw_columns(spark):
    rows, y = data(8, missing=False)
    df = as_table(spark, rows, y)
    tree = fit_cart_on_tests(df, "y", ["a", "b"], ["c"], 50, max_depth=2, min_samples_leaf=4, min_samples_split=10)
    errors = df.where(tree.predict() != df["y"]).count()
    assert errors == len(y) - sum(
        max(c) for c in _leaf_counts(df, tree).values())


def _leaf_counts(df, tree):
    found = {}
    for r in df.select(tree.leaf_id().alias("l"), "y").groupBy("l", "y").count().collect():
        found.setdefault(r["l"], [0, 0])[r["y"]] = r["count"]
    return found


def test_inspection(spark):
    rows, y = data(9)
    tree = fit_cart(as_table(spark, rows, y), "y", ["a", "b"], ["c"], max_depth=2)
    assert tree.table(spark).where("prediction IS NOT NULL").count() == tree.num_leaves()
    assert tree.used_features()[0] == tree.nodes[""].feature
    assert set(tree.to_dict()) >= {"feature", "true", "false"}


@pytest.mark.parametrize("task, k", [("classification", 2), ("classification", 3), ("regression", 2)])
def test_tests_on_patterns_equal_cart_on_all_answers(spark, task, k):
    rows, y = data(11, n=300, k=k)
    df = as_table(spark, rows, y)
    options = dict(task=task, max_depth=3, min_samples_leaf=4, min_samples_split=10)
    tree = fit_cart_on_tests(df, "y", ["a", "b"], ["c"], 50, **options)
    tests = fit_midpoints(df, ["a", "b"], ["c"], 50)
    names = [f"t{i}" for i in range(len(tests))]
    wide = df.selectExpr("y", *[f"int({t}) AS {n}" for t, n in zip(tests.tests(), names)])
    want = fit_cart(wide, "y", names, [], **options)
    swap = str.maketrans("LR", "RL")
    assert {p: n.n for p, n in tree.nodes.items()} == {p.translate(swap): n.n for p, n in want.nodes.items()}
    for path, node in want.nodes.items():
        got = tree.nodes[path.translate(swap)]
        if node.is_leaf:
            assert got.prediction == pytest.approx(node.prediction) and got.impurity == pytest.approx(node.impurity)
        else:
            assert got.fid == int(node.feature[1:])


def test_tests_are_counted_on_patterns(spark, monkeypatch):
    """What a level reads grows with the distinct answers, not with the rows."""
    read = []
    whole = cart.collect_best_tests
    monkeypatch.setattr(cart, "collect_best_tests", lambda df, *rest: read.append(df.count()) or whole(df, *rest))
    rows, y = data(8, n=4000)
    fit_cart_on_tests(as_table(spark, rows, y), "y", ["a", "b"], ["c"], 3, max_depth=2)
    assert read and max(read) <= 4 * 4 * 6 * 2
