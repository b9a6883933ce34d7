import brute
import numpy as np
import pytest

from arborfair.operators.binarize import assemble
from arborfair.operators.cells import Cell, Order, cell_counts
from arborfair.operators.exact import SearchTooLarge
from arborfair.operators.lookahead import greedy_tree, lookahead_tree, optimal_tree
from arborfair.operators.patterns import compact
from arborfair.operators.rollout import rollout_tree
from arborfair.operators.tree import tree_objective
from arborfair.operators.treeset import near_optimal_trees
from arborfair.session import Scratch

REG = 0.01


def planted(seed, n=180, f=7, k=2):
    rng = np.random.default_rng(seed)
    X = rng.random((n, f)) < 0.5
    X[:, f - 1] = True  # constant
    X[:, f - 2] = X[:, 0]  # a copy
    y = ((X[:, 1] ^ X[:, 2]).astype(int) + X[:, 3]) % k
    flip = rng.random(n) < 0.15
    return X, np.where(flip, rng.integers(0, k, n), y)


def as_table(spark, X, y):
    """Each boolean becomes a 0/1 column whose only test is ``<= 0.5``, so x is its negation."""
    names = [f"x{i}" for i in range(X.shape[1])]
    rows = [(*[0.0 if v else 1.0 for v in row], int(t)) for row, t in zip(X, y)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", y int")
    return df, assemble([(c, 0.5) for c in names], {}, names)


@pytest.mark.parametrize("seed,k,top", [(1, 2, 0), (2, 3, 0), (3, 2, 4)])
def test_greedy_equals_recursion(spark, seed, k, top):
    X, y = planted(seed, k=k)
    df, tests = as_table(spark, X, y)
    for budget in (1, 2, 4):
        got = greedy_tree(df, "y", tests, k, budget, REG, top)
        want = brute.greedy(X, y, k, budget, REG, len(y), top)
        assert brute.shape(brute.from_tree(got)) == brute.shape(want)
        assert got.objective == brute.loss(want, len(y), REG)


@pytest.mark.parametrize("seed,k,depth,top", [(4, 2, 2, 0), (5, 2, 3, 0), (6, 3, 2, 0), (7, 2, 3, 4), (8, 2, 0, 0), (8, 2, 1, 0)])
def test_optimal_equals_enumeration(spark, seed, k, depth, top):
    X, y = planted(seed, k=k)
    df, tests = as_table(spark, X, y)
    got = optimal_tree(df, "y", tests, k, depth, REG, top)
    want = brute.optimal(X, y, k, depth, REG, len(y), top)
    assert got.objective == brute.loss(want, len(y), REG)
    assert brute.shape(brute.from_tree(got)) == brute.shape(want)


@pytest.mark.parametrize("seed,lookahead,budget,fill", [(9, 2, 4, "optimal"), (10, 1, 3, "greedy"), (11, 2, 2, "optimal"), (12, 2, 5, "greedy"), (9, 2, 0, "optimal"), (10, 1, 0, "optimal"), (11, 2, 0, "greedy")])
def test_lookahead_equals_recursion(spark, seed, lookahead, budget, fill):
    X, y = planted(seed)
    n = len(y)
    df, tests = as_table(spark, X, y)
    got = lookahead_tree(df, "y", tests, 2, lookahead, budget, REG, fill)
    prefix = brute.optimal(X, y, 2, lookahead, REG, n, remaining=max(budget - lookahead, 0))
    assert got.info["prefix_objective"] == brute.loss(prefix, n, REG)

    def refill(t, X, y, depth):
        if t[0] == "leaf":
            left = budget - depth if budget else 1
            return brute.optimal(X, y, 2, left, REG, n) if fill == "optimal" else brute.greedy(X, y, 2, left, REG, n)
        x = X[:, t[1]]
        return ("split", t[1], refill(t[2], X[x], y[x], depth + 1), refill(t[3], X[~x], y[~x], depth + 1))

    want = refill(prefix, X, y, 0) if budget > lookahead or not budget else prefix
    assert brute.shape(brute.from_tree(got)) == brute.shape(want)
    assert got.objective == brute.loss(want, n, REG)
    assert got.objective <= got.info["prefix_objective"]


@pytest.mark.parametrize("seed,budget,top", [(13, 3, 0), (14, 4, 4), (15, 1, 0)])
def test_rollout_equals_recursion(spark, seed, budget, top):
    X, y = planted(seed)
    df, tests = as_table(spark, X, y)
    got = rollout_tree(df, "y", tests, 2, budget, REG, top)
    want = brute.rollout(X, y, 2, budget, REG, len(y), top)
    assert brute.shape(brute.from_tree(got)) == brute.shape(want)
    assert got.objective == brute.loss(want, len(y), REG)


def test_xor_needs_the_exact_search(spark):
    rng = np.random.default_rng(0)
    X = rng.random((200, 4)) < 0.5
    y = (X[:, 0] ^ X[:, 1]).astype(int)
    df, tests = as_table(spark, X, y)
    assert optimal_tree(df, "y", tests, 2, 2, REG).objective == pytest.approx(4 * REG)
    assert optimal_tree(df, "y", tests, 2, 1, REG).objective > 0.3


def test_tree_set(spark):
    X, y = planted(16)
    df, tests = as_table(spark, X, y)
    found = near_optimal_trees(df, "y", tests, 2, 2, 4, REG, tolerance=0.2, n_prefixes=6)
    shapes = [brute.shape(brute.from_tree(t)) for t in found.trees]
    assert len(found) == len(set(shapes)) >= 1
    objectives = [found.objective(i) for i in range(len(found))]
    assert objectives == sorted(objectives)
    assert objectives[-1] <= objectives[0] * 1.2
    for t in found.trees:
        assert tree_objective(df, t, "y", REG).first()["objective"] == pytest.approx(t.objective)
    with pytest.raises(IndexError):
        found.predict(len(found))
    again = near_optimal_trees(df.repartition(7), "y", tests, 2, 2, 4, REG, tolerance=0.2, n_prefixes=6)
    assert [brute.shape(brute.from_tree(t)) for t in again.trees] == shapes


def test_grouped_and_arrow_counts_agree(spark):
    X, y = planted(17, k=3)
    df, tests = as_table(spark, X, y)
    with Scratch(spark) as scratch:
        p = compact(df, tests, "y", 3, scratch)
        cells = [Cell((1, -3), (0, 0, 0), 0), Cell((-1, 4), (0, 0, 0), 0), Cell((-1, -4, 2), (0, 0, 0), 0)]
        args = (p, cells, [Order(), Order([5, 2, 0]), Order()], [7, 2, 4])
        grouped = {tuple(r) for r in cell_counts(*args, disjoint=True).collect()}
        arrow = {tuple(r) for r in cell_counts(*args).collect()}
        assert grouped == arrow
        inside = X[:, 0] & ~X[:, 2]
        want = [int((inside & X[:, 1] & (y == c)).sum()) for c in range(3)]
        row = next(r for r in arrow if r[0] == 0 and r[1] == 1)
        assert list(row[3:6]) == want


def test_many_cells_are_counted_in_several_scans(spark, monkeypatch):
    from arborfair.operators import cells as module

    X, y = planted(18)
    df, tests = as_table(spark, X, y)
    want = optimal_tree(df, "y", tests, 2, 3, REG).to_dict()
    monkeypatch.setattr(module, "COUNTERS_PER_SCAN", 60)
    assert optimal_tree(df, "y", tests, 2, 3, REG).to_dict() == want


def test_guards(spark):
    X, y = planted(19)
    df, tests = as_table(spark, X, y)
    with pytest.raises(SearchTooLarge):
        optimal_tree(df, "y", tests, 2, 3, 0.0001, max_cells=5)
    with pytest.raises(ValueError):
        lookahead_tree(df, "y", tests, 2, lookahead=0)
    with pytest.raises(ValueError):
        lookahead_tree(df, "y", tests, 2, lookahead=3, budget=2)
    with pytest.raises(ValueError):
        lookahead_tree(df, "y", tests, 2, leaf_fill="other")


def test_rows_fall_into_one_leaf_and_losses_add_up(spark):
    X, y = planted(20)
    df, tests = as_table(spark, X, y)
    tree = optimal_tree(df, "y", tests, 2, 2, REG)
    rows = {r["leaf"]: r["count"] for r in df.select(tree.leaf_id().alias("leaf")).groupBy("leaf").count().collect()}
    assert sum(rows.values()) == len(y)
    assert {n.path: n.n for n in tree.leaves} == rows
    assert sum(n.loss for n in tree.leaves) + REG * tree.num_leaves() == pytest.approx(tree.objective)


@pytest.mark.parametrize("name,learner", [
    ("optimal_depth3_tree", "optimal_tree"), ("lookahead_tree_nodes", "lookahead_tree"), ("lookahead_tree_greedy_fill", "lookahead_tree"),
    ("rollout_tree_nodes", "rollout_tree"), ("near_optimal_set", "near_optimal_trees")])
def test_registered_learners_try_all_tests(spark, monkeypatch, name, learner):
    from arborfair import queries
    from arborfair.operators.binarize import fit_midpoints

    class Called(Exception):
        pass

    def stop(df, label, features, n_classes, max_features=0, **rest):
        raise Called(features.names, max_features)

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, learner, stop)
    with pytest.raises(Called) as called:
        queries.QUERIES[name](spark, sf)
    want = fit_midpoints(queries.lines(spark, sf), queries.LINE_NUMERIC, queries.LINE_CATEGORICAL)
    assert called.value.args == (want.names, 0)


@pytest.mark.parametrize("seed,k,depth", [(31, 2, 3), (32, 3, 2), (33, 2, 4)])
def test_greedy_bound_opens_fewer_cells(spark, seed, k, depth):
    """A coarse penalty and few patterns: many cells cannot win.  The tree is that of the search without the bound."""
    X, y = planted(seed, n=160, f=6, k=k)
    df, tests = as_table(spark, X, y)
    reg = 0.03
    want = brute.optimal(X, y, k, depth, reg, len(y), 0)
    plain, bound = (optimal_tree(df, "y", tests, k, depth, reg, greedy_bound=b) for b in (False, True))
    for tree in (plain, bound):
        assert tree.objective == brute.loss(want, len(y), reg)
        assert brute.shape(brute.from_tree(tree)) == brute.shape(want)
    assert sum(bound.info["opened"]) <= sum(plain.info["opened"])
    every = sum(_cells_of_level(6, level) for level in range(depth))
    assert sum(plain.info["opened"]) < every


def _cells_of_level(n_features, level):
    """Sets of ``level`` literals on different tests."""
    from math import comb

    return comb(n_features, level) * 2 ** level


def test_tree_set_without_depth_limit(spark):
    X, y = planted(34)
    df, tests = as_table(spark, X, y)
    found = near_optimal_trees(df, "y", tests, 2, 2, 0, REG, tolerance=0.2, n_prefixes=6)
    closed = near_optimal_trees(df, "y", tests, 2, 2, 2, REG, tolerance=0.2, n_prefixes=6)
    shapes = [[brute.shape(brute.from_tree(t)) for t in s.trees] for s in (found, closed)]
    assert len(found) >= 1 and shapes[0] == shapes[1]  # the prefixes themselves
    for t in found.trees:
        assert tree_objective(df, t, "y", REG).first()["objective"] == pytest.approx(t.objective)
