"""Boosted trees against plain boosting that tries every boundary."""

import math

import numpy as np
import pytest

from arborfair.operators import boosting
from arborfair.operators.boosting import Booster, boost
from arborfair.operators.stumps import eliminate, fit_stump_thresholds
from arborfair.session import Scratch


def _cuts(values):
    known = sorted({v for v in values if not math.isnan(v)})
    for low, high in zip(known, known[1:]):
        half = (low + high) / 2
        yield low if half >= high else half


def plain_boost(x, y, w, n_classes, rounds, rate, depth, allowed=None):
    """Splits of each round's trees, node by node, and the final margins."""
    n, n_trees = len(y), 1 if n_classes == 2 else n_classes
    share = [w[y == c].sum() / w.sum() for c in range(n_classes)]
    margin = np.array([[math.log(share[1] / share[0])] * n] if n_classes == 2 else [[math.log(s)] * n for s in share])
    out = []
    for _ in range(rounds):
        if n_trees == 1:
            p, hit = 1 / (1 + np.exp(-margin)), (y == 1)[None]
        else:
            e = np.exp(margin)
            p, hit = e / e.sum(axis=0), y[None] == np.arange(n_classes)[:, None]
        g, h = hit - p, p * (1 - p)
        trees = []
        for t in range(n_trees):
            splits = []

            def grow(rows, left_depth, g=g[t], h=h[t], t=t):
                def worth(mask):
                    return (w[mask] * g[mask]).sum() ** 2 / w[mask].sum()

                best = None
                if left_depth and w[rows].sum() > 1:
                    for f in range(len(x)) if allowed is None else allowed:
                        for cut in _cuts(x[f][rows]):
                            left = rows[x[f][rows] <= cut]
                            right = np.setdiff1d(rows, left)
                            gain = worth(left) + worth(right) - worth(rows)
                            if gain > 1e-12 * w[rows].sum() and (best is None or gain > best[0] + 1e-9):
                                best = (gain, f, cut, left, right)
                if best is None:
                    k = (n_trees - 1) / n_trees if n_trees > 1 else 1.0
                    margin[t][rows] += rate * k * (w[rows] * g[rows]).sum() / (w[rows] * h[rows]).sum()
                    return
                splits.append((best[1], best[2]))
                grow(best[3], left_depth - 1)
                grow(best[4], left_depth - 1)

            grow(np.arange(n), depth)
            trees.append(sorted(splits))
        out.append(trees)
    return out, margin


def _data(seed, n, n_classes):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 6, n).astype(float), np.round(rng.random(n), 2)
    c[rng.random(n) < 0.15] = math.nan
    signal = a + 0.4 * b + np.where(np.isnan(c), 0.7, c) + rng.normal(size=n) * 0.6
    return [a, b, c], np.digitize(signal, np.quantile(signal, [i / n_classes for i in range(1, n_classes)]))


def _table(spark, x, y):
    rows = [(int(l), *(None if math.isnan(v) and i % 2 else float(v) for v in r)) for i, (l, *r) in enumerate(zip(y, *x))]
    return spark.createDataFrame(rows, "y int, a double, b double, c double")


@pytest.mark.parametrize("n_classes, depth, buckets", [(2, 1, 4), (2, 3, 4), (3, 1, 8), (3, 2, 1024)])
def test_equals_plain_boosting(spark, n_classes, depth, buckets):
    x, y = _data(n_classes * 10 + depth, 160, n_classes)
    rounds = 4
    with Scratch(spark) as scratch:
        model = boost(_table(spark, x, y), "y", ["a", "b", "c"], n_classes, scratch, rounds, 0.3, depth, buckets)
    wanted, margin = plain_boost(x, y, np.ones(len(y)), n_classes, rounds, 0.3, depth)
    assert [[sorted(tree.splits) for tree in trees] for trees in model.rounds] == wanted
    assert np.allclose(model.margins(x), margin, atol=1e-6)


def test_partitions_and_buckets_change_nothing(spark):
    x, y = _data(5, 400, 2)
    df, found = _table(spark, x, y), []
    for parts, buckets in ((1, 1024), (7, 3), (3, 40)):
        with Scratch(spark) as scratch:
            found.append(boost(df.repartition(parts), "y", ["a", "b", "c"], 2, scratch, 6, 0.5, 2, buckets).rounds)
    assert found[0] == found[1] == found[2]


def test_opened_buckets_become_finer(spark, monkeypatch):
    x, y = _data(8, 500, 2)
    opened, inner = [], Booster._inner

    def counted(self, model, trees, level, buckets):
        opened.append(len(buckets))
        return inner(self, model, trees, level, buckets)

    monkeypatch.setattr(Booster, "_inner", counted)
    with Scratch(spark) as scratch:
        boost(_table(spark, x, y), "y", ["a", "b", "c"], 2, scratch, 12, 0.1, 1, 4)
    assert opened and len(opened) < 12  # once split, most rounds need no second pass


def test_passes_read_cells_and_opened_rows(spark, monkeypatch):
    """Rows that agree in all buckets are read as one; of the others only those of opened buckets."""
    rng = np.random.default_rng(4)
    a, b = rng.random(6000), rng.integers(0, 5, 6000)
    y = (a + 0.05 * b > 0.6).astype(int)
    a[:40], a[40:80], a[80:120] = math.nan, math.inf, -math.inf
    df = spark.createDataFrame([(int(t), float(v), float(k)) for t, v, k in zip(y, a, b)], "y int, a double, b double")
    read, table, found = [], Booster._table, []
    monkeypatch.setattr(Booster, "_table", lambda self: read.append(table(self).count()) or table(self))
    monkeypatch.setattr(boosting, "MOST_ASIDE", 1)
    for small in (boosting.SMALL_ROWS, 0):
        monkeypatch.setattr(boosting, "SMALL_ROWS", small)
        read.clear()
        for depth in (1, 2):
            with Scratch(spark) as scratch:
                found.append(boost(df, "y", ["a", "b"], 2, scratch, 4, 0.3, depth, 64).rounds)
            if depth == 1:
                assert len(read) == 4 and (max(read) < 3000 and read[0] <= 66 * 5 * 2) == (small == 0)
    assert found[:2] == found[2:]


def test_degenerate_tables(spark):
    schema = "y int, a double"
    for rows in ([], [(1, 1.0), (1, 2.0)], [(0, None), (1, None)], [(0, 3.0), (1, 3.0)], [(None, 1.0), (None, 2.0)]):
        assert fit_stump_thresholds(spark.createDataFrame(rows, schema), "y", ["a"], [], 2, 3, column_elimination=True).names == []
    far = spark.createDataFrame([(0, float("-inf")), (0, -1.0), (1, 1.0), (1, float("inf")), (1, float("nan")), (None, 0.0)], schema)
    assert [f.threshold for f in fit_stump_thresholds(far, "y", ["a"], [], 2, 1).features] == [0.0]
    with pytest.raises(ValueError):
        fit_stump_thresholds(far, "y", ["a"], [], 2, max_depth=0)


def test_whole_sums_beyond_doubles():
    values = np.array([2**52 + 1, 3, -(2**51) - 7, 2**52 + 5], np.int64)
    assert boosting._whole_sums(np.array([0, 0, 1, 0]), values, 2).tolist() == [2**53 + 9, -(2**51) - 7]


def plain_eliminate(bits, y, w, tests, n_classes, rounds, rate):
    """Every model fitted anew."""
    left, score, base, dropped = list(range(len(tests))), math.inf, None, None

    def fit():
        splits, margin = plain_boost(bits, y, w, n_classes, rounds, rate, 1, left)
        said = (margin[0] >= 0).astype(int) if n_classes == 2 else margin.argmax(axis=0)
        return splits, (w * (said == y)).sum()

    def gains(rounds_of):
        sums, n_trees = dict.fromkeys(left, 0.0), 1 if n_classes == 2 else n_classes
        for upto, trees in enumerate(rounds_of):
            _, margin = plain_boost(bits, y, w, n_classes, upto, rate, 1, left)
            e = np.exp(margin)
            p = 1 / (1 + np.exp(-margin)) if n_trees == 1 else e / e.sum(axis=0)
            for t, splits in enumerate(trees):
                g = w * ((y == (1 if n_trees == 1 else t)) - p[t])
                for f, cut in splits:
                    a = bits[f] <= cut
                    sums[f] += g[a].sum() ** 2 / w[a].sum() + g[~a].sum() ** 2 / w[~a].sum() - g.sum() ** 2 / w.sum()
        return sums

    splits, base = fit()
    for _ in range(len(tests) - 1):
        if score < base:
            break
        sums = gains(splits)
        dropped = min(left, key=lambda i: (sums[i], i))
        left.remove(dropped)
        splits, score = fit()
    return [tests[i] for i in left] + [tests[dropped]]


@pytest.mark.parametrize("n_classes", [2, 3])
def test_elimination_equals_fitting_each_model_anew(spark, monkeypatch, n_classes):
    x, y = _data(n_classes, 150, n_classes)
    tests = [("a", -0.31), ("a", 0.57), ("b", 1.5), ("b", 3.5), ("c", 0.405), ("c", 0.7)]
    bits = [np.where(x["abc".index(c)] <= t, 0.0, 1.0) for c, t in tests]
    fitted, one = [], Booster._round
    monkeypatch.setattr(Booster, "_round", lambda self, model, allowed: fitted.append(len(allowed)) or one(self, model, allowed))
    with Scratch(spark) as scratch:
        got = eliminate(_table(spark, x, y), "y", tests, n_classes, scratch, 5, 0.4)
    assert got == plain_eliminate(bits, y, np.ones(len(y)), tests, n_classes, 5, 0.4)
    assert fitted.count(6) == 5 and fitted.count(5) < 5  # rounds before the first use of the dropped test are kept
