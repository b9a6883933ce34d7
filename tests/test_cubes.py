"""Counts from position cubes against matrix products and plain counting."""

import random

import pytest

from arborfair.functions.expressions import SCORE_DIGITS
from arborfair.operators import cells, cubes
from arborfair.operators.binarize import assemble
from arborfair.operators.cells import Cell, Order, cell_counts, with_gain, with_leaf_loss
from arborfair.operators.patterns import compact
from arborfair.session import Scratch


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([None, *range(9)]), rnd.random() * 4, rnd.choice([None, "a", "b", "c", "d"]), rnd.randrange(3)) for _ in range(400)]
    df = spark.createDataFrame([(None if a is None else float(a), *rest) for a, *rest in rows], "x double, z double, s string, y int")
    tests = assemble([("x", float(t) + 0.5) for t in range(8)] + [("z", t / 2) for t in range(1, 8)], {"s": ["a", "b", "c"]}, ["x", "z", "s"])
    return rows, df, tests


def holds(feature, row):
    value = dict(zip("xzs", row))[feature.column]
    if value is None:
        return False
    return value <= feature.threshold if feature.op == "<=" else value == feature.category


def frontier(rows, features, seed, n):
    """Random cells of up to four literals, with their true counts."""
    rnd = random.Random(seed)
    found = []
    for _ in range(n):
        lits = tuple(rnd.choice([1, -1]) * (f + 1) for f in rnd.sample(range(len(features)), rnd.randrange(5)))
        mine = [r for r in rows if all(holds(features[abs(x) - 1], r) == (x > 0) for x in lits)]
        found.append((Cell(lits, tuple(sum(r[3] == c for r in mine) for c in range(3)), 0), mine))
    return found


def test_boxes_equal_plain_counts(spark, table, monkeypatch):
    monkeypatch.setattr(cells, "PRODUCTS_PER_CUBE", 0)
    monkeypatch.setattr(cubes, "CELLS_PER_TASK", 7)
    monkeypatch.setattr(cubes, "CELLS_PER_STEP", 3)
    rows, df, tests = table
    features = sorted(tests.features, key=lambda f: f.fid)
    picked = frontier(rows, features, 3, 40)
    limits = [len(features) if i % 2 else 5 for i in range(len(picked))]
    with Scratch(spark) as scratch:
        p = compact(df, tests, "y", 3, scratch)
        left, work = cubes.plan(p, [c for c, _ in picked], *cells._candidate_lists([Order()] * 40, limits, len(features)))
        assert not left and work
        got = cell_counts(p, [c for c, _ in picked], [Order()] * 40, limits).collect()
    found = {(r["cell"], r["fid"]): r for r in got}
    assert len(found) == len(got)
    for i, (cell, mine) in enumerate(picked):
        for rank in range(limits[i]):
            if not mine:
                assert (i, rank) not in found
                continue
            r = found[i, rank]
            true = [x for x in mine if holds(features[rank], x)]
            assert r["rank"] == rank
            assert [r[f"t{c}"] for c in range(3)] == [sum(x[3] == c for x in true) for c in range(3)]
            assert [r[f"n{c}"] for c in range(3)] == list(cell.counts)


@pytest.mark.parametrize("entries", [1 << 18, 60])
def test_cubes_and_products_pick_alike(spark, table, monkeypatch, entries):
    """With few entries allowed some cells are counted by products, in the same call."""
    rows, df, tests = table
    picked = [c for c, _ in frontier(rows, sorted(tests.features, key=lambda f: f.fid), 5, 30)]
    size = len(tests.features)
    orders = [Order() if i % 3 else Order(list(range(size))[::-1]) for i in range(30)]
    with Scratch(spark) as scratch:
        p = compact(df, tests, "y", 3, scratch)

        def answers():
            everything = {tuple(r) for r in cell_counts(p, picked, orders, [size] * 30).collect()}
            best = []
            for pick, score in (("loss", lambda c: with_leaf_loss(c, 3, 400, 0.01)), ("gain", lambda c: with_gain(c, 3))):
                scored = score(cell_counts(p, picked, orders, [size] * 30, pick=pick)).collect()
                sign = 1 if pick == "loss" else -1
                winner = {}
                for r in scored:
                    key = (sign * round(r[pick], SCORE_DIGITS), r["rank"])
                    winner[r["cell"]] = min(winner.get(r["cell"], (key, r["fid"])), (key, r["fid"]))
                best.append(winner)
            return everything, best

        monkeypatch.setattr(cells, "PRODUCTS_PER_CUBE", 1 << 40)
        products = answers()
        monkeypatch.setattr(cells, "PRODUCTS_PER_CUBE", 0)
        monkeypatch.setattr(cubes, "CUBE_ENTRIES", entries)
        assert answers() == products
