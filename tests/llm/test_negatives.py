"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborfair.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, angles string, n string"


def brute(rows, anchor, scale=256, positives=5, negatives=3):
    ok = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab, *_ in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in ok:
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in ok]
        for s, j, other in sorted(x for x in scored if x[2] == lab and x[1] != i)[:positives]:
            near = sorted(x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(near)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def check(spark, rows, **kw):
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0, **kw)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 5 == 0)


def vectors(seed, n, width, labels=4, spread=0.5):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(labels, width))
    return [(i, (centers[i % labels] + spread * rnd.normal(size=width)).tolist(), int(rnd.integers(labels))) for i in range(n)]


def test_random_vectors(spark):
    check(spark, vectors(1, 400, 8))


def test_many_passes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 7 * (4 * 6 + 4 * hard_negatives.REFERENCES + 200))
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", 20)
    check(spark, vectors(2, 300, 6, spread=0.05))


def test_ties_copies_and_odd_rows(spark):
    rnd = random.Random(4)
    rows = [(i, [float(rnd.randrange(-2, 3)) for _ in range(3)], rnd.randrange(3)) for i in range(120)]
    rows += [(200 + i, [1.0, 1.0, 1.0], i % 2) for i in range(60)]  # one vector many times
    rows += [(7, [1.0, 0.0, 2.0], 1)] * 2 + [(301, [], 1), (302, [1.0], 2), (303, [0.0, 0.0, 0.0], 0), (305, [0.0, 0.0, 0.0], 1)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (310, None, 1), (311, [1.0, None, 1.0], 1), (312, [1.0, float("nan"), 0.0], 1),
             (313, [float("inf"), 0.0, 0.0], 0), (315, [1.0, 2.0, 3.0], None), (320, [-1.0, -1.0, -1.0], 2)]
    check(spark, rows)


def test_large_components(spark):
    check(spark, [(i, [x * 1e5 for x in v], lab) for i, v, lab in vectors(5, 150, 5)])
    with pytest.raises(Exception, match="beyond 2"):
        hard_negatives.mine(table(spark, [(5, [1e12], 0), (6, [1.0], 0)]), F.col("vec_id") % 5 == 0).collect()


def test_no_rows_no_anchors(spark):
    assert hard_negatives.mine(table(spark, []), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives.mine(table(spark, [(1, [1.0], 0), (2, [1.0], 1)]), F.col("vec_id") % 5 == 0).collect() == []


def test_bounds_hold():
    rnd = np.random.default_rng(3)
    rows = np.floor(256 * rnd.normal(size=(500, 12))).astype(np.int32)
    refs = hard_negatives.References(rows[:100].astype(float), 12)
    norm = np.sqrt((rows.astype(float) ** 2).sum(1))
    angles = refs.angles(rows.astype(float), norm)
    a = hard_negatives.Anchors(np.arange(40), np.zeros(40), rows[:40], norm[:40], angles[:40], np.zeros((40, 1)), np.zeros((40, 1)), True, 1)
    for lo in range(0, 500, 25):
        s = rows[:40].astype(int) @ rows[lo:lo + 25].astype(int).T
        low, high = hard_negatives._bounds(a, norm[lo:lo + 25], angles[lo:lo + 25])
        assert (s.min(1) >= low).all() and (s.max(1) <= high).all()
