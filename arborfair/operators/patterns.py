"""Rows that answer every binary test alike are one row with class counts.

All tests of one input column are determined by the position of its value between the sorted
thresholds, or among the categories.  A pattern row holds that position per column
(``k0, k1, ..``) and one count per class (``n0, n1, ..``).  Every learner on binary features is
exact on this table, and building it is the only shuffle over the full data that a fit needs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import plus, quoted, text_literal
from ..session import Scratch, spread
from .binarize import BinaryFeatures


@dataclass
class Patterns:
    df: DataFrame
    n_classes: int
    # Test ``fid`` is true where low <= k<column> <= high; one (column, low, high) per test.
    ranges: list[tuple[int, int, int]]
    class_counts: tuple[int, ...]
    minority: int
    n_patterns: int

    @property
    def n_features(self) -> int:
        return len(self.ranges)

    @property
    def n_rows(self) -> int:
        return sum(self.class_counts)

    @property
    def keys(self) -> list[str]:
        return [f"k{i}" for i in range(len({c for c, _, _ in self.ranges}))]

    @property
    def counts(self) -> list[str]:
        return [f"n{c}" for c in range(self.n_classes)]

    def holds(self, literals: tuple[int, ...]) -> str:
        """The condition of a cell as SQL text."""
        parts = []
        for lit in literals:
            column, low, high = self.ranges[abs(lit) - 1]
            test = f"k{column} BETWEEN {low} AND {high}"
            parts.append(f"({test})" if lit > 0 else f"NOT ({test})")
        return " AND ".join(parts) or "true"


@dataclass
class _Layout:
    """The tests of one input column, in the order of their thresholds."""

    column: str
    thresholds: list[tuple[float, int]] = field(default_factory=list)
    categories: list[tuple[str, int]] = field(default_factory=list)


def _layouts(features: BinaryFeatures) -> list[_Layout]:
    found: dict[tuple[str, str], _Layout] = {}
    for f in features.features:
        layout = found.setdefault((f.column, f.op), _Layout(f.column))
        if f.op == "<=":
            layout.thresholds.append((f.threshold, f.fid))
        else:
            layout.categories.append((f.category, f.fid))
    return list(found.values())


def positions(df: DataFrame, features: BinaryFeatures, keep: list[str]) -> tuple[DataFrame, list]:
    """``k0, k1, ..`` of every row, and the range of positions for which each test is true.

    For thresholds the position is the number of true tests: missing values pass none.  The
    built-in bucketizer finds it by binary search, so wide binarizations stay one call per column.
    """
    ranges: list = [None] * len(features)
    wide = df.selectExpr(*keep, *[quoted(c) for c in dict.fromkeys(f.column for f in features.features)])
    keys = []
    for i, layout in enumerate(_layouts(features)):
        if layout.thresholds:
            ordered = sorted(layout.thresholds)
            distinct = sorted({t for t, _ in ordered})
            size = len(distinct)
            for t, fid in ordered:
                ranges[fid] = (i, size - distinct.index(t), size)
            # Buckets are closed on the left; negated, x <= t becomes -x >= -t.
            splits = [-math.inf, *[-t + 0.0 for t in reversed(distinct)], math.inf]
            wide = wide.selectExpr("*", f"-nanvl(double({quoted(layout.column)}), NULL) + 0.0D AS _v{i}")
            wide = Bucketizer(
                splits=splits, inputCol=f"_v{i}", outputCol=f"_b{i}", handleInvalid="keep"
            ).transform(wide)
            keys.append(f"coalesce(int(if(_v{i} IS NULL, NULL, _b{i})), 0) AS k{i}")
        else:
            for j, (_, fid) in enumerate(layout.categories):
                ranges[fid] = (i, j + 1, j + 1)
            entries = ", ".join(f"{text_literal(c)}, {j + 1}" for j, (c, _) in enumerate(layout.categories))
            keys.append(f"coalesce(try_element_at(map({entries}), {quoted(layout.column)}), 0) AS k{i}")
    return wide.selectExpr(*keep, *keys), ranges


def minority_count(counts: list[str]) -> str:
    """Rows of a pattern that no tree on these features can get right (SQL text)."""
    most = f"greatest({', '.join(counts)})" if len(counts) > 1 else counts[0]
    return f"({plus(counts)} - {most})"


def compact(
    df: DataFrame, features: BinaryFeatures, label: str, n_classes: int, scratch: Scratch
) -> Patterns:
    """Group the table by its answers and count each class.  Labels are 0..n_classes-1."""
    source = spread(df.select(label, *dict.fromkeys(f.column for f in features.features)))
    placed, ranges = positions(source.withColumn("_y", F.col(label).cast("int")), features, ["_y"])
    keys = [c for c in placed.columns if c != "_y"]
    grouped = placed.groupBy(*keys).agg(
        *[F.expr(f"count_if(_y = {c}) AS n{c}") for c in range(n_classes)]
    )
    kept = scratch.keep(grouped, "patterns")
    counts = [f"n{c}" for c in range(n_classes)]
    row = kept.selectExpr(
        *[f"coalesce(sum({c}), 0L) AS {c}" for c in counts],
        f"coalesce(sum({minority_count(counts)}), 0L) AS minority", "count(*) AS n",
    ).first()
    return Patterns(kept, n_classes, ranges, tuple(row[:-2]), row[-2], row[-1])
