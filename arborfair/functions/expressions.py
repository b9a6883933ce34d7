"""Column expressions shared by the operators; all of them stay inside Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scores are compared after rounding, so a tie is decided by the documented order
# and never by the order in which floating-point sums were added up.
SCORE_DIGITS = 12


def is_missing(column: Column, dtype: T.DataType) -> Column:
    """Null, or NaN for floating-point columns (Spark sorts NaN above every number)."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def at_most(column: str, threshold: float) -> str:
    """``column <= threshold`` as SQL text; false for null and NaN."""
    value = f"{float(threshold)!r}D" if math.isfinite(threshold) else f"double('{float(threshold)!r}')"
    return f"coalesce(double({quoted(column)}) <= {value}, false)"


def is_category(column: str, category: str) -> str:
    """``column = category`` as SQL text; false for null and for a category never seen."""
    return f"coalesce({quoted(column)} = {text_literal(category)}, false)"


# The functions from here to ``information_gain`` take and return SQL text.  A score over many
# classes has hundreds of operators; as text it is parsed once instead of built call by call.


def plus(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def squares(counts: list[str]) -> str:
    """Sum of squared counts, as double because a squared count can pass the range of bigint."""
    return plus([f"double({c}) * double({c})" for c in counts])


def gini(counts: list[str]) -> str:
    """Gini impurity of a vector of class counts; 0 for an empty node."""
    n = f"double({plus(counts)})"
    return f"if({n} > 0, 1.0D - {squares(counts)} / ({n} * {n}), 0.0D)"


def variance(n: str, s: str, ss: str) -> str:
    """Population variance out of the count, the sum and the sum of squares."""
    return f"if({n} > 0, greatest({ss} / {n} - ({s} / {n}) * ({s} / {n}), 0.0D), 0.0D)"


def x_log_x(x: str) -> str:
    return f"if({x} > 0, {x} * log2({x}), 0.0D)"


def entropy(counts: list[str]) -> str:
    """Base-2 entropy of a vector of class counts; 0 for an empty node."""
    n = plus(counts)
    return f"if({n} > 0, log2({n}) - {plus([x_log_x(c) for c in counts])} / {n}, 0.0D)"


def information_gain(left: list[str], whole: list[str]) -> str:
    """Entropy of ``whole`` minus the size-weighted entropy of ``left`` and the rest.

    Written as sums of ``x log x`` over classes, so each count is used once.
    """
    right = [f"({w} - {l})" for w, l in zip(whole, left)]

    def spread(counts: list[str]) -> str:
        return f"({x_log_x(plus(counts))} - {plus([x_log_x(c) for c in counts])})"

    return f"({spread(whole)} - {spread(left)} - {spread(right)}) / {plus(whole)}"


def seeded_hash(row_id: str | list[str], seed: int) -> Column:
    """A reproducible pseudo-random order of rows that no partitioning can change."""
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))
