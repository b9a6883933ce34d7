"""Binary features: numeric threshold tests and one-hot category tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import at_most, is_category
from ..functions.ranks import ROWS_PER_BUCKET, bucket_edges, long_values, midpoint, running_sums
from ..session import spread

# Every category becomes a feature of the model, so an identifier column must not get here.

FEATURE_SCHEMA = "fid int, column string, op string, threshold double, category string, name string"


@dataclass(frozen=True)
class BinaryFeature:
    fid: int
    column: str
    op: str
    threshold: float | None
    category: str | None
    name: str

    def test(self) -> str:
        """The condition as SQL text; false for null, NaN and unseen categories."""
        if self.op == "<=":
            return at_most(self.column, self.threshold)
        return is_category(self.column, self.category)


class BinaryFeatures:
    """The ordered tests of a fitted binarizer."""

    def __init__(self, features: list[BinaryFeature], inputs: list[str],
                 values: dict[str, list[float]] | None = None):
        self.features = features
        self.inputs = inputs
        self.values = values or {}

    def __len__(self) -> int:
        return len(self.features)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    def tests(self) -> list[str]:
        return [f.test() for f in self.features]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(f.fid, f.column, f.op, f.threshold, f.category, f.name) for f in self.features]
        return spark.createDataFrame(rows, FEATURE_SCHEMA)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` plus one 0/1 column per feature, named as the feature is."""
        return df.select(*keep, *[F.expr(f.test()).cast("int").alias(f.name) for f in self.features])

    def feature_map(self) -> dict[int, list[int]]:
        """Position of each input column -> the binary features made from it."""
        found: dict[int, list[int]] = {}
        for f in self.features:
            found.setdefault(self.inputs.index(f.column), []).append(f.fid)
        return found

    def inverse(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Numeric values read back from the 0/1 columns of :meth:`transform`.

        The value that belongs to the first true threshold, else the largest one kept.
        """
        columns = []
        for column, values in self.values.items():
            tests = [f for f in self.features if f.column == column]
            back = F.lit(values[-1]) if values else F.lit(None).cast("double")
            for f, value in reversed(list(zip(tests, values))):
                back = F.when(F.col(f"`{f.name}`") == 1, F.lit(value)).otherwise(back)
            columns.append(back.alias(column))
        return df.select(*keep, *columns)


def kept_values(
    df: DataFrame, numeric: list[str], max_thresholds: int = 50,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``column, rank, value, threshold``: the distinct values kept per column, with midpoints.

    Columns with more than ``max_thresholds + 1`` distinct values keep that many of them, at
    evenly spaced ranks ``floor(i * (n - 1) / max_thresholds)``.  ``max_thresholds=0`` keeps all.
    The last value of a column has no threshold.
    """
    edges = bucket_edges(df, numeric, df.count(), rows_per_bucket)
    df = spread(df.select(*numeric))
    distinct = (
        long_values(df, numeric, edges, [])
        .groupBy("feature", "bucket", "value").agg(F.lit(1).alias("one"))
    )
    bucketed = any(edges.values())
    rows_kept = running_sums(distinct, ["feature"], "value", ["one"], bucketed, with_total=True)
    r, n = F.col("cum_one") - 1, F.col("all_one")
    if max_thresholds:
        m, last = max_thresholds, F.greatest(n - 1, F.lit(1))
        step = F.ceil(r * m / last).cast("long")
        on_grid = (n <= m + 1) | (F.floor(step * last / m) == r)
        rows_kept = rows_kept.where(on_grid)
    # At most max_thresholds + 1 rows per column are left here.
    order = Window.partitionBy("feature").orderBy("value")
    names = F.array(*[F.lit(c) for c in numeric])
    return rows_kept.select(
        F.get(names, F.col("feature")).alias("column"),
        F.col("feature"),
        (F.row_number().over(order) - 1).cast("int").alias("rank"),
        "value",
        F.lead("value").over(order).alias("next"),
    ).selectExpr("column", "feature", "rank", "value", f"{midpoint('value', 'next')} AS threshold")


def vocabulary(df: DataFrame, categorical: list[str]) -> DataFrame:
    """``column, category``: the distinct non-null strings of each column."""
    if not categorical:
        raise ValueError("no categorical columns given")
    cells = [F.struct(F.lit(i).alias("feature"), F.lit(c).alias("column"),
                      F.col(c).cast("string").alias("category")) for i, c in enumerate(categorical)]
    return (
        df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
        .where(F.col("category").isNotNull()).distinct()
    )


def collect_vocabulary(df: DataFrame, categorical: list[str]) -> dict[str, list[str]]:
    if not categorical:
        return {}
    words = vocabulary(df, categorical)
    rows = words.collect()  # each is a feature of the model
    found: dict[str, list[str]] = {c: [] for c in categorical}
    for r in rows:
        found[r["column"]].append(r["category"])
    return {c: sorted(v) for c, v in found.items()}


def assemble(
    thresholds: list[tuple[str, float]], categories: dict[str, list[str]], inputs: list[str],
    values: dict[str, list[float]] | None = None, digits: int | None = None,
) -> BinaryFeatures:
    """Number the tests: thresholds first, then categories."""
    features: list[BinaryFeature] = []
    for column, t in thresholds:
        shown = f"{t}" if digits is None else f"{t:.{digits}f}"
        features.append(BinaryFeature(len(features), column, "<=", float(t), None, f"{column} <= {shown}"))
    for column, words in categories.items():
        for word in words:
            features.append(BinaryFeature(len(features), column, "=", None, word, f"{column}={word}"))
    return BinaryFeatures(features, inputs, values)


def fit_midpoints(
    df: DataFrame, numeric: list[str], categorical: list[str], max_thresholds: int = 50,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> BinaryFeatures:
    """Midpoints between neighbouring kept values, and all categories."""
    values: dict[str, list[float]] = {c: [] for c in numeric}
    thresholds: list[tuple[str, float]] = []
    if numeric:
        table = kept_values(df, numeric, max_thresholds, rows_per_bucket)
        for r in sorted(table.collect(), key=lambda r: (r["feature"], r["rank"])):
            values[r["column"]].append(r["value"])
            if r["threshold"] is not None:
                thresholds.append((r["column"], r["threshold"]))
    return assemble(
        thresholds, collect_vocabulary(df, categorical), [*numeric, *categorical], values
    )
