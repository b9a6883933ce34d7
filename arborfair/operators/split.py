"""Seeded, stratified, exact train / test split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import take_per_group
from ..session import Scratch

# Classes whose counts are held as a local table.
LISTED_COUNTS = 10_000


def quotas_by_class(counts: DataFrame, key: str, test_size: float, rows: int) -> DataFrame:
    """``key, quota`` of a table ``key, count`` with ``rows`` in all: the floor of each class's share, then one row more for
    the largest remainders, ties by class.

    Classes with equal counts have equal remainders, so the cut is found in the small table of distinct counts; only
    the classes with the remainder at the cut are put in order.
    """
    n_test = math.ceil(test_size * rows)
    share = F.lit(n_test) * F.col("count") / F.lit(rows)
    shares = counts.select(key, F.floor(share).alias("least"), F.round(share - F.floor(share), 12).alias("rest"))
    by_rest = shares.groupBy("rest").agg(F.count("*").alias("classes"), F.sum("least").alias("least"))
    spare = n_test - (by_rest.agg(F.sum("least")).first()[0] or 0)
    upto = Window.orderBy(F.desc("rest"))  # a row per distinct remainder
    cut = by_rest.select("rest", "classes", F.sum("classes").over(upto).alias("upto")).where(
        F.col("upto") >= spare).orderBy("upto").limit(1).collect() if spare else []
    if not cut:
        return shares.select(key, F.col("least").alias("quota"))
    at, left = cut[0]["rest"], spare - (cut[0]["upto"] - cut[0]["classes"])
    above = F.col("rest") > at
    if left == cut[0]["classes"]:
        return shares.select(key, (F.col("least") + (F.col("rest") >= at).cast("int")).alias("quota"))
    first = shares.where(F.col("rest") == at).orderBy(key).limit(left).select(F.col(key).alias("_first"), F.lit(1).alias("_one"))
    return shares.join(first, F.col(key).eqNullSafe(F.col("_first")), "left").select(
        key, (F.col("least") + above.cast("int") + F.coalesce("_one", F.lit(0))).alias("quota"))


def mark_test_rows(
    df: DataFrame, label: str, row_id: str | list[str], test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``.  Stratified by label, unless the label is a float, has a class of fewer
    than two rows, or has more classes than half the rows; then all rows form one stratum.

    Every other column, sensitive ones included, stays on its row.  Where strata count, a row without label is no test row.
    """
    stratified = not isinstance(df.schema[label].dataType, (T.FloatType, T.DoubleType))
    if stratified:
        counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_stratum")).count()
        counts = _once(counts)
        n_classes, least, most, rows = counts.agg(F.count("*"), F.min("count"), F.max("count"), F.sum("count")).first()
        stratified = bool(rows) and least >= 2 and n_classes <= rows // 2
    if not stratified:
        rows = most = df.count()
        counts = df.sparkSession.createDataFrame([(0, rows)], "_stratum int, count long")
    quotas = quotas_by_class(counts, "_stratum", test_size, max(1, rows))
    stratum = F.col(label) if stratified else F.lit(0)
    taken = take_per_group(df.withColumn("_stratum", stratum), "_stratum", quotas, row_id, seed, rows=most)
    return taken.drop("_stratum").withColumnRenamed("taken", "is_test")


def _once(counts: DataFrame) -> DataFrame:
    """The counts without the pass over the data behind them: a local table if they are few, else written."""
    few = counts.limit(LISTED_COUNTS + 1).collect()
    if len(few) <= LISTED_COUNTS:
        return counts.sparkSession.createDataFrame(few, counts.schema)
    return Scratch(counts.sparkSession).keep(counts, "counts")


def train_test_split(
    df: DataFrame, label: str, row_id: str | list[str], test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    marked = mark_test_rows(df, label, row_id, test_size, seed)
    return (
        marked.where(~F.col("is_test")).drop("is_test"),
        marked.where("is_test").drop("is_test"),
    )
