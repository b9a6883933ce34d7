"""Row filters, null handling, renames, recodes and column profiles."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import is_missing
from ..functions.ranks import exact_quantiles


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the rows in which every given column is present (NaN counts as missing)."""
    return df.na.drop("any", subset=list(columns))


def count_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows read, rows kept and rows dropped by :func:`drop_incomplete`."""
    types = _types(df)
    missing = F.lit(False)
    for c in columns:
        missing = missing | is_missing(F.col(c), types[c])
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~missing).alias("n_kept"),
        F.count_if(missing).alias("n_dropped"),
    )


def keep_labels(df: DataFrame, label: str, allowed: Sequence = (0, 1)) -> DataFrame:
    return df.where(F.col(label).isin(list(allowed)))


def sentinels_to_null(
    df: DataFrame, columns: Sequence[str], sentinels: Sequence[float] = (-9, -8, -7)
) -> DataFrame:
    """Replace the codes that stand for "unknown" by null."""
    values = list(sentinels)
    return df.withColumns({c: F.when(~F.col(c).isin(values), F.col(c)) for c in columns})


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strings to numbers; what does not read as a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def drop_missing_target(df: DataFrame, label: str) -> DataFrame:
    return df.where(~is_missing(F.col(label), _types(df)[label]))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n_null, null_fraction``, one row per column, out of one aggregate."""
    types = _types(df)
    wide = df.agg(
        F.count("*").alias("_n"),
        *[F.count_if(is_missing(F.col(c), types[c])).alias(c) for c in columns],
    )
    return wide.unpivot("_n", list(columns), "column", "n_null").select(
        "column", "n_null", (F.col("n_null") / F.col("_n")).alias("null_fraction")
    )


def drop_sparse_columns(
    df: DataFrame, columns: Sequence[str], max_null_fraction: float = 0.5
) -> DataFrame:
    """Drop each of ``columns`` whose null fraction is above ``max_null_fraction``."""
    rows = null_profile(df, columns).where(F.col("null_fraction") > max_null_fraction).collect()
    return df.drop(*[r["column"] for r in rows])


def fill_median(df: DataFrame, columns: Sequence[str], **kw) -> DataFrame:
    """Fill the nulls of each column with its exact median."""
    medians = {c: q[0] for c, q in exact_quantiles(df, list(columns), [0.5], **kw).items()}
    return df.withColumns(
        {
            c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m))
            for c, m in medians.items()
            if m is not None
        }
    )


def drop_non_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Keep numeric and boolean columns, and those named in ``keep``."""
    return df.select(
        [
            f.name
            for f in df.schema.fields
            if f.name in keep or isinstance(f.dataType, (T.NumericType, T.BooleanType))
        ]
    )


def drop_columns(df: DataFrame, names: Sequence[str] = (), first: int = 0) -> DataFrame:
    """Drop named columns (absent names are ignored) and the ``first`` columns by position."""
    return df.drop(*df.columns[:first], *names)


def rename_generic(df: DataFrame, names: Sequence[str], pattern: str = r"V\d+",
                   label: str | None = None) -> DataFrame:
    """Rename the feature columns to ``names`` if all match ``pattern`` and the count agrees."""
    features = [c for c in df.columns if c != label]
    if len(features) != len(names) or not all(re.fullmatch(pattern, c) for c in features):
        return df
    return df.withColumnsRenamed(dict(zip(features, names)))


def recode(df: DataFrame, column: str, mapping: Mapping, default: str = "other") -> DataFrame:
    """Replace codes by names; null and unmapped codes become ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    looked_up = F.try_element_at(F.create_map(*pairs), F.col(column))
    return df.withColumn(column, F.coalesce(looked_up, F.lit(default)))


def label_equals(column: str, value: str, strip: bool = False) -> Column:
    """1 where the text equals ``value``; ``strip`` first removes blanks and trailing dots."""
    text = F.col(column)
    if strip:
        text = F.regexp_replace(F.trim(text), r"\.+$", "")
    return (text == value).cast("int")


def label_positive(column: str) -> Column:
    return (F.col(column).cast("int") > 0).cast("int")


def label_shift(column: str, by: int = 1) -> Column:
    """Labels that start at ``by`` moved to start at 0."""
    return F.col(column).cast("int") - F.lit(by)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """``label, n, share``, largest class first."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    rows = counts.agg(F.sum("n")).scalar()
    return counts.select("label", "n", (F.col("n") / rows).alias("share")).orderBy(
        F.desc("n"), "label"
    )


def target_profile(df: DataFrame, label: str) -> DataFrame:
    """Count, mean and population standard deviation of a numeric target."""
    return df.agg(
        F.count(label).alias("n"), F.avg(label).alias("mean"), F.stddev_pop(label).alias("std")
    )


