"""Table scans and the numeric / categorical roles of their columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file with a header row; the schema is given, so no pass is spent on guessing it."""
    return spark.read.csv(path, header=True, schema=schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns are numeric and which are categorical."""

    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def without(self, columns: list[str]) -> "FeatureSpec":
        gone = set(columns)
        return FeatureSpec(
            [c for c in self.numeric if c not in gone],
            [c for c in self.categorical if c not in gone],
        )


def infer_features(df: DataFrame, exclude: list[str] | None = None) -> FeatureSpec:
    """Numbers and booleans are numeric, strings are categorical.  Reads the schema only."""
    skipped = set(exclude or [])
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name in skipped:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            numeric.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType)):
            categorical.append(f.name)
        else:
            raise TypeError(
                f"column {f.name} has type {f.dataType.simpleString()}; "
                "turn it into numbers or strings, or exclude it"
            )
    return FeatureSpec(numeric, categorical)
