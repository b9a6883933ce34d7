"""JSON and CSV outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed order of the columns of a summary file.
SUMMARY_COLUMNS = ["model", "dataset", "mode", "metric", "mean", "std", "n"]


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_csv(
    df: DataFrame, path: str, columns: list[str] | None = None, partition_by: list[str] | None = None
) -> None:
    """A header row and a fixed column order; one folder per value of ``partition_by``."""
    chosen = df.select(*(columns or df.columns), *[c for c in partition_by or [] if c not in (columns or df.columns)])
    writer = chosen.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    write_csv(df, path, SUMMARY_COLUMNS)


def write_by_mode(df: DataFrame, path: str) -> None:
    """One JSON folder per output mode (nofair, fair, lpfr)."""
    write_json(df, path, ["mode"])
