"""Run logs: metrics out of log lines, and a run's identity out of its file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# The wording of the log lines.  Two dash styles and two delta signs occur.
TOP_METRICS = {
    "test_accuracy": r"Test accuracy:\s+([0-9.]+)",
    "majority_baseline": r"Majority-class baseline:\s+([0-9.]+)",
    "training_time_s": r"Training time:\s+([0-9.]+)s",
}
BLOCK_METRICS = {
    "sp_diff": r"Statistical parity diff:\s+([0-9.]+)",
    "di_ratio": r"Disparate impact ratio:\s+([0-9.]+)",
    "eo_diff": r"Equal opportunity diff:\s+([0-9.]+)",
}
BLOCK_START = r"(?m)(?=^Fairness [-—] .+:\r?$)"
BLOCK_HEADER = r"^Fairness [-—] (.+?)(?: \((calibrated|LPFR)\))?:$"
REPAIRED_ACCURACY = r"(Calibrated|LPFR) accuracy:\s+([0-9.]+)\s+\(was\s+[0-9.]+\s*,\s*(?:delta|Δ)=.+\)"
FAIR_MARKERS = r"FairPreprocess|FairCalibrate|LeafPareto|LPFR accuracy"
FILE_NAME = r"^(.+)-([^-]+)-d(\d+)-(bin|raw)-(nofair|fair|lpfr)(?:-(.+))?\.log$"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file, text``: one row per log file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")
    )


def run_identity(file: Column | str) -> list[Column]:
    """``model, dataset, depth, features, mode, suffix`` of a log file name; null if it has another form."""
    name = F.col(file) if isinstance(file, str) else file
    known = name.rlike(FILE_NAME)

    def part(i: int) -> Column:
        return F.when(known, F.nullif(F.regexp_extract(name, FILE_NAME, i), F.lit("")))

    return [
        part(1).alias("model"), part(2).alias("dataset"), part(3).cast("int").alias("depth"),
        part(4).alias("features"), part(5).alias("mode"), part(6).alias("suffix"),
    ]


def log_lines(logs: DataFrame) -> DataFrame:
    """``file, block, pos, attribute, post, line`` in file order.

    A text is cut in front of each fairness header, so the header of a line is known inside
    its own piece and no window over a file is needed.
    """
    pieces = spread(logs).select(
        "file", F.posexplode(F.split("text", BLOCK_START)).alias("block", "piece")
    )
    head = F.regexp_extract("piece", r"^([^\r\n]*)", 1)
    return pieces.select(
        "file", "block",
        F.when(head.rlike(BLOCK_HEADER), F.trim(F.regexp_extract(head, BLOCK_HEADER, 1))).alias("attribute"),
        F.regexp_extract(head, BLOCK_HEADER, 2).alias("post"),
        F.posexplode(F.split("piece", r"\r?\n")).alias("pos", "line"),
    )


def parse_logs(logs: DataFrame, audited: list[str] | None = None) -> DataFrame:
    """``file, metric, value`` in long form.

    Fairness metrics are named ``attribute.metric`` and carry the prefix ``calibrated_`` or ``lpfr_``
    of their block.  A later line wins over an earlier one of the same name.  ``audited`` restricts
    fairness metrics to files of those datasets (by file name).
    """
    lines = log_lines(logs)
    line = F.col("line")
    prefix = (
        F.when(F.col("post") == "calibrated", F.lit("calibrated_"))
        .when(F.col("post") == "LPFR", F.lit("lpfr_")).otherwise(F.lit(""))
    )

    def matches(pattern: str) -> Column:
        # A plain search for the fixed beginning spares most lines the regular expression.
        return line.contains(pattern.split(":")[0].split(")")[-1].strip() + ":") & line.rlike(pattern)

    found = [
        F.when(matches(p), F.struct(F.lit(m).alias("metric"), F.regexp_extract(line, p, 1).alias("value")))
        for m, p in TOP_METRICS.items()
    ]
    header = line.startswith("Fairness ") & line.rlike(BLOCK_HEADER)
    in_block = F.col("attribute").isNotNull() & ~header
    if audited is not None:
        in_block = in_block & F.regexp_extract("file", FILE_NAME, 2).isin(audited)
    attribute = F.concat("attribute", F.lit("."))
    found += [
        F.when(in_block & matches(p), F.struct(
            F.concat(attribute, prefix, F.lit(m)).alias("metric"),
            F.regexp_extract(line, p, 1).alias("value"),
        ))
        for m, p in BLOCK_METRICS.items()
    ]
    repaired = F.when(F.regexp_extract(line, REPAIRED_ACCURACY, 1) == "Calibrated", F.lit("calibrated_acc")).otherwise(
        F.lit("lpfr_acc"))
    found.append(F.when(in_block & matches(REPAIRED_ACCURACY), F.struct(
        F.concat(attribute, repaired).alias("metric"),
        F.regexp_extract(line, REPAIRED_ACCURACY, 2).alias("value"),
    )))
    at = F.struct("block", "pos").alias("at")
    hits = lines.select("file", at, F.coalesce(*found).alias("hit")).where(F.col("hit").isNotNull())
    return hits.groupBy("file", F.col("hit.metric").alias("metric")).agg(
        F.max_by(F.col("hit.value"), "at").cast("double").alias("value")
    )


def fair_files(logs: DataFrame) -> DataFrame:
    """``file, is_fair``: whether any line shows fairness pre- or post-processing."""
    return logs.select("file", F.col("text").rlike(FAIR_MARKERS).alias("is_fair"))


def output_mode(mode: Column, is_fair: Column) -> Column:
    """Where a run's results go: lpfr by name, the others by what the log shows."""
    return F.when(mode == "lpfr", F.lit("lpfr")).when(is_fair, F.lit("fair")).otherwise(F.lit("nofair"))
