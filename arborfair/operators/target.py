"""Turn any label into the dense codes 0..k-1 that the learners expect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import quoted
from ..functions.ranks import exact_quantiles
from ..session import Scratch

MAX_INTEGER_CLASSES = 10
# Classes that are listed on the driver and in expressions; more are a table that is joined.
LISTED_CLASSES = 1000
# A running number has the partition above this bit and the place in it below.
_PLACE_BITS = 33


@dataclass(frozen=True)
class Target:
    """How a label column was coded: its classes in order, or the median it was cut at.

    With more than ``LISTED_CLASSES`` classes there is no list and no expression: ``codes`` has ``value, code`` of all
    ``n_classes`` of them, in a table that stays until ``release``."""

    classes: list
    threshold: float | None
    code: Column | None
    codes: DataFrame | None = None
    n_coded: int | None = None
    scratch: Scratch | None = None

    @property
    def n_classes(self) -> int:
        return len(self.classes) if self.n_coded is None else self.n_coded

    def apply(self, df: DataFrame, label: str, output: str) -> DataFrame:
        """``df`` with the codes of ``label`` in ``output``; a missing label has none."""
        if self.codes is None:
            return df.withColumn(output, self.code)
        value, code = (_free_name(df, name) for name in ("value", "code"))
        joined = df.join(self.codes.toDF(value, code), F.col(quoted(label)) == F.col(value), "left").drop(value)
        kept = [F.col(code).alias(c) if c == output else F.col(quoted(c)) for c in df.columns]
        return joined.select(*kept, *([] if output in df.columns else [F.col(code).alias(output)]))

    def release(self) -> None:
        """Drop the table of codes."""
        if self.scratch is not None:
            self.scratch.release()


def _free_name(df: DataFrame, wanted: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wanted in taken:
        wanted += "_"
    return wanted


def dense_codes(df: DataFrame, label: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """``value, code`` of all distinct labels in order, and how many there are.

    Distinct values are dealt by range and sorted in their partitions; a value's code is its place there plus the number of
    values in earlier partitions.  Only one number per partition reaches the driver."""
    values = df.select(F.col(quoted(label)).alias("value")).where("value IS NOT NULL").distinct()
    placed = values.repartitionByRange("value").sortWithinPartitions("value").withColumn("n", F.monotonically_increasing_id())
    kept = scratch.keep(placed, "codes")
    part = F.shiftright("n", _PLACE_BITS)
    sizes = dict(kept.groupBy(part.cast("int").alias("part")).count().collect())
    before, total = [], 0
    for number in range(max(sizes, default=-1) + 1):
        before.append(F.lit(total))
        total += sizes.get(number, 0)
    offset = F.get(F.array(*before), part.cast("int"))
    return kept.select("value", (offset + F.col("n").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).cast("int").alias("code")), total


def is_classification(dtype: T.DataType, n_distinct: int) -> bool:
    """Strings are classes; integers are classes up to ten distinct values; floats never are."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return True
    if isinstance(dtype, T.IntegralType):
        return n_distinct <= MAX_INTEGER_CLASSES
    return False


def fit_target(df: DataFrame, label: str, rows_per_bucket: int | None = None) -> Target:
    """Read the label once and decide its coding.  Raises if only one value occurs."""
    dtype = df.schema[label].dataType
    text = isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))
    low, high, roughly = df.agg(
        F.min(label), F.max(label), F.approx_count_distinct(label)
    ).first()
    if low is None or low == high:
        raise ValueError("the target has fewer than 2 distinct values; nothing to learn")
    values = []
    if text or isinstance(dtype, T.IntegralType):
        if text and roughly > LISTED_CLASSES:
            scratch = Scratch(df.sparkSession)
            codes, total = dense_codes(df, label, scratch)
            return Target([], None, None, codes, total, scratch)
        if text or roughly <= 2 * MAX_INTEGER_CLASSES:
            # The estimate is within a few per cent, so the list is short.
            values = [r[0] for r in df.select(label).distinct().collect() if r[0] is not None]
    if values and is_classification(dtype, len(values)):
        classes = sorted(values)
        if not text and classes == list(range(len(classes))):
            return Target(classes, None, F.col(label).cast("int"))
        place = F.array_position(F.lit(classes).cast(T.ArrayType(dtype)), F.col(label))
        return Target(classes, None, F.when(place > 0, place - 1).cast("int"))
    kw = {} if rows_per_bucket is None else {"rows_per_bucket": rows_per_bucket}
    median = exact_quantiles(df, [label], [0.5], **kw)[label][0]
    return Target([0, 1], median, (F.col(label) >= F.lit(median)).cast("int"))


def prepare_target(df: DataFrame, label: str, output: str | None = None, **kw) -> tuple[DataFrame, Target]:
    """The table with its label coded as integers, and the coding."""
    target = fit_target(df, label, **kw)
    return target.apply(df, label, output or label), target
