"""Declarative preparation of a table: cleaning steps, label rule, features, sensitive columns."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..operators import cleaning
from ..operators.fairness import drop_sensitive, sensitive_group
from ..operators.split import mark_test_rows
from ..operators.target import prepare_target
from ..session import Scratch
from ..sources.tables import FeatureSpec, infer_features

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Recipe:
    """Steps run in the order of the fields."""

    name: str
    label: str
    label_rule: Column | None = None
    select: Sequence[str] = ()
    drop: Sequence[str] = ()
    drop_first: int = 0
    rename_to: Sequence[str] = ()
    coerce: Sequence[str] = ()
    sentinels: Sequence[float] = ()
    recodes: Mapping[str, Mapping] = field(default_factory=dict)
    allowed_labels: Sequence = ()
    steps: Sequence[Step] = ()
    max_null_fraction: float | None = None
    impute_median: bool = False
    numeric_only: bool = False
    drop_incomplete: bool = True
    sensitive: Sequence[str] = ()
    row_id: Sequence[str] = ()


@dataclass(frozen=True)
class Dataset:
    """A cleaned table with the roles of its columns."""

    df: DataFrame
    label: str
    features: FeatureSpec
    sensitive: list[str]
    row_id: list[str]


def apply(recipe: Recipe, df: DataFrame) -> Dataset:
    r, ids = recipe, list(recipe.row_id)
    df = cleaning.drop_columns(df, r.drop, r.drop_first)
    if r.select:
        df = df.select(*dict.fromkeys([*ids, *r.select, r.label]))
    if r.rename_to:
        df = cleaning.rename_generic(df, r.rename_to, label=r.label)
    if r.coerce:
        df = cleaning.coerce_numeric(df, r.coerce)
    for step in r.steps:
        df = step(df)
    if r.label_rule is not None:
        df = df.withColumn(r.label, r.label_rule)
    if r.allowed_labels:
        df = cleaning.keep_labels(df, r.label, r.allowed_labels)
    spec = infer_features(df, [r.label, *ids])
    if r.sentinels:
        df = cleaning.sentinels_to_null(df, spec.numeric, r.sentinels)
    for column, mapping in r.recodes.items():
        df = cleaning.recode(df, column, mapping)
    df = cleaning.drop_missing_target(df, r.label)
    if r.max_null_fraction is not None:
        df = cleaning.drop_sparse_columns(df, spec.all, r.max_null_fraction)
        spec = infer_features(df, [r.label, *ids])
    if r.impute_median:
        df = cleaning.fill_median(df, spec.numeric)
    if r.numeric_only:
        df = cleaning.drop_non_numeric(df, [r.label, *ids])
    spec = infer_features(df, [r.label, *ids])
    if r.drop_incomplete:
        df = cleaning.drop_incomplete(df, [*spec.all, r.label])
    return Dataset(df, r.label, spec, list(r.sensitive), ids)


@dataclass(frozen=True)
class Prepared:
    """Train and test rows.  Groups are in columns named ``group_<attribute>``."""

    train: DataFrame
    test: DataFrame
    label: str
    features: FeatureSpec
    groups: dict[str, str]
    n_classes: int
    row_id: list[str]


def prepare(
    recipe: Recipe, df: DataFrame, test_size: float = 0.2, seed: int = 42, fair: bool = False,
    scratch: Scratch | None = None,
) -> Prepared:
    """Recipe, label coding, sensitive groups, optional removal of sensitive features, split.

    With a ``scratch`` the split rows are written once and both parts are read from there.
    """
    data = apply(recipe, df)
    table, target = prepare_target(data.df, data.label)
    groups: dict[str, str] = {}
    for column in data.sensitive:
        if column not in table.columns:
            warnings.warn(f"sensitive column {column} is absent from {recipe.name}", stacklevel=2)
            continue
        groups[column] = f"group_{column}"
        table = table.withColumn(groups[column], sensitive_group(table, column))
    features = drop_sensitive(data.features, list(groups)) if fair else data.features
    columns = dict.fromkeys([*data.row_id, data.label, *features.all, *groups.values()])
    marked = mark_test_rows(table.select(*columns), data.label, data.row_id, test_size, seed)
    if scratch is not None:
        marked = scratch.keep(marked, "prepared")
    train, test = marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")
    return Prepared(train, test, data.label, features, groups, target.n_classes, data.row_id)
