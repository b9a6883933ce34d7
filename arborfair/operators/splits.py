"""The best split of every open node, out of sums per distinct value or category.

All functions take a table with a ``node`` column, so one job serves every open node of a
level.  Sufficient statistics are additive columns: class counts for classification, or
count, sum and sum of squares for regression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import SCORE_DIGITS, gini, plus, squares, variance
from ..functions.ranks import bucket_edges, long_values, midpoint, running_sums


@dataclass(frozen=True)
class Statistics:
    """The additive statistics of a node and the impurity computed from them (as SQL text)."""

    n_classes: int | None  # None: regression

    @property
    def names(self) -> list[str]:
        return self.columns("s")

    def columns(self, prefix: str) -> list[str]:
        return [f"{prefix}{i}" for i in range(3 if self.n_classes is None else self.n_classes)]

    def aggregates(self, y: str) -> list[Column]:
        if self.n_classes is None:
            texts = [f"double(count({y}))", f"sum({y})", f"sum({y} * {y})"]
        else:
            texts = [f"count_if({y} = {c})" for c in range(self.n_classes)]
        return [F.expr(t).alias(s) for t, s in zip(texts, self.names)]

    def weighted(self, y: str, n: str) -> list[Column]:
        """The same statistics of rows that stand for ``n`` rows each."""
        if self.n_classes is None:
            texts = [f"double(coalesce(sum(if({y} IS NULL, 0L, {n})), 0L))", f"sum({y} * {n})", f"sum({y} * {y} * {n})"]
        else:
            texts = [f"coalesce(sum(if({y} = {c}, {n}, 0L)), 0L)" for c in range(self.n_classes)]
        return [F.expr(t).alias(s) for t, s in zip(texts, self.names)]

    def size(self, s: list[str]) -> str:
        return s[0] if self.n_classes is None else plus(s)

    def impurity(self, s: list[str]) -> str:
        return variance(*s) if self.n_classes is None else gini(s)

    def mean(self, s: list[str]) -> str:
        """The target mean that orders categories (two classes, or regression)."""
        return f"{s[1]} / {self.size(s)}"

    def ordered_categories(self) -> bool:
        return self.n_classes is None or self.n_classes == 2


def node_statistics(df: DataFrame, y: str, stats: Statistics) -> DataFrame:
    return df.groupBy("node").agg(*stats.aggregates(y))


def split_gain(l: list[str], w: list[str], stats: Statistics) -> tuple[str, str]:
    """The impurity a split removes, and the rounded score by which splits are compared."""
    r = [f"({b} - {a})" for a, b in zip(l, w)]
    n, n_left, n_right = (f"double({stats.size(s)})" for s in (w, l, r))
    if stats.n_classes is None:
        parent = stats.impurity(w)
        gain = f"({parent} - ({n_left} / {n}) * {stats.impurity(l)} - ({n_right} / {n}) * {stats.impurity(r)})"
        # Compared relative to the parent: variances have the unit of the target squared.
        return gain, f"if({parent} > 0, round({gain} / {parent}, {SCORE_DIGITS}), 0.0D)"
    # The weighted Gini impurities, with the ones cancelled.
    gain = f"(({squares(l)} / {n_left} + {squares(r)} / {n_right} - {squares(w)} / {n}) / {n})"
    return gain, f"round({gain}, {SCORE_DIGITS})"


def _both_sides(l: list[str], w: list[str], stats: Statistics, min_leaf: int) -> str:
    n_left = stats.size(l)
    return f"{n_left} >= {min_leaf} AND {stats.size(w)} - {n_left} >= {min_leaf}"


def _with_totals(df: DataFrame, totals: DataFrame | list[tuple], stats: Statistics) -> DataFrame:
    """Add the statistics ``w0..`` of the row's node.

    ``totals`` lists them for nodes 0, 1, .. (they become literals), or is a table with a
    row per node, at most 2 ** depth of them.
    """
    if isinstance(totals, list):
        kind = "double" if stats.n_classes is None else "bigint"
        return df.selectExpr("*", *[
            f"get(array({', '.join(f'{kind}({t[i]!r})' for t in totals)}), node) AS {w}"
            for i, w in enumerate(stats.columns("w"))
        ])
    renamed = totals.selectExpr("node", *[f"{n} AS {w}" for n, w in zip(stats.names, stats.columns("w"))])
    return df.join(renamed, "node")  # the optimizer measures it before it broadcasts it


def _score(candidates: DataFrame, totals: DataFrame | list[tuple], stats: Statistics, min_leaf: int) -> DataFrame:
    """Add the gain of each candidate with left statistics ``l0..``; keep those that gain."""
    l, w = stats.columns("l"), stats.columns("w")
    gain, score = split_gain(l, w, stats)
    return (
        _with_totals(candidates, totals, stats).where(_both_sides(l, w, stats, min_leaf))
        .selectExpr(*candidates.columns, f"{gain} AS gain", f"{score} AS score")
        .where("score > 0")
    )


#: Rows of one column that one task sorts.
SORTED_ROWS = 50_000


def numeric_candidates(
    df: DataFrame, columns: list[str], y: str, totals: DataFrame | list[tuple], stats: Statistics,
    min_leaf: int, edges: dict[str, list[float]] | None = None,
) -> DataFrame:
    """``node, feature, threshold, gain, score, l0..``: every boundary between two values.

    Missing values never pass ``<= threshold``, so they count on the right.  Without ``edges`` the values are sorted
    in buckets of about ``SORTED_ROWS`` rows.
    """
    edges = edges if edges is not None else bucket_edges(df, columns, df.count(), SORTED_ROWS)
    long = long_values(df, columns, edges, ["node", y])
    per_value = long.groupBy("node", "feature", "bucket", "value").agg(*stats.aggregates(y))
    running = running_sums(
        per_value, ["node", "feature"], "value", stats.names, any(edges.values())
    ).where(F.col("next_value").isNotNull())
    cut = running.selectExpr(
        "node", "feature", f"{midpoint('value', 'next_value')} AS threshold",
        *[f"cum_{s} AS {l}" for s, l in zip(stats.names, stats.columns("l"))],
    )
    return _score(cut, totals, stats, min_leaf)


def best_numeric(candidates: DataFrame) -> DataFrame:
    """The best boundary per node and feature; the lowest threshold wins a tie."""
    best = F.expr("max_by(struct(*), struct(score, -threshold)) AS _b")
    return candidates.groupBy("node", "feature").agg(best).select("_b.*")


# -- numeric splits of large tables ------------------------------------------------------------
#
# Sorting all values of all columns for every level would shuffle the table once per level.  But
# the gain is a convex function of the left statistics, so inside a bucket of values it cannot be
# larger than at a corner of the box of statistics the bucket spans.  One small table of bucket
# statistics gives the gains at bucket borders and these bounds; only buckets whose bound
# reaches the best border of their node are looked into.  The result stays exact.

MAX_CORNER_CLASSES = 4
MAX_OPEN_BUCKETS = 20_000
BOUND_SLACK = 1e-9


def _bound(start: list[str], end: list[str], w: list[str], stats: Statistics) -> str:
    """An upper bound of the score of any cut inside a bucket; null if there is none."""
    parent = stats.impurity(w)
    if stats.n_classes is None:
        # The sum inside a bucket lies between all negative and all positive targets of it.
        n, s = f"double({w[0]})", w[1]
        corners = [
            f"({sl} * {sl} / nullif({nl}, 0D) + ({s} - {sl}) * ({s} - {sl}) / nullif({n} - {nl}, 0D) - {s} * {s} / {n}) / {n}"
            for nl in (f"double({start[0]})", f"double({end[0]})")
            for sl in (f"({start[1]} + neg)", f"({start[1]} + pos)")
        ]
        worst = f"greatest({', '.join(corners)})"
        known = " AND ".join(f"{c} IS NOT NULL" for c in corners)
        return f"if({known}, {worst} / nullif({parent}, 0D), NULL)"
    n = f"double({plus(w)})"
    if stats.n_classes <= MAX_CORNER_CLASSES:
        corners = []
        for choice in product(*zip(start, end)):
            l = list(choice)
            r = [f"({b} - {a})" for a, b in zip(l, w)]
            corners.append(
                f"({squares(l)} / nullif(double({plus(l)}), 0D) + {squares(r)} / nullif(double({plus(r)}), 0D) - {squares(w)} / {n}) / {n}"
            )
        # An empty side gains nothing, so a corner without rows can be left out.
        return f"coalesce(greatest({', '.join(corners)}), 0D)"
    rest = [f"({b} - {a})" for a, b in zip(start, w)]
    return (
        f"({squares(end)} / nullif(double({plus(start)}), 0D) + {squares(rest)} / nullif({n} - {plus(end)}, 0D)"
        f" - {squares(w)} / {n}) / {n}"
    )


def bucket_borders(
    df: DataFrame, columns: list[str], y: str, totals: DataFrame | list[tuple], stats: Statistics, min_leaf: int,
    edges: dict[str, list[float]],
) -> DataFrame:
    """The cuts between buckets that can be best in their node, and the buckets to look into.

    ``node, feature, bucket, threshold, score, gain, l0.. (at the border), b0.. (before the bucket),
    open``.
    """
    long = long_values(df, columns, edges, ["node", y])
    extra = [] if stats.n_classes is not None else [
        F.expr(f"sum(least({y}, 0D)) AS neg"), F.expr(f"sum(greatest({y}, 0D)) AS pos")
    ]
    buckets = long.groupBy("node", "feature", "bucket").agg(
        *stats.aggregates(y), F.min("value").alias("lo"), F.max("value").alias("hi"), *extra
    )
    names, l, w, b = stats.names, stats.columns("l"), stats.columns("w"), stats.columns("b")
    window = "(PARTITION BY node, feature ORDER BY bucket"
    swept = buckets.selectExpr(
        "*", *[f"sum({s}) OVER {window}) AS {c}" for s, c in zip(names, l)],
        f"lead(lo) OVER {window}) AS next_lo",
    )
    swept = _with_totals(swept, totals, stats).selectExpr(
        "*", f"{midpoint('hi', 'next_lo')} AS threshold", *[f"{c} - {s} AS {d}" for c, s, d in zip(l, names, b)]
    )
    gain, score = split_gain(l, w, stats)
    valid = f"threshold IS NOT NULL AND {_both_sides(l, w, stats, min_leaf)}"
    scored = swept.selectExpr(
        "node", "feature", "bucket", "threshold", *l, *b, "lo < hi AS inner_cuts",
        f"if({valid}, {score}, 0D) AS score", f"if({valid}, {gain}, 0D) AS gain",
        f"{_bound(b, l, w, stats)} AS bound",
    )
    best = scored.groupBy("node").agg(F.max("score").alias("best"))
    return scored.join(best, "node").selectExpr(
        "node", "feature", "bucket", "threshold", "score", "gain", *l, *b, "best",
        f"inner_cuts AND coalesce(bound >= best - {BOUND_SLACK!r}D, true) AS open",
    ).where("open OR (score > 0 AND score = best)").drop("best")


def inner_candidates(
    df: DataFrame, columns: list[str], y: str, totals: DataFrame | list[tuple], stats: Statistics, min_leaf: int,
    edges: dict[str, list[float]], opened: list[tuple],
) -> DataFrame:
    """Every cut inside the ``opened`` buckets (``node, feature, bucket, b0..``), as in
    :func:`numeric_candidates`."""
    keys = ["node", "feature", "bucket"]
    slots = 1 + max(len(e) for e in edges.values())
    places: dict[int, list[str]] = {}
    for node, feature, bucket, *_ in opened:
        places.setdefault(feature, []).append(str(node * slots + bucket))
    # A set test per column drops all other rows before they are taken apart.
    wanted = {i: f"node * {slots} + _b{i} IN ({', '.join(p)})" for i, p in places.items()}
    per_value = long_values(df, columns, edges, ["node", y], wanted).groupBy(*keys, "value").agg(
        *stats.aggregates(y)
    )
    running = running_sums(per_value, keys, "value", stats.names, False).where("next_value IS NOT NULL")
    kind = "double" if stats.n_classes is None else "bigint"
    before = df.sparkSession.createDataFrame(
        opened, "node int, feature int, bucket int, " + ", ".join(f"{b} {kind}" for b in stats.columns("b"))
    )
    placed = running.join(F.broadcast(before), keys)  # at most MAX_OPEN_BUCKETS rows
    cut = placed.selectExpr(
        "node", "feature", f"{midpoint('value', 'next_value')} AS threshold",
        *[f"cum_{s} + {b} AS {l}" for s, b, l in zip(stats.names, stats.columns("b"), stats.columns("l"))],
    )
    return _score(cut, totals, stats, min_leaf)


def category_statistics(df: DataFrame, columns: list[str], y: str, stats: Statistics) -> DataFrame:
    """``node, feature, category, s0..``; null categories are left out and go right."""
    cells = [
        F.struct(F.lit(i).alias("feature"), F.col(c).cast("string").alias("category"))
        for i, c in enumerate(columns)
    ]
    long = df.select("node", y, F.explode(F.array(*cells)).alias("_c")).select("node", y, "_c.*")
    return long.where(F.col("category").isNotNull()).groupBy("node", "feature", "category").agg(
        *stats.aggregates(y)
    )


def best_category_prefix(
    per_category: DataFrame, totals: DataFrame | list[tuple], stats: Statistics, min_leaf: int
) -> DataFrame:
    """Two classes or regression: cut the categories ordered by target mean, then by name.

    The categories of one node and feature (a bounded number) become one sorted array, which is
    swept once with running sums.
    """
    names, left, w = stats.names, stats.columns("l"), stats.columns("w")
    mean = f"round({stats.mean(names)}, {SCORE_DIGITS})"
    item = f"struct({mean} AS mean, category, {', '.join(f'double({s}) AS {s}' for s in names)})"
    arrays = per_category.groupBy("node", "feature").agg(
        F.expr(f"array_sort(collect_list({item})) AS items")
    )
    zeros = ", ".join(f"0.0D AS {c}" for c in [*names, "score", "gain", *left])
    sums = [f"(a.{s} + x.{s})" for s in names]
    gain, score = split_gain(sums, w, stats)
    fits = f"a.i + 1 < size(items) AND {_both_sides(sums, w, stats, min_leaf)} AND {score} > a.score"
    picks = [("a.i + 1", "size"), (score, "score"), (gain, "gain"), *zip(sums, left)]
    best = f"aggregate(items, struct(0 AS i, {zeros}, 0 AS size), (a, x) -> {{}})"
    # The accumulator keeps one field order: counters, sums, best so far.
    order = ["i", *names, "score", "gain", *left, "size"]
    fields = dict([("i", "a.i + 1"), *zip(names, sums), *[(old, f"if({fits}, {new}, a.{old})") for new, old in picks]])
    step = "struct(" + ", ".join(f"{fields[f]} AS {f}" for f in order) + ")"
    swept = _with_totals(arrays, totals, stats).selectExpr(
        "node", "feature", "items", f"{best.format(step)} AS best"
    ).where("best.size > 0")
    kind = "double" if stats.n_classes is None else "bigint"
    return swept.selectExpr(
        "node", "feature", "best.gain", "best.score",
        *[f"{kind}(best.{c}) AS {c}" for c in left],
        "array_sort(transform(slice(items, 1, best.size), k -> k.category)) AS left_categories",
    )


def best_category_subset(
    per_category: DataFrame, totals: DataFrame | list[tuple], stats: Statistics, min_leaf: int, max_categories: int
) -> DataFrame:
    """More classes: all subsets of at most half the categories; small, then first by name, wins.

    Features with more than ``max_categories`` categories in a node are not split there.
    """
    group = Window.partitionBy("node", "feature")
    numbered = (
        per_category.withColumn("k", F.count("*").over(group))
        .where((F.col("k") > 1) & (F.col("k") <= max_categories))
        .withColumn("i", F.row_number().over(group.orderBy("category")) - 1)
    )
    # Category i is bit k-1-i, so among subsets of one size the first by name has the largest mask.
    bit = F.expr("shiftright(mask, int(k - 1 - i)) & 1")
    members = numbered.withColumn(
        "mask", F.explode(F.expr("sequence(1, int(shiftleft(1, int(k))) - 1)"))
    ).where((F.bit_count("mask") <= F.floor(F.col("k") / 2)) & (bit == 1))
    left = stats.columns("l")
    subsets = members.groupBy("node", "feature", "mask").agg(
        *[F.sum(s).alias(l) for s, l in zip(stats.names, left)],
        F.expr("array_sort(collect_list(category)) AS left_categories"),
    )
    best = F.expr("max_by(struct(*), struct(score, -bit_count(mask), mask)) AS _b")
    found = _score(subsets, totals, stats, min_leaf).groupBy("node", "feature").agg(best)
    return found.select("_b.*").select("node", "feature", "gain", "score", *left, "left_categories")


def best_per_feature(
    df: DataFrame, numeric: list[str], categorical: list[str], y: str, totals: DataFrame | list[tuple],
    stats: Statistics, min_leaf: int, max_categories: int, edges: dict[str, list[float]] | None,
    opened: list[tuple] | None = None,
) -> DataFrame | None:
    """The best split of every node on every feature that can split it.

    ``feature`` counts through the numeric, then the categorical columns.  With ``opened``, only
    the numeric cuts inside those buckets are tried.
    """
    shape = ["node", "feature", "threshold", "left_categories", "gain", "score", *stats.columns("l")]
    found = []
    if numeric and opened is None:
        found.append(numeric_candidates(df, numeric, y, totals, stats, min_leaf, edges))
    elif numeric and opened:
        found.append(inner_candidates(df, numeric, y, totals, stats, min_leaf, edges, opened))
    found = [
        best_numeric(c).withColumn("left_categories", F.lit(None).cast("array<string>")) for c in found
    ]
    if categorical:
        per_category = category_statistics(df, categorical, y, stats)
        if stats.ordered_categories():
            by_category = best_category_prefix(per_category, totals, stats, min_leaf)
        else:
            by_category = best_category_subset(per_category, totals, stats, min_leaf, max_categories)
        found.append(by_category.withColumn("threshold", F.lit(None).cast("double")).withColumn(
            "feature", F.col("feature") + len(numeric)
        ))
    parts = [f.select(shape) for f in found]
    return reduce(DataFrame.unionByName, parts) if parts else None


def best_splits(
    df: DataFrame, numeric: list[str], categorical: list[str], y: str, totals: DataFrame | list[tuple],
    stats: Statistics, min_leaf: int, max_categories: int, edges: dict[str, list[float]] | None = None,
) -> DataFrame:
    """One row per node that can be split: the feature of largest gain, the first one on a tie."""
    found = best_per_feature(
        df, numeric, categorical, y, totals, stats, min_leaf, max_categories, edges
    )
    best = F.expr("max_by(struct(*), struct(score, -feature)) AS _b")
    return found.groupBy("node").agg(best).select("_b.*")


def collect_best_splits(
    df: DataFrame, numeric: list[str], categorical: list[str], y: str, totals: DataFrame | list[tuple],
    stats: Statistics, min_leaf: int, max_categories: int, edges: dict[str, list[float]],
) -> list[dict]:
    """The rows of :func:`best_splits`; with bucket ``edges`` most values are never sorted.

    What comes to the driver is one row per open node and feature, and the open buckets.
    """
    args = (numeric, categorical, y, totals, stats, min_leaf, max_categories, edges)
    borders, opened = [], None
    if any(edges.values()):
        borders = bucket_borders(df, numeric, y, totals, stats, min_leaf, edges).limit(
            MAX_OPEN_BUCKETS + 1
        ).collect()
        if len(borders) > MAX_OPEN_BUCKETS:
            borders = []  # hardly anything was ruled out: sort all values
        else:
            keys = ["node", "feature", "bucket", *stats.columns("b")]
            opened = [tuple(r[k] for k in keys) for r in borders if r["open"]]
    found = best_per_feature(df, *args, opened=opened)
    rows = [r.asDict() for r in found.collect()] if found is not None else []
    rows += [{**r.asDict(), "left_categories": None} for r in borders if r["score"] > 0]
    best: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: (-r["score"], r["feature"], r["threshold"] or 0.0)):
        best.setdefault(r["node"], r)
    return list(best.values())


def collect_best_tests(
    df: DataFrame, keys: list[str], ranges: list[tuple[int, int, int]], sums: list[Column],
    totals: list[tuple], stats: Statistics, min_leaf: int,
) -> list[dict]:
    """The binary test of largest gain per node, the first one on a tie.

    ``df`` has a ``node`` and the positions ``keys`` of every pattern, ``sums`` are the statistics of a group of
    patterns, and test ``fid`` holds in its range of positions.  Rows that fail it are on the left.
    """
    cells = ", ".join(f"struct({i} AS place, {k} AS position)" for i, k in enumerate(keys))
    counted = df.selectExpr("*", f"explode(array({cells})) AS _c").selectExpr("*", "_c.place", "_c.position").groupBy(
        "node", "place", "position").agg(*sums)
    tests = df.sparkSession.createDataFrame(
        [(fid, *r) for fid, r in enumerate(ranges)], "feature int, place int, low int, high int")
    names, l, w = stats.names, stats.columns("l"), stats.columns("w")
    holds = counted.join(F.broadcast(tests), "place").where("position BETWEEN low AND high").groupBy("node", "feature").agg(
        *[F.sum(s).alias(s) for s in names])
    left = _with_totals(holds, totals, stats).selectExpr("node", "feature", *[f"{b} - coalesce({s}, 0) AS {a}" for a, b, s in zip(l, w, names)])
    best = F.expr("max_by(struct(*), struct(score, -feature)) AS _b")
    return [r["_b"].asDict() for r in _score(left, totals, stats, min_leaf).groupBy("node").agg(best).select("_b").collect()]
