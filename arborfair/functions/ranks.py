"""Running sums, order statistics and seeded row selection without a one-task window.

A window over one feature, one class or one group would put all of its rows into one
task.  Each function here first cuts the order into buckets, adds up the buckets (a small
table), and only then sorts inside a bucket.  The buckets never change a result.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import quoted, seeded_hash

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 20_000


def midpoint(low: str, high: str) -> str:
    """SQL text of a threshold t with ``low <= t < high``: halfway, or ``low`` where that is not below ``high``."""
    half = f"({low} + {high}) / 2.0D"
    return f"if({half} >= {high}, {low}, {half})"


def bucket_edges(
    df: DataFrame, columns: list[str], rows: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> dict[str, list[float]]:
    """Inner bucket borders per numeric column, near its quantiles; none for a small table."""
    n_buckets = min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket))
    if n_buckets <= 1 or not columns:
        return {c: [] for c in columns}
    probabilities = [i / n_buckets for i in range(1, n_buckets)]
    doubles = df.select([F.col(c).cast("double").alias(c) for c in columns])
    found = doubles.approxQuantile(columns, probabilities, 1.0 / (4 * n_buckets))
    # Infinite values lie in the outermost buckets, which have no inner border.
    return {c: sorted({e for e in edges or [] if math.isfinite(e)}) for c, edges in zip(columns, found)}


def with_buckets(df: DataFrame, columns: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """Add ``_b0, _b1, ..``, the bucket of each column's value; missing values have any bucket."""
    wide = df.selectExpr(
        "*", *[f"nanvl(double({quoted(c)}), NULL) AS _v{i}" for i, c in enumerate(columns) if edges[c]]
    )
    for i, c in enumerate(columns):
        if edges[c]:
            wide = Bucketizer(
                splits=[-math.inf, *edges[c], math.inf], inputCol=f"_v{i}", outputCol=f"_d{i}",
                handleInvalid="keep",
            ).transform(wide)
    return wide.selectExpr(
        *[quoted(c) for c in df.columns],
        *[f"int(_d{i}) AS _b{i}" if edges[c] else f"0 AS _b{i}" for i, c in enumerate(columns)],
    )


def long_values(
    df: DataFrame, columns: list[str], edges: dict[str, list[float]], carry: list[str],
    wanted: dict[int, str] | None = None,
) -> DataFrame:
    """One row per non-missing number: ``carry.., feature (position), value, bucket``.

    Bucket columns of :func:`with_buckets` are used if the table has them.  ``wanted`` keeps only the listed features,
    each for the rows that meet its condition (SQL text).
    """
    chosen = range(len(columns)) if wanted is None else sorted(wanted)
    if any(edges.values()) and "_b0" not in df.columns:
        df = with_buckets(df, columns, edges)
    names = [quoted(c) for c in carry]
    cells = []
    for i in chosen:
        bucket = f"_b{i}" if edges[columns[i]] else "0"
        cell = f"struct({i} AS feature, nanvl(double({quoted(columns[i])}), NULL) AS value, {bucket} AS bucket)"
        cells.append(cell if wanted is None else f"if({wanted[i]}, {cell}, NULL)")
    if wanted is not None:
        df = df.where(" OR ".join(wanted.values()))
    return df.selectExpr(*names, f"explode(array({', '.join(cells)})) AS _cell").selectExpr(
        *names, "_cell.feature", "_cell.value", "_cell.bucket"
    ).where("value IS NOT NULL")


def running_sums(
    df: DataFrame, keys: list[str], order: str, sums: list[str], bucketed: bool,
    with_total: bool = False,
) -> DataFrame:
    """Add ``cum_<s>`` for each of ``sums`` and ``next_<order>`` within ``keys`` by ``order``.

    ``with_total`` also adds ``all_<s>``, the sums over all of ``keys``.

    ``df`` holds one row per (keys, order) and, if ``bucketed``, a column ``bucket`` that
    never decreases along ``order``.
    """
    group = [*keys, "bucket"] if bucketed else keys
    inside = f"(PARTITION BY {', '.join(group)} ORDER BY {order}"
    upto = f"{inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    local = df.selectExpr(
        "*",
        *[f"sum({s}) OVER {upto} AS cum_{s}" for s in sums],
        f"lead({order}) OVER {inside}) AS next_{order}",
        *[f"sum({s}) OVER (PARTITION BY {', '.join(keys)}) AS all_{s}"
          for s in sums if with_total and not bucketed],
    )
    if not bucketed:
        return local
    across = f"(PARTITION BY {', '.join(keys)} ORDER BY bucket"
    before = f"{across} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    totals = df.groupBy(*group).agg(
        *[F.sum(s).alias(f"_{s}") for s in sums], F.min(order).alias("_first")
    )
    offsets = totals.selectExpr(
        *group,
        *[f"coalesce(sum(_{s}) OVER {before}, 0) AS _off_{s}" for s in sums],
        f"lead(_first) OVER {across}) AS _next",
        *[f"sum(_{s}) OVER (PARTITION BY {', '.join(keys)}) AS all_{s}" for s in sums if with_total],
    )
    return local.join(offsets, group).selectExpr(
        *df.columns,
        *[f"cum_{s} + _off_{s} AS cum_{s}" for s in sums],
        f"coalesce(next_{order}, _next) AS next_{order}",
        *[f"all_{s}" for s in sums if with_total],
    )


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the non-missing values of every column.

    Tables up to ``rows_per_bucket`` use the built-in exact percentile.  It keeps all
    distinct values of a column in one task, so larger tables find the bucket that holds
    each wanted rank and sort that bucket only.
    """
    clean = df.select([F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    counts = clean.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    if max(counts.values(), default=0) <= rows_per_bucket:
        row = clean.agg(
            *[F.percentile(c, F.array(*[F.lit(p) for p in probabilities])).alias(c) for c in columns]
        ).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in columns}

    edges = bucket_edges(clean, columns, max(counts.values()), rows_per_bucket)
    values = long_values(clean, columns, edges, [])
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(values.groupBy("feature", "bucket").count().collect()):
        sizes.setdefault(r["feature"], []).append((r["bucket"], r["count"]))

    wanted: dict[tuple[int, int], set[int]] = {}
    found: dict[tuple[int, int], float] = {}
    starts: dict[tuple[int, int], int] = {}
    for i, c in enumerate(columns):
        ranks = set()
        for p in probabilities:
            if counts[c]:
                position = p * (counts[c] - 1)
                ranks |= {math.floor(position), math.ceil(position)}
        seen = 0
        for bucket, size in sizes.get(i, []):
            hits = {r for r in ranks if seen <= r < seen + size}
            if hits:
                wanted[(i, bucket)] = hits
                starts[(i, bucket)] = seen
            seen += size
    in_bucket = F.concat_ws(":", "feature", "bucket").isin([f"{i}:{b}" for i, b in wanted])
    per_value = (
        values.where(in_bucket).groupBy("feature", "bucket", "value").agg(F.count("*").alias("n"))
    )
    ordered = running_sums(per_value, ["feature", "bucket"], "value", ["n"], bucketed=False)
    local = [
        (F.col("feature") == i) & (F.col("bucket") == b)
        & (F.col("cum_n") > r - starts[(i, b)]) & (F.col("cum_n") - F.col("n") <= r - starts[(i, b)])
        for (i, b), hits in wanted.items() for r in sorted(hits)
    ]
    labels = [(i, r) for (i, b), hits in wanted.items() for r in sorted(hits)]
    picks = ordered.select(
        "value", F.explode(F.array(*[F.when(hit, F.lit(k)) for k, hit in enumerate(local)])).alias("k")
    ).where(F.col("k").isNotNull())
    for r in picks.collect():
        found[labels[r["k"]]] = r["value"]

    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out: list[float | None] = []
        for p in probabilities:
            if not counts[c]:
                out.append(None)
                continue
            position = p * (counts[c] - 1)
            low, high = math.floor(position), math.ceil(position)
            a, b = found[(i, low)], found[(i, high)]
            out.append(a if a == b else (high - position) * a + (position - low) * b)
        result[c] = out
    return result


def take_per_group(
    df: DataFrame,
    group: str,
    quotas: DataFrame,
    row_id: str | list[str],
    seed: int,
    priority: Column | None = None,
    hex_digits: int = 3,
    rows: int | None = None,
) -> DataFrame:
    """Add a flag ``taken`` to the first ``quota`` rows of each group in seeded order.

    ``quotas`` has the columns ``group, quota``.  Rows are ordered by ``priority`` (an integer, lower
    first), then by ``md5(row_id:seed)``, then by ``row_id``.  Only the rows of the one
    hash bucket in which a group's quota ends are ranked; all others are decided by a filter.
    There are ``16 ** hex_digits`` buckets per group, more if ``rows`` (of the largest group) asks for it.
    """
    if rows:
        hex_digits = max(hex_digits, math.ceil(math.log(max(1, rows / ROWS_PER_BUCKET), 16)) + 1)
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    hashed = df.select(
        "*",
        (F.lit(0) if priority is None else priority).cast("int").alias("_prio"),
        seeded_hash(row_id, seed).alias("_hash"),
    ).withColumn("_bucket", F.substring("_hash", 1, hex_digits))
    sizes = hashed.groupBy(group, "_prio", "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy("_prio", "_bucket")
    cumulative = sizes.withColumn("_cum", F.sum("_n").over(upto)).join(quotas, group)
    cutoffs = cumulative.where(
        (F.col("quota") > F.col("_cum") - F.col("_n")) & (F.col("quota") <= F.col("_cum"))
    ).select(
        group,
        F.col("_prio").alias("_cut_prio"),
        F.col("_bucket").alias("_cut_bucket"),
        (F.col("quota") - F.col("_cum") + F.col("_n")).alias("_need"),
    )
    everything = sizes.groupBy(group).agg(F.sum("_n").alias("_all")).join(quotas, group)
    limits = everything.join(cutoffs, group, "left").select(
        group,
        # A quota of zero takes nothing, a quota beyond the group takes all of it.
        F.when(F.col("quota") <= 0, F.lit(-1))
        .when(F.col("quota") > F.col("_all"), F.lit(2_000_000_000))
        .otherwise(F.col("_cut_prio")).alias("_cut_prio"),
        F.coalesce("_cut_bucket", F.lit("")).alias("_cut_bucket"),
        F.coalesce("_need", F.lit(0)).alias("_need"),
    )
    marked = hashed.join(limits, group, "left")
    here, cut = F.struct("_prio", "_bucket"), F.struct("_cut_prio", "_cut_bucket")
    original = df.columns
    decided = marked.where(F.coalesce(here != cut, F.lit(True))).select(
        *original, F.coalesce(here < cut, F.lit(False)).alias("taken")
    )
    ranking = Window.partitionBy(group, "_prio", "_bucket").orderBy("_hash", *ids)
    ranked = (
        marked.where(here == cut)
        .withColumn("_rank", F.row_number().over(ranking))
        .select(*original, (F.col("_rank") <= F.col("_need")).alias("taken"))
    )
    return decided.unionByName(ranked)
