"""Class counts of many cells of the feature space in one pass.

A cell is a conjunction of answers, written as a tuple of literals: ``fid + 1`` for a true
test and ``-(fid + 1)`` for a false one.  Cells that do not overlap (the open nodes of one tree)
are counted by grouping.  Cells of a search overlap: every row lies in one cell per candidate
test, so grouping would need a copy of each row per cell, or a join on a range of conditions.
Their counts come out of summed histograms of positions (``cubes``).  Cells on more or wider columns
than a cube can have are counted by tasks that turn Arrow batches to a 0/1 matrix and mark the cells
each pattern lies in: one matrix product per batch gives the counts of all (cell, test) pairs, Spark
adds them up and picks the winners.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import SCORE_DIGITS, information_gain, plus
from .cubes import cube_counts, plan
from .patterns import Patterns, minority_count

# Counters one task may hold (8 bytes each); more cells are counted by further scans.
COUNTERS_PER_SCAN = 16_000_000
CELLS_PER_PRODUCT = 256
ROWS_PER_PRODUCT = 4096
HEAVY_SCAN = 5_000_000_000
# Multiplications that take as long as placing a pattern in one cube.
PRODUCTS_PER_CUBE = 600
# Cells that a single CASE expression tells apart.
MAX_GROUPED_CELLS = 64
# Cells of one frontier, whatever learner opens them: each is an object on the driver.
MAX_CELLS = 200_000


class SearchTooLarge(ValueError):
    """The search would open more cells than allowed; nothing is cut silently."""


@dataclass(frozen=True)
class Cell:
    """A cell to be counted and the tests that may split it, best rank first."""

    literals: tuple[int, ...]
    counts: tuple[int, ...]
    minority: int

    @property
    def n(self) -> int:
        return sum(self.counts)

    @property
    def errors(self) -> int:
        return self.n - max(self.counts)

    @property
    def prediction(self) -> int:
        return self.counts.index(max(self.counts))

    def child(self, fid: int, side: bool, counts: tuple[int, ...], minority: int) -> "Cell":
        return Cell((*self.literals, fid + 1 if side else -fid - 1), counts, minority)


@dataclass
class Order:
    """The tests that cells may use, in rank order; ``None`` is the natural order."""

    fids: Sequence[int] | None = None
    rank: dict[int, int] = field(default_factory=dict)

    def size(self, n_features: int) -> int:
        return n_features if self.fids is None else len(self.fids)


def _candidate_lists(
    orders: list[Order], limits: list[int], n_features: int
) -> tuple[np.ndarray, np.ndarray]:
    """The distinct candidate lists (rows padded with -1), and the list of each cell.

    Most cells share a list, so it is shipped once and not once per cell.
    """
    numbers: dict[tuple[int, int], int] = {}
    lists: list[np.ndarray] = []
    of_cell = np.empty(len(orders), dtype=np.int32)
    for i, (order, limit) in enumerate(zip(orders, limits)):
        key = (id(order), limit)
        if key not in numbers:
            fids = np.arange(n_features) if order.fids is None else np.asarray(order.fids)
            numbers[key] = len(lists)
            lists.append(fids[:limit].astype(np.int32))
        of_cell[i] = numbers[key]
    padded = np.full((len(lists), max(len(f) for f in lists)), -1, dtype=np.int32)
    for i, fids in enumerate(lists):
        padded[i, : len(fids)] = fids
    return padded, of_cell


def _counter(literals: np.ndarray, lists: np.ndarray, of_cell: np.ndarray, first: int,
             ranges: list[tuple[int, int, int]], n_keys: int, n_classes: int):
    """The function each task runs over its Arrow batches."""
    n_cells, n_features = len(literals), len(ranges)
    columns = np.unique(lists[lists >= 0])
    position = np.full(n_features + 1, -1, dtype=np.int64)
    position[columns] = np.arange(len(columns))
    key_of, low, high = (np.array(x, dtype=np.int64) for x in zip(*ranges))
    names = ["cell", "fid", "rank", *_names(n_classes)]
    per_product, per_slice = CELLS_PER_PRODUCT, ROWS_PER_PRODUCT

    # Refers to nothing but numpy, pyarrow and the arrays above, so executors need no package.
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per cell: the totals, then one entry per candidate test; each for the classes and
        # for the minority rows.
        k = n_classes + 1
        sums = np.zeros((n_cells, (len(columns) + 1) * k))
        for batch in (
            whole.slice(at, per_slice) for whole in batches
            for at in range(0, whole.num_rows, per_slice)
        ):
            keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)], axis=1)
            at = keys[:, key_of]
            bits = (at >= low) & (at <= high)
            weights = np.stack(
                [batch.column(n_keys + c).to_numpy() for c in range(n_classes)], axis=1
            ).astype(np.float64)
            weights = np.column_stack([weights, weights.sum(1) - weights.max(1)])
            # Columns: true, then false answers, then a column that always holds (padding).
            answers = np.column_stack([bits, ~bits, np.ones(len(bits), bool)])
            used = np.column_stack([np.ones(len(bits), bool), bits[:, columns]])
            right = (used[:, :, None] * weights[:, None, :]).reshape(len(bits), -1)
            for start in range(0, n_cells, per_product):
                block = literals[start : start + per_product]
                inside = answers[:, block[:, 0]]
                for d in range(1, block.shape[1]):
                    inside = inside & answers[:, block[:, d]]
                sums[start : start + len(block)] += inside.T.astype(np.float64) @ right
        sums = sums.astype(np.int64).reshape(n_cells, len(columns) + 1, k)
        for start in range(0, n_cells, 2048):
            part = sums[start : start + 2048]
            mine = lists[of_cell[start : start + 2048]]
            cell, rank = np.nonzero((mine >= 0) & (part[:, 0, :].sum(1) > 0)[:, None])
            if not len(cell):
                continue
            fid = mine[cell, rank]
            inside, whole = part[cell, position[fid] + 1], part[cell, 0]
            arrays = [
                pa.array((cell + start + first).astype(np.int32)),
                pa.array(fid.astype(np.int32)),
                pa.array(rank.astype(np.int32)),
                *[pa.array(inside[:, c]) for c in range(k)],
                *[pa.array(whole[:, c]) for c in range(k)],
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return count


def _names(n_classes: int) -> list[str]:
    k = [*range(n_classes), "m"]
    return [*[f"t{c}" for c in k], *[f"n{c}" for c in k]]


def cell_counts(
    patterns: Patterns, cells: list[Cell], orders: list[Order], limits: list[int],
    disjoint: bool = False, max_cells: int = MAX_CELLS, pick: str | None = None,
) -> DataFrame:
    """``cell, fid, rank, t0.., tm, n0.., nm``: class counts where the test is true, and overall.

    ``cell`` is the position in ``cells``; ``tm`` and ``nm`` count minority rows.  Cell ``i``
    is crossed with the first ``limits[i]`` tests of ``orders[i]``.  ``disjoint`` promises that
    no row lies in two cells.  With ``pick`` rows may be left out that cannot win: by the least
    error of two leaves ("loss") or the greatest information gain ("gain").
    """
    if len(cells) > max_cells:
        raise SearchTooLarge(f"{len(cells)} cells at once (limit {max_cells}); lower max_features or the depth")
    lists, of_cell = _candidate_lists(orders, limits, patterns.n_features)
    if disjoint and len(cells) <= MAX_GROUPED_CELLS:
        return _grouped_counts(patterns, cells, lists[of_cell])
    left, work = plan(patterns, cells, lists, of_cell)
    # A cube costs a copy of each pattern, a product a multiplication per cell and test.
    if len(cells) * patterns.n_features * (patterns.n_classes + 1) <= PRODUCTS_PER_CUBE * len({s for s, _ in work}):
        left, work = list(range(len(cells))), {}
    found = [cube_counts(patterns, lists, of_cell, work, _names(patterns.n_classes), pick)] if work else []
    if left:
        found.append(_product_counts(patterns, [cells[i] for i in left], left, lists, of_cell[left]))
    if not found:
        schema = "cell int, fid int, rank int, " + ", ".join(f"{n} bigint" for n in _names(patterns.n_classes))
        return patterns.df.sparkSession.createDataFrame([], schema)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _product_counts(patterns: Patterns, cells: list[Cell], numbers: list[int], lists: np.ndarray, of_cell: np.ndarray) -> DataFrame:
    """Counts by matrix products over the patterns, for cells on too many or too wide columns."""
    C = patterns.n_classes
    depth = max((len(c.literals) for c in cells), default=0) or 1
    literals = np.full((len(cells), depth), 2 * patterns.n_features, dtype=np.int32)
    for i, cell in enumerate(cells):
        for d, lit in enumerate(cell.literals):
            literals[i, d] = lit - 1 if lit > 0 else patterns.n_features - lit - 1
    # A task has a counter for every cell and every test that any of the lists names.
    width = len(np.unique(lists[lists >= 0])) + 1
    per_scan = max(1, COUNTERS_PER_SCAN // (width * (C + 1)))
    schema = "cell int, fid int, rank int, " + ", ".join(f"{n} bigint" for n in _names(C))
    source = patterns.df.select(*patterns.keys, *patterns.counts)
    products = patterns.n_patterns * len(cells) * (lists.shape[1] + 1) * (C + 1)
    tasks = patterns.df.sparkSession.sparkContext.defaultParallelism
    if products > HEAVY_SCAN and patterns.n_patterns < ROWS_PER_PRODUCT * 16 * tasks:
        # A small table in few files, but much work per row: use all cores.
        source = source.repartition(tasks)
    partial = None
    for start in range(0, len(cells), per_scan):
        stop = min(len(cells), start + per_scan)
        counted = source.mapInArrow(
            _counter(literals[start:stop], lists, of_cell[start:stop], start, patterns.ranges,
                     len(patterns.keys), C),
            schema,
        )
        partial = counted if partial is None else partial.unionByName(counted)
    summed = partial.groupBy("cell", "fid", "rank").agg(*[F.sum(n).alias(n) for n in _names(C)])
    if numbers == list(range(len(numbers))):
        return summed
    numbered = patterns.df.sparkSession.createDataFrame(list(enumerate(numbers)), "at int, cell int")
    return summed.withColumnRenamed("cell", "at").join(numbered, "at").drop("at")


def _grouped_counts(patterns: Patterns, cells: list[Cell], candidates: np.ndarray) -> DataFrame:
    """Counts of cells that do not overlap, without Python.

    Rows are grouped by cell, input column and position: one row per column instead of one sum
    per test.  The sums of a test are those of a range of positions of that small table.
    """
    C = patterns.n_classes
    spark = patterns.df.sparkSession
    counts = [*patterns.counts, "nm"]
    cell = "CASE " + " ".join(
        f"WHEN {patterns.holds(c.literals)} THEN {i}" for i, c in enumerate(cells)
    ) + " END"
    placed = ", ".join(f"struct({i} AS key, {k} AS at)" for i, k in enumerate(patterns.keys))
    histogram = (
        patterns.df.selectExpr(
            f"{cell} AS cell", *patterns.counts, f"{minority_count(patterns.counts)} AS nm",
            f"explode(array({placed})) AS p",
        )
        .where("cell IS NOT NULL")
        .groupBy("cell", "p.key", "p.at").agg(*[F.sum(n).alias(n) for n in counts])
    )
    tests = [
        (i, int(fid), rank, *patterns.ranges[fid])
        for i, row in enumerate(candidates) for rank, fid in enumerate(row) if fid >= 0
    ]
    table = spark.createDataFrame(tests, "cell int, fid int, rank int, key int, low int, high int")
    sums = [F.expr(f"sum(if(at BETWEEN low AND high, {n}, 0L)) AS t{n[1:]}") for n in counts]
    # One row per cell and candidate test, at most MAX_GROUPED_CELLS times the number of tests.
    joined = histogram.join(F.broadcast(table), ["cell", "key"])
    return joined.groupBy("cell", "fid", "rank").agg(*sums, *[F.sum(n).alias(n) for n in counts]).select(
        "cell", "fid", "rank", *_names(C)
    )


def _splitting(counts: DataFrame, n_classes: int) -> tuple[list[str], list[str], DataFrame]:
    """The true and overall counts, and the tests that send rows both ways."""
    t = [f"t{c}" for c in range(n_classes)]
    n = [f"n{c}" for c in range(n_classes)]
    return t, n, counts.where(f"{plus(t)} > 0 AND {plus(t)} < {plus(n)}")


def with_gain(counts: DataFrame, n_classes: int) -> DataFrame:
    """Keep the tests that send rows both ways and add their rounded information gain."""
    t, n, kept = _splitting(counts, n_classes)
    return kept.selectExpr("*", f"round({information_gain(t, n)}, {SCORE_DIGITS}) AS gain")


def with_leaf_loss(counts: DataFrame, n_classes: int, n_rows: int, reg: float) -> DataFrame:
    """Keep the tests that send rows both ways and add the loss of splitting into two leaves."""
    t, n, kept = _splitting(counts, n_classes)
    rest = [f"{w} - {l}" for w, l in zip(n, t)]
    right = f"greatest(0, {', '.join(t)}) + greatest(0, {', '.join(rest)})"
    loss = f"({plus(n)} - ({right})) / {float(n_rows)!r}D + {2.0 * reg!r}D"
    return kept.selectExpr("*", f"round({loss}, {SCORE_DIGITS}) AS loss")


def split_counts(row, n_classes: int) -> tuple[tuple[int, ...], int, tuple[int, ...], int]:
    """True-side counts and minority, false-side counts and minority, out of a result row."""
    t = tuple(row[f"t{c}"] for c in range(n_classes))
    f = tuple(row[f"n{c}"] - row[f"t{c}"] for c in range(n_classes))
    return t, row["tm"], f, row["nm"] - row["tm"]
