"""Class counts of cells from summed histograms of positions.

A cell restricts a few input columns, and a test one more.  The histogram of the positions in just these columns is a small
dense cube, however many rows the table has.  Summed up along every axis, it gives the class counts of any box by
inclusion and exclusion: the rows are read once per frontier, and the cells never touch them.  A set of columns whose
cube would have more than ``CUBE_ENTRIES`` is left to the caller.

Literals on one column intersect to an interval of positions; the false side of a category test takes one position out, so a
column is a sum of signed intervals.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import Patterns, minority_count

#: Positions of one summed cube: three columns of 60 thresholds, or more columns with fewer.
CUBE_ENTRIES = 1 << 18
#: Cells that one task looks up in a cube, and at a time.
CELLS_PER_TASK = 8192
CELLS_PER_STEP = 1024
#: Signed boxes that one cell may take.
MAX_BOXES = 256


def column_sizes(patterns: Patterns) -> list[int]:
    """Positions of each input column, the one of no true test included."""
    sizes: dict[int, int] = {}
    for column, _low, high in patterns.ranges:
        sizes[column] = max(sizes.get(column, 0), high + 1)
    return [sizes[i] for i in range(len(sizes))]


def _boxes(patterns: Patterns, sizes: list[int], literals: tuple[int, ...]) -> list[tuple[int, dict[int, tuple[int, int]]]] | None:
    """A cell as signed boxes; ``None`` if that takes too many."""
    spans: dict[int, tuple[int, int]] = {}
    out: dict[int, set[int]] = {}
    for lit in literals:
        column, low, high = patterns.ranges[abs(lit) - 1]
        a, b = spans.get(column, (0, sizes[column] - 1))
        if lit > 0:
            spans[column] = max(a, low), min(b, high)
        elif high == sizes[column] - 1:
            spans[column] = a, min(b, low - 1)
        elif low == high:
            spans[column] = a, b
            out.setdefault(column, set()).add(low)
        else:
            return None
    columns, count = [], 1
    for column, (a, b) in spans.items():
        choices = [(1, (a, b))] + [(-1, (p, p)) for p in sorted(out.get(column, ())) if a <= p <= b]
        count *= len(choices)
        columns.append((column, choices))
    if count > MAX_BOXES:
        return None
    found = []
    for picked in product(*(c for _, c in columns)):
        sign = 1
        for s, _ in picked:
            sign *= s
        found.append((sign, {c: span for (c, _), (_, span) in zip(columns, picked)}))
    return found


def plan(patterns: Patterns, cells: Sequence, lists: np.ndarray, of_cell: np.ndarray) -> tuple[list[int], dict]:
    """The cells that no set of cubes can answer, and the work: ``{(columns, test column): [(cell, boxes)]}``."""
    sizes = column_sizes(patterns)
    columns_of_list = [sorted({patterns.ranges[f][0] for f in fids if f >= 0}) for fids in lists.tolist()]
    fits: dict[tuple[int, ...], bool] = {}
    left, work = [], {}
    for i, cell in enumerate(cells):
        boxes = _boxes(patterns, sizes, cell.literals)
        mine = {c for _, box in boxes or () for c in box}
        sets = [(tuple(sorted(mine | {c})), c) for c in columns_of_list[of_cell[i]]]
        for s, _ in sets:
            if s not in fits:
                fits[s] = float(np.prod([sizes[c] + 1.0 for c in s])) <= CUBE_ENTRIES
        if boxes is None or not all(fits[s] for s, _ in sets):
            left.append(i)
            continue
        for key in sets:
            work.setdefault(key, []).append((i, boxes))
    return left, work


def cube_counts(patterns: Patterns, lists: np.ndarray, of_cell: np.ndarray, work: dict, names: list[str],
                pick: str | None = None) -> DataFrame:
    """``cell, fid, rank`` and the counts ``names`` (true side, then whole cell) of every cell and candidate test of ``work``.

    ``pick`` leaves, per cell and input column, only the test of least error when its sides are leaves ("loss"), or those
    whose information gain may be the greatest ("gain": rounding is left to the caller)."""
    sizes, C = column_sizes(patterns), patterns.n_classes
    sets = list(dict.fromkeys(s for s, _ in work))
    tasks = _tasks(patterns, sets, work, sizes, lists, of_cell)

    # Positions of a set as one number per row; rows that agree are added up before the shuffle.
    copies = {s: 1 + max(t[0] for t in tasks if t[1] == s) for s in sets}
    placed = ", ".join(
        f"struct({i} AS set, {' + '.join(f'k{c} * {stride}L' for c, stride in _strides(s, sizes)) or '0L'} AS at)" for i, s in enumerate(sets))
    counts = [*patterns.counts, "nm"]
    cubes = (
        patterns.df.selectExpr(*patterns.counts, f"{minority_count(patterns.counts)} AS nm", f"explode(array({placed})) AS p")
        .groupBy("p.set", "p.at").agg(*[F.sum(n).alias(n) for n in counts])
    )
    # Several tasks may look up cells in one cube.
    many = "CASE set " + " ".join(f"WHEN {i} THEN {copies[s]}" for i, s in enumerate(sets)) + " END"
    dealt = cubes.selectExpr("*", f"explode(sequence(0, {many} - 1)) AS part").repartition(max(1, len(tasks)), "set", "part")
    by_key = {(sets.index(s), part): jobs for part, s, jobs in tasks}
    shapes = [tuple(sizes[c] for c in s) for s in sets]

    # Refers to nothing but numpy, pyarrow and the arrays above, so executors need no package.
    def look_up(key: tuple, rows: pa.Table) -> pa.Table:
        number, part = key[0].as_py(), key[1].as_py()
        shape = shapes[number]
        cube = np.zeros((int(np.prod(shape)), C + 1), np.int64)
        cube[rows.column("at").to_numpy()] = np.stack([rows.column(n).to_numpy() for n in counts], 1)
        summed = np.zeros((*[n + 1 for n in shape], C + 1), np.int64)
        summed[tuple(slice(1, None) for _ in shape)] = cube.reshape(*shape, C + 1)
        for axis in range(len(shape)):
            np.cumsum(summed, axis=axis, out=summed)
        out = []
        for axis, cell_of, list_of, box_cell, sign, low, high, fids, t_low, t_high, rank_of in by_key[number, part]:
            turned = np.moveaxis(summed, axis, -2)  # the other axes, the tested one, counts
            others = [d for d in range(len(shape)) if d != axis]
            stretch = shape[axis] + 1
            flat = turned.reshape(-1, stretch, C + 1)
            steps = np.array([int(np.prod([shape[d] + 1 for d in others[k + 1:]])) for k in range(len(others))], np.int64)
            for start in range(0, len(cell_of), CELLS):
                some = slice(start, min(len(cell_of), start + CELLS))
                first, last = np.searchsorted(box_cell, [some.start, some.stop])
                begin = np.searchsorted(box_cell[first:last], np.arange(some.start, some.stop))
                mine, lo, hi = sign[first:last, None, None], low[first:last].astype(np.int64), high[first:last].astype(np.int64)
                lines = np.zeros((last - first, stretch, C + 1), np.int64)
                for corner in range(1 << len(others)):
                    place, parity = np.zeros(last - first, np.int64), 1
                    for k, d in enumerate(others):
                        if corner >> k & 1:
                            place += steps[k] * lo[:, d]
                            parity = -parity
                        else:
                            place += steps[k] * (hi[:, d] + 1)
                    lines += parity * flat[place]
                a = np.maximum(t_low, lo[:, axis, None])
                b = np.maximum(np.minimum(t_high, hi[:, axis, None]) + 1, a)
                rows_of = np.arange(last - first)[:, None]
                inside = np.add.reduceat(mine * (lines[rows_of, b] - lines[rows_of, a]), begin)
                ends = [lines[rows_of, x] for x in (lo[:, axis, None], hi[:, axis, None] + 1)]
                whole = np.add.reduceat(mine * (ends[1] - ends[0]), begin)
                number_of = cell_of[some]
                rank = rank_of[list_of[some]]
                n_true, n_all = inside[..., :C].sum(-1), whole[..., :C].sum(-1)
                splits = (rank >= 0) & (n_true > 0) & (n_true < n_all)
                rest = whole[..., :C] - inside[..., :C]
                if pick == "loss":
                    right = inside[..., :C].max(-1) + rest.max(-1)
                    score = np.where(splits, -right * (rank_of.max(initial=0) + 2) + rank, np.iinfo(np.int64).max)
                    take = splits & (score == score.min(1, keepdims=True))
                elif pick == "gain":
                    gain = np.where(splits, -entropy(inside[..., :C]) - entropy(rest), -np.inf)
                    take = splits & (gain >= gain.max(1, keepdims=True) - 1e-7 * np.maximum(n_all, 1))
                else:
                    take = (rank >= 0) & (n_all > 0)
                i, j = np.nonzero(take)
                found = np.concatenate([inside[i, j], whole[i, 0]], axis=1)
                out.append((number_of[i], fids[j], rank[i, j], found))
        cell, fid, rank, found = (np.concatenate(x) for x in zip(*out))
        arrays = [pa.array(x.astype(np.int32)) for x in (cell, fid, rank)] + [pa.array(found[:, k]) for k in range(found.shape[1])]
        return pa.Table.from_arrays(arrays, names=["cell", "fid", "rank", *names])

    def entropy(n):
        """Rows times the entropy of their classes."""
        total = n.sum(-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return total * np.log2(np.maximum(total, 1)) - np.where(n > 0, n * np.log2(np.maximum(n, 1)), 0).sum(-1)

    CELLS = CELLS_PER_STEP
    schema = "cell int, fid int, rank int, " + ", ".join(f"{n} bigint" for n in names)
    return dealt.groupBy("set", "part").applyInArrow(look_up, schema)


def _strides(columns: tuple[int, ...], sizes: list[int]) -> list[tuple[int, int]]:
    out, stride = [], 1
    for c in reversed(columns):
        out.append((c, stride))
        stride *= sizes[c]
    return out


def _tasks(patterns: Patterns, sets: list, work: dict, sizes: list[int], lists: np.ndarray, of_cell: np.ndarray) -> list[tuple]:
    """``(part, columns, jobs)``: the cells of every set of columns, ``CELLS_PER_TASK`` per task."""
    rank_of = np.full((len(lists), patterns.n_features), -1, np.int64)
    for i, fids in enumerate(lists):
        for rank, fid in enumerate(fids.tolist()):
            if fid >= 0:
                rank_of[i, fid] = rank
    tests: dict[int, list[int]] = {}
    for fid, (column, _, _) in enumerate(patterns.ranges):
        tests.setdefault(column, []).append(fid)

    def job(s: tuple, c: int, asked: list) -> tuple:
        fids = np.array(tests[c], np.int32)
        t_low, t_high = (np.array([patterns.ranges[f][k] for f in tests[c]], np.int64) for k in (1, 2))
        cell_of = np.array([i for i, _ in asked], np.int32)
        boxes = [(k, sign, box) for k, (_, found) in enumerate(asked) for sign, box in found]
        low = np.array([[box.get(d, (0, 0))[0] for d in s] for _, _, box in boxes], np.int32).reshape(len(boxes), len(s))
        high = np.array([[box[d][1] if d in box else sizes[d] - 1 for d in s] for _, _, box in boxes], np.int32).reshape(len(boxes), len(s))
        high = np.maximum(high, low - 1)  # contradicting literals are an empty interval
        return (s.index(c), cell_of, of_cell[cell_of], np.array([k for k, _, _ in boxes], np.int32), np.array([g for _, g, _ in boxes], np.int64),
               low, high, fids, t_low, t_high, rank_of[:, fids])

    # One part has up to CELLS_PER_TASK look-ups in its set's cube, in all of its columns.
    parts: dict[tuple, list[tuple[int, list]]] = {}
    for (s, c), asked in work.items():
        mine = parts.setdefault(s, [])
        for start in range(0, len(asked), CELLS_PER_TASK):
            some = asked[start:start + CELLS_PER_TASK]
            if not mine or mine[-1][0] + len(some) > CELLS_PER_TASK:
                mine.append((0, []))
            mine[-1] = mine[-1][0] + len(some), [*mine[-1][1], (c, some)]
    out = []
    for s, mine in parts.items():
        for part, (_, jobs) in enumerate(mine):
            out.append((part, s, [job(s, c, asked) for c, asked in jobs]))
    return out
