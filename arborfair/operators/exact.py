"""Trees of smallest ``errors / rows + reg * leaves``, by dynamic programming over cells.

Cells are expanded level by level: one Spark job counts all cells of a level against all
tests.  A cell is one set of literals, so paths that reach the same rows in another order
share it.  On the last level Spark itself picks the best test of each cell, and one row per
cell comes back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..functions.expressions import SCORE_DIGITS
from .cells import MAX_CELLS, Cell, Order, SearchTooLarge, cell_counts, split_counts, with_gain, with_leaf_loss
from .greedy import can_improve, grow, level_candidates
from .patterns import Patterns
from .tree import count_errors, count_leaves, leaf_of, split_of

BOUND_SLACK = 1e-9  # far above what rounding does to a loss
CHILDREN_PER_CELL = 10  # splits of an inner level that may come to the driver, per allowed cell


def search(
    patterns: Patterns,
    roots: list[Cell],
    depths: Sequence[int],
    reg: float,
    max_features: int = 0,
    remaining: int = 0,
    narrow: bool = False,
    max_cells: int = MAX_CELLS,
    disjoint: bool = False,
    incumbent: float | None = None,
    opened: list[int] | None = None,
) -> list[tuple]:
    """One optimal subtree per root cell, with at most ``depths[i]`` splits on a path.

    With ``remaining > 0`` every cell that uses up its depth is completed by a greedy tree of
    budget ``remaining`` and counted at that tree's loss.  Equal losses are decided for the
    leaf first, then for the lowest test rank.  ``max_features`` ranks the tests on the rows
    of each root; ``narrow`` gives lower levels only the first of them.  ``disjoint`` promises
    that the roots share no rows.

    Splits that cannot win are not followed: the least loss that both sides can reach is above the
    leaf of the node, above another split of it into two leaves, or, at a single root, above
    ``incumbent``, the loss of any tree of this search.  ``opened`` is filled with the cells counted per level.
    """
    n_rows, C, n_features = patterns.n_rows, patterns.n_classes, patterns.n_features
    orders = [Order() for _ in roots]
    disjoint = disjoint or len(roots) == 1
    ranking = 0 < max_features < n_features

    # cells[level][(root, literal set)]; splits holds the children of each expanded cell.
    levels: list[dict] = [{(i, frozenset(c.literals)): c for i, c in enumerate(roots)}]
    splits: list[dict] = []
    best: dict[tuple[int, int, frozenset], tuple] = {}
    boundary: dict[tuple[int, frozenset], Cell] = {}
    level = 0
    while levels[level]:
        splits.append({})
        nxt: dict = {}
        open_cells = []
        for key, cell in levels[level].items():
            left = depths[key[0]] - level
            if left == 0 and remaining > 0:
                boundary[key] = cell
            elif left > 0 and cell.n >= 2 and n_features and can_improve(cell, n_rows, reg):
                open_cells.append((key, cell))
        if len(open_cells) > max_cells:
            raise SearchTooLarge(
                f"level {level} needs {len(open_cells)} cells (limit {max_cells}); "
                "lower max_features or the depth"
            )
        if level == 0 and ranking and open_cells:
            # Ranking the tests of a root counts all of them, so the first level is known with it.
            tried = ranked_splits(patterns, [c for _, c in open_cells], max_features, disjoint, max_cells)
            for (key, _), (order, children) in zip(open_cells, tried):
                orders[key[0]] = order
                splits[0][key] = children
            if opened is not None:
                opened.append(len(open_cells))
            open_cells = []
        elif opened is not None:
            opened.append(len(open_cells))
        # The last level of a root needs no children: two leaves per test decide it.
        last = [o for o in open_cells if depths[o[0][0]] - level == 1 and remaining == 0]
        inner = [o for o in open_cells if not (depths[o[0][0]] - level == 1 and remaining == 0)]
        for group, is_last in ((last, True), (inner, False)):
            if not group:
                continue
            limits = [
                level_candidates(orders[k[0]].size(n_features), depths[k[0]] - level, depths[k[0]])
                if narrow else orders[k[0]].size(n_features)
                for k, _ in group
            ]
            if not is_last and sum(limits) > CHILDREN_PER_CELL * max_cells:
                raise SearchTooLarge(
                    f"level {level} has {sum(limits)} splits to try; lower max_features or the depth"
                )
            counts = cell_counts(
                patterns, [c for _, c in group], [orders[k[0]] for k, _ in group], limits,
                disjoint=level == 0 and disjoint, max_cells=max_cells, pick="loss" if is_last else None,
            )
            if is_last:
                picked = with_leaf_loss(counts, C, n_rows, reg).groupBy("cell").agg(
                    F.min_by(F.struct("*"), F.struct("loss", "rank")).alias("best")
                ).select("best.*")
            else:
                picked = with_gain(counts, C)
            for row in picked.collect():
                key, cell = group[row["cell"]]
                t, tm, f, fm = split_counts(row, C)
                a, b = cell.child(row["fid"], True, t, tm), cell.child(row["fid"], False, f, fm)
                if is_last:
                    sub = split_of(row["fid"], leaf_of(a), leaf_of(b))
                    best[(level, *key)] = _smaller(sub, leaf_of(cell), n_rows, reg)
                else:
                    splits[level].setdefault(key, []).append((row["rank"], row["fid"], a, b))
        for key, children in splits[level].items():
            limit = incumbent if level == 0 and len(roots) == 1 else None
            splits[level][key] = kept = _promising(levels[level][key], children, n_rows, reg, limit)
            for _rank, _fid, a, b in kept:
                for child in (a, b):
                    nxt.setdefault((key[0], frozenset(child.literals)), child)
        levels.append(nxt)
        level += 1

    if boundary:
        # One greedy tree per set of rows, whichever order of tests leads to it.
        keys = list(boundary)
        trees = grow(patterns, [boundary[k] for k in keys], [remaining] * len(keys), reg, max_features, max_cells=max_cells)
        for key, sub in zip(keys, trees):
            best[(depths[key[0]], *key)] = sub

    for lev in range(level - 1, -1, -1):
        for key, cell in levels[lev].items():
            if (lev, *key) in best:
                continue
            choice, choice_loss = leaf_of(cell), _loss(leaf_of(cell), n_rows, reg)
            for _rank, fid, a, b in sorted(splits[lev].get(key, []), key=lambda s: s[0]):
                sub = split_of(
                    fid,
                    best[(lev + 1, key[0], frozenset(a.literals))],
                    best[(lev + 1, key[0], frozenset(b.literals))],
                )
                loss = _loss(sub, n_rows, reg)
                if loss < choice_loss:
                    choice, choice_loss = sub, loss
            best[(lev, *key)] = choice
    return [best[(0, i, frozenset(c.literals))] for i, c in enumerate(roots)]


def _promising(cell: Cell, children: list[tuple], n_rows: int, reg: float, incumbent: float | None) -> list[tuple]:
    """The splits whose two sides can reach a loss that is not above what the node has anyway."""
    known = [cell.errors / n_rows + reg, *((a.errors + b.errors) / n_rows + 2 * reg for _, _, a, b in children)]
    upper = min(known if incumbent is None else [*known, incumbent]) + BOUND_SLACK

    def least(c: Cell) -> float:
        return min(c.errors / n_rows + reg, c.minority / n_rows + 2 * reg)

    return [x for x in children if least(x[2]) + least(x[3]) <= upper]


def _loss(sub: tuple, n_rows: int, reg: float) -> float:
    return round(count_errors(sub) / n_rows + reg * count_leaves(sub), SCORE_DIGITS)


def _smaller(sub: tuple, other: tuple, n_rows: int, reg: float) -> tuple:
    return sub if _loss(sub, n_rows, reg) < _loss(other, n_rows, reg) else other


def ranked_splits(
    patterns: Patterns, cells: list[Cell], max_features: int, disjoint: bool = False, max_cells: int = MAX_CELLS
) -> list[tuple[Order, list[tuple]]]:
    """Per cell its ``max_features`` tests of largest gain (all, in natural order, for 0) and
    ``(rank, fid, true side, false side)`` of each that splits it: cells x tests rows."""
    size, C = patterns.n_features, patterns.n_classes
    if len(cells) * size > CHILDREN_PER_CELL * max_cells:
        raise SearchTooLarge(f"{len(cells)} cells with {size} tests each cannot be ranked at once")
    counts = cell_counts(patterns, cells, [Order()] * len(cells), [size] * len(cells), disjoint)
    found: list[list] = [[] for _ in cells]
    for row in with_gain(counts, C).collect():
        found[row["cell"]].append(row)
    ranking = 0 < max_features < size
    result = []
    for cell, rows in zip(cells, found):
        rows.sort(key=lambda r: (-r["gain"], r["fid"]) if ranking else r["fid"])
        order = Order()
        if ranking:
            rows = rows[:max_features]
            fids = [r["fid"] for r in rows]
            # Tests that do not split the cell fill the list up to its size.
            rest = [f for f in range(size) if f not in set(fids)]
            order = Order(fids + rest[: max_features - len(fids)])
        children = []
        for rank, r in enumerate(rows):
            t, tm, f, fm = split_counts(r, C)
            children.append((rank, r["fid"], cell.child(r["fid"], True, t, tm), cell.child(r["fid"], False, f, fm)))
        result.append((order, children))
    return result
