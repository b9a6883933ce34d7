"""What the learners promise, by enumeration, for tables of a few hundred rows."""

import itertools
import math

import numpy as np


def counts(y, k):
    return np.bincount(y, minlength=k)


def entropy(y, k):
    n = len(y)
    return -sum(c / n * math.log2(c / n) for c in counts(y, k) if c) if n else 0.0


def gain(x, y, k):
    n = len(y)
    return round(entropy(y, k) - x.sum() / n * entropy(y[x], k) - (~x).sum() / n * entropy(y[~x], k), 12)


def leaf(y, k):
    c = counts(y, k)
    return ("leaf", int(c.argmax()), int(len(y) - c.max()))


def size(t):
    return 1 if t[0] == "leaf" else size(t[2]) + size(t[3])


def errors(t):
    return t[2] if t[0] == "leaf" else errors(t[2]) + errors(t[3])


def loss(t, n, reg):
    return round(errors(t) / n + reg * size(t), 12)


def shape(t):
    return f"={t[1]}" if t[0] == "leaf" else f"{t[1]}({shape(t[2])},{shape(t[3])})"


def all_gains(X, y, k):
    """The gain of every test at once, from a table of counts; -1 where a test does not split."""
    true = X.T.astype(float) @ np.eye(k)[y]
    whole = np.bincount(y, minlength=k).astype(float)

    def bits(c):
        share = c / np.maximum(c.sum(axis=-1, keepdims=True), 1)
        return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=-1) * c.sum(axis=-1)

    found = np.round((bits(whole) - bits(true) - bits(whole - true)) / max(len(y), 1), 12)
    sides = true.sum(axis=1)
    return np.where((sides > 0) & (sides < len(y)), found, -1.0)


def ranked(X, y, k, top):
    """The tests in play: all of them, or the ``top`` of largest gain."""
    tests = np.arange(X.shape[1])
    return tests.tolist() if not 0 < top < len(tests) else tests[np.argsort(-all_gains(X, y, k), kind="stable")][:top].tolist()


def grown(X, y, k, budget, tests):
    """The greedy tree before any split is taken back: node path -> (rows, its test or None), level by level."""
    nodes, level = {}, {"": np.arange(len(y))}
    for left in range(budget, 0, -1):
        below = {}
        allowed = tests if left == budget else tests[:max(5, int(len(tests) * left / budget))]
        for path, rows in level.items():
            gains = all_gains(X[rows], y[rows], k)[allowed] if left > 1 and len(rows) > 1 and allowed else np.array([-1.0])
            test = allowed[int(gains.argmax())] if gains.max() > -1 else None
            nodes[path] = rows, test
            if test is not None:
                below[path + "T"], below[path + "F"] = rows[X[rows, test]], rows[~X[rows, test]]
        level = below
    return nodes or {"": (np.arange(len(y)), None)}


def cut_back(nodes, y, k, path=""):
    """Every tree that results from taking back some splits."""
    rows, test = nodes[path]
    yield leaf(y[rows], k)
    if test is not None:
        for a, b in itertools.product(cut_back(nodes, y, k, path + "T"), cut_back(nodes, y, k, path + "F")):
            yield ("split", test, a, b)


def greedy(X, y, k, budget, reg, n, top=0):
    """Of all ways to cut back the greedy tree, the one of smallest loss, then of fewest leaves."""
    nodes = grown(X, y, k, budget, ranked(X, y, k, top))
    return min(cut_back(nodes, y, k), key=lambda t: (loss(t, n, reg), size(t)))


def optimal(X, y, k, depth, reg, n, top=0, remaining=0):
    order = ranked(X, y, k, top)

    def solve(X, y, depth):
        best = leaf(y, k)
        if depth == 0 and remaining > 0:
            return greedy(X, y, k, remaining, reg, n, top)
        if depth == 0 or len(y) < 2:
            return best
        for f in order:
            x = X[:, f]
            if 0 < x.sum() < len(y):
                sub = ("split", f, solve(X[x], y[x], depth - 1), solve(X[~x], y[~x], depth - 1))
                if loss(sub, n, reg) < loss(best, n, reg):
                    best = sub
        return best

    return solve(X, y, depth)


def rollout(X, y, k, depth, reg, n, top=0):
    """The tree whose every split has the least sum of greedy losses on its sides, below the loss of the leaf."""
    chosen, waiting = {}, [("", np.arange(len(y)), depth)]
    while waiting:
        path, rows, left = waiting.pop()
        here, there = X[rows], y[rows]
        tests = ranked(here, there, k, top) if left > 0 and len(rows) > 1 else []
        totals = {f: round(sum(loss(greedy(here[side], there[side], k, left - 1, reg, n, top), n, reg)
                               for side in (here[:, f], ~here[:, f])), 12)
                  for f in tests if 0 < here[:, f].sum() < len(rows)}
        best = min(totals.values(), default=math.inf)
        if best < loss(leaf(there, k), n, reg):
            test = next(f for f in tests if totals.get(f) == best)
            waiting += [(path + "T", rows[here[:, test]], left - 1), (path + "F", rows[~here[:, test]], left - 1)]
            chosen[path] = rows, test
        else:
            chosen[path] = rows, None
    return max(cut_back(chosen, y, k), key=size)  # nothing is taken back


def from_tree(tree, path=""):
    """A fitted tree in the same shape."""
    node = tree.nodes[path]
    if node.is_leaf:
        return ("leaf", int(node.prediction), None)
    return ("split", node.fid, from_tree(tree, path + "T"), from_tree(tree, path + "F"))


# -- CART on raw columns -------------------------------------------------------------------


def gini(y):
    n = len(y)
    return 1 - sum((c / n) ** 2 for c in np.unique(y, return_counts=True)[1]) if n else 0.0


def var(y):
    return float(np.var(y)) if len(y) else 0.0


def cart(rows, y, numeric, categorical, impurity, depth, min_split, min_leaf, k, scale=None):
    """``rows``: dict of arrays (None or NaN is missing).  Returns nested tuples."""
    n = len(y)
    value = float(y.mean()) if impurity is var else int(np.bincount(y).argmax())
    scale = scale if scale is not None else impurity(y)
    if depth == 0 or n < min_split or impurity(y) <= 1e-12 * scale:
        return ("leaf", value)
    parent = impurity(y)
    unit = parent if impurity is var else 1.0
    best, pick = 0.0, None

    def consider(left, what):
        nonlocal best, pick
        if left.sum() < min_leaf or (~left).sum() < min_leaf:
            return
        g = parent - left.mean() * impurity(y[left]) - (~left).mean() * impurity(y[~left])
        g = round(g / unit, 12)
        if g > best:
            best, pick = g, (what, left)

    for c in numeric:
        v = rows[c]
        distinct = np.unique(v[~np.isnan(v)])
        for a, b in zip(distinct, distinct[1:]):
            t = (a + b) / 2
            consider(np.nan_to_num(v, nan=np.inf) <= t, (c, t))
    for c in categorical:
        v = rows[c]
        cats = sorted({x for x in v if x is not None})
        if impurity is var or k == 2:
            ordered = sorted(cats, key=lambda x: (round(float(y[v == x].mean()), 12), x))
            sets = [ordered[:i] for i in range(1, len(ordered))]
        else:
            sets = [s for r in range(1, len(cats) // 2 + 1) for s in itertools.combinations(cats, r)]
        for s in sets:
            consider(np.isin(v.astype(str), list(s)) & (v != None), (c, tuple(sorted(s))))  # noqa: E711
    if pick is None:
        return ("leaf", value)
    what, left = pick
    parts = [({c: v[m] for c, v in rows.items()}, y[m]) for m in (left, ~left)]
    return ("split", what, *[
        cart(r, t, numeric, categorical, impurity, depth - 1, min_split, min_leaf, k, scale) for r, t in parts])


def from_cart(tree, path=""):
    node = tree.nodes[path]
    if node.is_leaf:
        return ("leaf", node.prediction)
    what = (node.feature, node.threshold if node.is_numeric else tuple(sorted(node.left_categories)))
    return ("split", what, from_cart(tree, path + "L"), from_cart(tree, path + "R"))
