"""Plain definitions of what the text operators compute, for small inputs."""

import re
from collections import Counter
from itertools import combinations

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return BLANK.findall(text or "")


def windows(seq, n):
    return [tuple(seq[i:i + n]) for i in range(len(seq) - n + 1)]


def without_repeats(texts, n):
    """(words, removed, kept text) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(w for s in split for w in windows(s, n))
    out = []
    for s in split:
        gone = {i + j for i, w in enumerate(windows(s, n)) if seen[w] > 1 for j in range(n)}
        out.append((len(s), len(gone), " ".join(w for i, w in enumerate(s) if i not in gone)))
    return out


def shingles(text, n=2):
    w = words(lower(text))
    return set(windows(w, n)) if len(w) >= n else {tuple(w)} - {()}


def classes(sets):
    """The least linked position of each set."""
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            label[y] = x
    return [root(i) for i in range(len(sets))]


def hits(text, items, n=10):
    """Words, words hit, and ids of the items that hit."""
    w = PLAIN.findall(lower(text))
    marked, ids = set(), set()
    for item, passage in items:
        p = PLAIN.findall(lower(passage))
        m = min(n, len(p))
        patterns = set(windows(p, m)) if m else set()
        for i, win in enumerate(windows(w, m) if m else []):
            if win in patterns:
                marked |= set(range(i, i + m))
                ids.add(item)
    return len(w), len(marked), ids


def base_counts(text):
    text = text or ""
    w = words(text)
    tri = Counter(windows(w, 3))
    repeated = {i + j for i, t in enumerate(windows(w, 3)) if tri[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)
