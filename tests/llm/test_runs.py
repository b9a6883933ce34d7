"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest

from arborfair.llm import periodic_runs, queries
from arborfair.llm.words import find_words


def brute(words):
    """(start, length, period) of all maximal runs."""
    out, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(12, 2 * q) and (i, n) not in seen:
                seen.add((i, n))
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(words):
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return [str(i.bit_count() % 2) for i in range(n)]


@pytest.fixture(scope="module")
def sequences():
    rnd = random.Random(9)
    out = [[], ["x"], ["x"] * 11, ["x"] * 12, ["x"] * 500, fibonacci(700), thue_morse(600), ["a", "b"] * 6, ["a", "b", "c"] * 4 + ["a"]]
    for _ in range(150):
        size, n = rnd.choice([1, 2, 3, 60]), rnd.randrange(200)
        words = [str(rnd.randrange(size)) for _ in range(n)]
        if n > 30 and rnd.random() < 0.6:
            a, p = rnd.randrange(n - 12), rnd.randrange(1, 40)
            words = [w if i < a + p else words[a + (i - a) % p] for i, w in enumerate(words)]
        out.append(words)
    return out


@pytest.mark.parametrize("tile", [32, 64, 128])
def test_tiles_stitch_to_the_runs_of_the_whole(sequences, tile):
    for words in sequences:
        h = find_words(pa.array([" ".join(words)])).hash
        parts = [np.empty((3, 0), np.int64)]
        for low, high, a, b in periodic_runs.tiles_of(len(h), tile):
            q, lo, hi = periodic_runs.fragments(h[a:b], low, high)
            parts.append(np.stack([q, lo + a, hi + a]))
        q, lo, hi = periodic_runs._merged(*np.concatenate(parts, axis=1))
        runs = [(s, e + p - s, p) for p, s, e in zip(q.tolist(), lo.tolist(), hi.tolist()) if e + p - s >= max(12, 2 * p)]
        assert sorted(runs, key=lambda r: (r[0], r[2])) == brute(words)


@pytest.mark.parametrize("tile", [32, 8192])
def test_digest(spark, sequences, tile):
    texts = [" \t".join(w) + "\n" if w else None for w in sequences]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = periodic_runs.find_runs(docs, tile=tile)
    got = {r[0]: tuple(r)[1:] for r in periodic_runs.digest(found).collect()}
    assert got == {i: expected(w) for i, w in enumerate(sequences)}
    kept = {r["id"]: r["text"] for r in periodic_runs.collapse(found).collect()}
    assert set(kept) == {i for i, w in enumerate(sequences) if brute(w)}
    assert all(hashlib.sha256(t.encode()).hexdigest() == got[i][-1] for i, t in kept.items())


def test_odd_rows(spark, odd_docs, odd_rows):
    got = sorted(periodic_runs.digest(periodic_runs.find_runs(odd_docs)).collect(), key=str)
    long_text = [i for i, (k, _) in enumerate(odd_rows) if k == 300]
    want = sorted(((i, *expected(plain.words(t))) for k, (i, t) in enumerate(odd_rows) if k not in long_text), key=str)
    assert [tuple(r) for r in got if r[0] != 300] == want
    assert len(got) == len(odd_rows)


def test_long_text_in_parts(spark):
    """A text of many parts, with runs across them and a period beyond any octave of the first tiles."""
    rnd = random.Random(2)
    block = [f"w{rnd.randrange(10**6)}" for _ in range(90_000)]
    words = block + block + ["y"] * 40_000 + block[:50]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "one")], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in periodic_runs.digest(periodic_runs.find_runs(docs)).collect()}
    kept = " ".join(block + ["y"] + block[:50])
    listed = f"0,180000,90000\n180000,40000,1\n"
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    assert got[1] == (2, 0, 180_000, 90_000, 2000, *sha)
    assert got[2] == expected(["one"])


def test_empty_table(spark, no_docs):
    assert periodic_runs.digest(periodic_runs.find_runs(no_docs)).collect() == []


def test_query_against_all_periods(spark):
    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r)[1:] for r in queries.op12_tiled_periodic_runs(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        words = plain.words(text)
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        if n <= 3000:
            assert got[i] == expected(words)
