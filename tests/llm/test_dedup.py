import hashlib
import random
from collections import Counter

import plain

from arborfair.llm import bottomk, repeats
from arborfair.llm.common import PIECE_BYTES  # noqa: F401
from arborfair.llm.components import components


def _random_texts(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    shared = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(4, 30))] for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [[rnd.choice(vocabulary) + str(rnd.randrange(9)) for _ in range(rnd.randrange(12))]]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(shared), [rnd.choice(vocabulary) for _ in range(rnd.randrange(8))]]
        out.append(" ".join(w for p in parts for w in p))
    return out


def _cut(df, **options):
    return [(r.doc_id, r.text, tuple(r.cut)) for r in repeats.remove_repeats(df, name="cut", **options).collect()]


def test_repeats_against_all_windows(spark):
    for seed, slice_bytes, vocabulary in ((1, 1 << 20, 1 << 18), (2, 300, 40), (3, 900, 7)):
        texts = _random_texts(seed)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {i: c for i, _, c in _cut(df, window=7, phrase=3, slice_bytes=slice_bytes, vocabulary=vocabulary)}
        assert got == dict(enumerate(plain.without_repeats(texts, 7)))


def test_repeats_of_odd_rows(odd_docs, odd_rows, no_docs):
    want = Counter(zip(odd_rows, plain.without_repeats([t for _, t in odd_rows], 35)))
    cut = repeats.remove_repeats(odd_docs)
    got = Counter(((r.doc_id, r.text), tuple(r.repeats_)) for r in cut.collect())
    assert got == want
    assert cut.columns[:-1] == odd_docs.columns
    digest = {r.doc_id: r for r in repeats.digest(repeats.remove_repeats(odd_docs.select("doc_id", "text"), name="repeats")).collect()}
    assert digest[2].kept_sha256 == hashlib.sha256(b"").hexdigest() and digest[2].n_words == 0
    assert digest[200].n_removed == digest[200].n_words == 400
    assert repeats.remove_repeats(no_docs).collect() == []


def test_hot_copies_are_dealt_out(spark):
    rows = [(i, "p q r s t u v w x y" if i % 3 == 0 else f"only {i} text {i} here {i} now") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {i: c for i, _, c in _cut(df, window=6, phrase=2, slice_bytes=500)}
    assert got == dict(enumerate(plain.without_repeats([t for _, t in rows], 6)))


def _edited(seed):
    rnd = random.Random(seed)
    rows = []
    for g in range(14):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([3, 8, 25, 60, 150]))]
        for _ in range(rnd.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(rnd.randrange(1 + len(w) // 12)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10 ** 6)}"
            if rnd.random() < 0.3:
                base = w  # a chain: what is far from the first may still be near the last
            rows.append(" ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    passage = [f"p{i}" for i in range(40)]
    rows += [" ".join([f"a{k}b{i}" for i in range(30)] + passage) for k in range(40)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_against_all_pairs(spark):
    for seed, n in ((1, 2), (2, 2), (1, bottomk.SHINGLE)):
        rows = _edited(seed)
        sets = [plain.shingles(t, n) for _, t in rows]
        label = plain.classes(sets)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bottomk.near_duplicates(df, shingle=n).collect()}
        assert got == {i: (len(sets[i]), label[i], label[i] == i) for i, _ in rows}


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = bottomk.near_duplicates(odd_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in (0, 1, 2):
        assert (by_id[i].n_shingles, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert by_id[3].n_shingles == 1 and by_id[3].kept
    assert by_id[201].component_id == by_id[202].component_id == 200 and not by_id[202].kept
    assert bottomk.near_duplicates(no_docs).collect() == []


def test_later_rounds_read_open_lists_and_asked_texts_only(spark, monkeypatch):
    rnd = random.Random(3)
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(40)]
        rows += [" ".join(base), " ".join(base[:-1] + [f"e{g}"])]
    rows += [" ".join(f"a{rnd.randrange(10 ** 9)}" for _ in range(30)) + " of the and" for _ in range(20)]
    kept, keep = [], bottomk.keep

    def counting(df, name, **options):
        table = keep(df, name, **options)
        kept.append((name, table.count()))
        return table

    monkeypatch.setattr(bottomk, "keep", counting)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in bottomk.near_duplicates(df, shingle=2).collect()}
    assert got == {i: i - i % 2 if i < 60 else i for i in range(len(rows))}
    leaders = [n for name, n in kept if name == "leaders"]
    assert len(leaders) == 2 and leaders[0] > 0
    assert leaders[1] <= 6  # all copies are linked by then, their lists are closed
    assert [n for name, n in kept if name == "sets"] == [60, 0, 0]  # texts are cut for candidates only


def test_last_round_compares_sizes_that_may_link(spark):
    rnd = random.Random(4)
    rows = [(7, k, k, n, [0] * (bottomk.PARITIES // 64), [7]) for k, n in enumerate(rnd.choices([2, 3, 4, 5, 9, 10, 11, 40, 49, 50, 51, 10 ** 7, 125 * 10 ** 5], k=60))]
    lists = spark.createDataFrame(rows, "value long, node long, component long, n_shingles long, odd array<bigint>, keys array<bigint>")
    got = sorted((r.u, r.v) for r in bottomk._compared(lists).collect())
    size = [r[3] for r in rows]
    assert got == [(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j])]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (300, 301), (301, 300)]
    df = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 300: 300, 301: 300}
    assert components(df.where("u < 0")).collect() == []
