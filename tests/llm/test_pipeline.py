import math

import public_tokenizers
import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborfair.llm import divergence
from arborfair.llm.common import keep

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), name)
        out.append(docs)
    return [{r.doc_id: r for r in df.collect()} for df in out], [df.columns for df in out]


def _class_of(c):
    if not c.isascii():
        return len(divergence.CLASSES) + 2
    for k, chars in enumerate(divergence.CLASSES.values()):
        if c in chars:
            return k
    return len(divergence.CLASSES) + (0 if c.islower() else 1)


def _histograms(text):
    known = sorted({w for words in divergence.COMMON_WORDS.values() for w in words})
    classes, words = [0] * (len(divergence.CLASSES) + 3), [0] * (len(known) + 1)
    for c in text:
        classes[_class_of(c)] += 1
    for w in plain.PLAIN.findall(plain.lower(text)):
        words[known.index(w) if w in known else -1] += 1
    return [[x / max(sum(h), 1) for x in h] for h in (classes, words)]


def _distance(p, q):
    both = [(a + b) / 2 for a, b in zip(p, q)]
    half = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, both) if a > 0) / 2
    return math.sqrt(max(0.0, half(p) + half(q)))


def test_quality_stage(stages):
    (docs, kept, *_), _ = stages
    measured = {i: (plain.base_counts(r.text), _histograms(r.text)) for i, r in docs.items()}
    base = {i: n[0] < 50 or 100 * n[4] > 50 * n[0] for i, (n, _) in measured.items()}
    references = []
    for lang in sorted({r.lang for r in docs.values()}):
        rows = [measured[i][1] for i, r in docs.items() if r.lang == lang and not base[i]]
        references.append([[sum(x) / len(rows) for x in zip(*[h[k] for h in rows])] for k in (0, 1)])
    want = set()
    for i, (n, h) in measured.items():
        c, v = (min(_distance(h[k], r[k]) for r in references) for k in (0, 1))
        far = len(docs[i].text) >= 200 and c > 0.125 + 10 / max(n[0], 1) or n[0] >= 100 and v > 0.365
        if not base[i] and not far:
            want.add(i)
    assert set(kept) == want and 100 < len(want) < len(docs)


def test_near_duplicate_stage(stages):
    _, docs, kept = stages[0][:3]
    ids = sorted(docs)
    label = plain.classes([plain.shingles(docs[i].text, 5) for i in ids])
    assert set(kept) == {i for k, i in enumerate(ids) if label[k] == k} and len(kept) < len(docs)


def test_near_duplicate_stage_keeps_rows_not_ids(spark):
    """A kept row without an id, or one text of an id, does not bring back the others."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, a), (None, b), (1, b + " b60"), (2, a), (2, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(tuple(r) for r in kept) == [(1, b + " b60"), (2, a)]


def test_repeat_stage(stages):
    docs, cut = stages[0][2:4]
    ids = sorted(docs)
    want = {i: kept if gone else docs[i].text for i, (_, gone, kept) in zip(ids, plain.without_repeats([docs[i].text for i in ids], 35))}
    assert {i: r.text for i, r in cut.items()} == want
    assert any(want[i] != docs[i].text for i in ids)


def test_decontamination_and_encoding_stages(spark, stages):
    import sentencepiece

    docs, clean, coded = stages[0][3:]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(clean) == {i for i, r in docs.items() if not plain.hits(r.text, items)[1]} and len(clean) < len(docs)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {i: r.ids for i, r in coded.items()} == {i: library.encode(r.text) for i, r in clean.items()}
    assert all(r.n_pieces == len(r.ids) for r in coded.values())
    columns = stages[1]
    assert columns[0] == columns[1] == columns[2] == columns[3] == columns[4]


def test_pipeline_of_odd_rows(spark, odd_docs, odd_rows):
    docs = odd_docs.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = keep(stage(spark, docs, SF), name), keep(stage(spark, empty, SF), name)
        assert empty.isEmpty()
    left = {r.doc_id for r in docs.collect()}
    assert left and not left & {0, 1, 2, 3, 201, 202}
