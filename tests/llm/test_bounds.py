"""Inputs beyond the sizes that operators once had as limits."""

import numpy as np
import plain
import public_tokenizers
import pytest

from arborfair.llm import bottomk, decontaminate, repeats, token_files


def test_one_id_with_two_texts(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    near = b + " b60"
    docs = spark.createDataFrame([(1, a), (1, b), (2, near), (3, a), (4, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in bottomk.near_duplicates(docs, shingle=2).select("doc_id", "component_id", "n_shingles").collect())
    assert got == [(1, 1, 59), (1, 1, 59), (2, 1, 60), (3, 1, 59), (4, 4, 0)]
    # The link of the second text does not depend on which text of the id comes first.
    docs = spark.createDataFrame([(5, b), (5, a), (9, near)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in bottomk.near_duplicates(docs, shingle=2).collect()} == {(5, 5), (9, 5)}


def test_copies_and_empty_texts_larger_than_a_slice(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [passage + " x"] * 40 + [None] * 300 + [f"own {i} " + passage for i in range(5)] + ["alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    done = repeats.remove_repeats(docs, name="cut", slice_bytes=2000)
    got = {r["doc_id"]: tuple(r["cut"]) for r in done.collect()}
    assert got == dict(enumerate(plain.without_repeats(texts, repeats.WINDOW)))


def test_wide_ids(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    target = str(tmp_path / "wide")
    token_files.write_token_files(docs, target, path, end_id=70_000)
    blocks = [token_files.Block(r["payload"]) for r in spark.read.parquet(target).collect()]
    assert sum((np.array(b.ids) == 70_000).sum() for b in blocks) == 2
    with pytest.raises(ValueError, match="do not fit"):
        token_files.write_token_files(docs, str(tmp_path / "narrow"), path, end_id=70_000, wide=False)


def test_tables_of_a_block_of_items():
    rows = [(i, " ".join(f"w{(i * 7919 + j * 31) % 50_000}" for j in range(100))) for i in range(400)]
    (patterns,) = decontaminate.compile_items(rows, 10)
    # One byte per slot and at most eight slots per block of words.
    assert patterns.shift.nbytes <= 8 * len(patterns.texts) * patterns.length
