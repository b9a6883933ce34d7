"""The transducer tokenizer against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborfair.llm import queries, transducer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return ids, decoded, (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_lexicon_is_minimal_and_exact(tmp_path):
    rnd = random.Random(1)
    words = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 9))) for _ in range(900)} | {b"walk", b"walking", b"talking"})
    entries = [(w, tuple(rnd.randrange(4) for _ in range(rnd.randrange(4)))) for w in words]
    file = tmp_path / "lexicon"
    file.write_bytes(transducer.compile_lexicon(entries))
    lexicon = transducer.Lexicon(str(file))
    asked = [*words, b"", b"abcabcabcabc", b"zzz", b"walkin"]
    ends = np.cumsum([len(w) for w in asked])
    data = np.frombuffer(b"".join(asked) + b" ", np.uint8)
    known, flat, size = lexicon.walk(data, ends - [len(w) for w in asked], ends)
    want = [dict(entries).get(w) for w in asked]
    assert known.tolist() == [w is not None for w in want]
    assert flat.tolist() == [i for w in want if w for i in w]
    assert size[known].tolist() == [len(w) for w in want if w is not None]
    # A shared suffix is one chain of states: the same endings cost no further states.
    once = transducer.compile_lexicon([(b"walking", (1, 9))])
    twice = transducer.compile_lexicon([(b"talking", (2, 9)), (b"walking", (1, 9))])
    states = [np.frombuffer(x, np.int64)[2] for x in (once, twice)]
    assert states[0] == states[1]


def test_ids_and_texts(spark, library, odd_docs, odd_rows):
    for size in (0, 3, 5000):
        lexicon = transducer.fit_lexicon(odd_docs, PATH, size=size)
        coded = transducer.encode(odd_docs, PATH, lexicon, name="coded")
        both = transducer.decode(coded, PATH, lexicon, F.col("coded.ids"), name="back")
        got = sorted((str(r["doc_id"]), str(r["text"]), r["coded"]["ids"], r["back"]["decoded"]) for r in both.collect())
        assert got == sorted((str(i), str(t), *expected(library, t)[:2]) for i, t in odd_rows)
        assert set(both.columns) == {*odd_docs.columns, "coded", "back"}


def test_round_trip(spark, library, odd_docs, odd_rows):
    lexicon = transducer.fit_lexicon(odd_docs, PATH, size=200)
    made = transducer.round_trip(odd_docs, PATH, lexicon)
    (name,) = set(made.columns) - set(odd_docs.columns)
    got = sorted((str(r["doc_id"]), str(r["text"]), tuple(r[name])) for r in made.collect())
    assert got == sorted((str(i), str(t), expected(library, t)[2]) for i, t in odd_rows)


def test_special_strings_and_cases(library):
    merges = transducer.Merges(PATH)
    words = ["<|endoftext|>", "a<|endoftext|>b'll", "<|startoftext|><|endoftext|>x", "<|endoftext", "'S", "it'S", "ſK", "İ", "ΣΑΣ", "éé", "🙂🙂", "x" * 300]
    flat, n = merges.ids(words)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [library.encode(w, add_special_tokens=False).ids for w in words]
    flat, n = merges.ids([])
    assert not len(flat) and not len(n)


def test_long_text_in_parts(spark, library):
    rnd = random.Random(8)
    text = " ".join(rnd.choice(["alpha", "Beta,", "gamma-ray", "δέλτα", "x1"]) + str(rnd.randrange(3000)) for _ in range(250_000))
    assert len(text) > 2 << 20
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r["coded"]) for r in transducer.round_trip(docs, PATH, transducer.fit_lexicon(docs, PATH, size=1000), name="coded").collect()}
    assert got == {1: expected(library, text)[2], 2: expected(library, None)[2]}


def test_empty_table(spark, no_docs):
    assert transducer.round_trip(no_docs, PATH, transducer.fit_lexicon(no_docs, PATH)).collect() == []


def test_text_parts_cut_at_blanks():
    from arborfair.llm.common import text_parts
    texts = ["a b", None, "word " * 1000, "x" * 900, "", "é " * 400]
    back = ["" for _ in texts]
    for part, owner in text_parts(pa.array(texts), 256):
        for text, row in zip(part.to_pylist(), owner.tolist()):
            back[row] += text
    assert back == [t or "" for t in texts]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r[0]: tuple(r)[1:] for r in queries.op13_transducer_bpe(spark, sf).collect()}
    assert got == {i: expected(library, t)[2] for i, t in docs.items()}
