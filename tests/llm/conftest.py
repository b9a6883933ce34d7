import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

ODD_TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "One  one\tone", "a b", "naïve Ünïcode café — “quoted” 日本語 текст 🙂🙂 ﬁ é Å ΑΣ",
    "blanks that are　not\u0085ascii   x \x1c y", "<|endoftext|> in <|startoftext|>text <|endoftext|>", "don't WE'LL it's 12345 1a2b",
    "▁mark  ▁▁ two   blanks", "!!! ??? ... ###$$$", "\n\n\nlines\n\nlines\n", "x" * 5000, "é " * 40, "aaaa " * 200, "it is\n" * 60,
]


@pytest.fixture(scope="session")
def odd_texts():
    return list(ODD_TEXTS)


@pytest.fixture(scope="session")
def odd_rows(odd_texts):
    """Ids and texts: odd ones, null and repeated ids, repeated rows, copies, and one very long text."""
    rnd = random.Random(5)
    rows = list(enumerate(odd_texts)) + [(None, "a text without an id"), (None, None), (3, "one"), (3, "one")]
    base = [rnd.choice("the of and in to a was is for on".split()) + rnd.choice(["", "x", "ly", ","]) for _ in range(400)]
    for k in range(12):
        at = rnd.randrange(200)
        rows.append((100 + k, " ".join([f"w{k}q{i}" for i in range(30)] + base[at:at + 120])))
    rows += [(200 + k, " ".join(base)) for k in range(3)]
    rows.append((300, " ".join(rnd.choice(base) + str(rnd.randrange(5000)) for _ in range(60_000))))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns, many named like what the operators add."""
    extra = "slice_number quality_rules repeats contamination hash_bits prefix_0 entry_0 tokens pieces language sharding n_words row_key node value".split()
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in extra)
    rows = [(i, t, None if k % 5 == 0 else "en", *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
