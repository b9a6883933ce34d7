import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborfair.llm import language_id, pieces_viterbi, token_counts, token_files, transducer
from arborfair.llm.units import Memo
from arborfair.llm.words import BLANK_WORDS, PLAIN_WORDS, find_words, sliding_min, window_hashes

import plain

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(st.one_of(st.sampled_from(list("aeinrst ,.'\n<|>endoftx ▁")), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words(texts):
    for member, pattern, lower in ((BLANK_WORDS, plain.BLANK, False), (PLAIN_WORDS, plain.PLAIN, True)):
        w = find_words(pa.array(texts, pa.string()), member, lower)
        given_ = [plain.lower(t) if lower else t for t in texts]
        got = [w.text(i) for i in range(len(w.hash))]
        want = [x for t in given_ for x in pattern.findall(t)]
        assert [plain.lower(x) if lower else x for x in got] == want
        assert w.counts.tolist() == [len(pattern.findall(t)) for t in given_]
        assert len(set(w.hash.tolist())) == len(set(want))


def test_windows_and_minima():
    h = np.array([5, 1, 9, 1, 9, 1, 7], np.uint64)
    assert len(set(window_hashes(h, 2).tolist())) == 4  # 5 1, 1 9, 9 1, 1 7
    assert sliding_min(h, 3).tolist() == [1, 1, 1, 1, 1] and sliding_min(h, 8).tolist() == []


def test_memo():
    rnd = np.random.default_rng(3)
    keys, memo = np.unique(rnd.integers(0, 1 << 63, 3000).astype(np.uint64)), Memo(1 << 12)
    memo.add(keys, np.arange(len(keys)))
    assert (memo.find(keys) == np.arange(len(keys))).all() and (memo.find(keys + np.uint64(1)) == -1).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_token_counts_equal_the_library(texts):
    library = Tokenizer.from_file(WORDS)
    size, n = token_counts.count_column(pa.array(texts, pa.string()), WORDS)
    assert n.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert size.tolist() == [len(t.encode()) for t in texts]


def test_characters_of_newer_unicode_versions():
    """Whether U+3D000 is a letter depends on whose tables are asked."""
    texts = ["\xd6R\U0003d000", "r\U0003d000 plain", "a<|endoftext|>R\U0003d000<|startoftext|>", "\U0003d000A 1\ua7cb"]
    library = Tokenizer.from_file(WORDS)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_counts.count_column(pa.array(texts), WORDS)[1].tolist() == [len(ids) for ids in want]
    words = [w for t in texts for w in t.split(" ")]
    flat, sizes = transducer.Merges(WORDS).ids(words)
    assert flat.tolist() == [i for ids in want for i in ids]
    assert sizes.tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_token_ids_equal_the_library(texts):
    library = Tokenizer.from_file(BYTES)
    ids, first = token_files.encode_column(pa.array(texts, pa.string()), BYTES)
    assert [p.tolist() for p in np.split(ids, first[1:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts_of_odd_rows(odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(WORDS)
    got = token_counts.count_tokens(odd_docs, WORDS, limit=100)
    assert got.count() == len(odd_rows)
    for r in got.where("doc_id <> 3").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.tokens_.n_tokens, r.tokens_.over_limit) == (n, n > 100), r.doc_id
    assert token_counts.count_tokens(no_docs, WORDS).collect() == []


def test_merges_take_overlaps_from_the_left():
    merger = token_counts.PairMerger(WORDS)
    library = Tokenizer.from_file(WORDS)
    texts = ["a" * n for n in range(1, 40)] + ["ababab" * n for n in range(1, 9)] + ["!" * n for n in range(1, 70)]
    assert merger.count_texts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=1500))
def test_elias_fano(sizes):
    ends = np.cumsum(sizes)
    ef = token_files.EliasFano.encode(ends, int(ends[-1]))
    assert (ef.select(np.arange(len(ends))) == ends).all()
    bits = 8 * (len(ef.low) + len(ef.high) + 4 * len(ef.samples))
    assert bits <= len(ends) * (3 + ef.width) * 1.1 + 1200


@pytest.mark.parametrize("wide", [False, True])
def test_token_files(spark, odd_docs, odd_rows, no_docs, tmp_path, wide):
    library = Tokenizer.from_file(BYTES)
    target = str(tmp_path / "files")
    token_files.write_token_files(odd_docs, target, BYTES, part_bytes=20_000, wide=wide)
    got = token_files.read_token_files(spark, target).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(got) == len(odd_rows)
    texts, start = {}, 0
    for i, t in odd_rows:
        texts.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    for r in got:
        assert r.start == start
        crc = zlib.crc32(np.array(texts[r.doc_id][0], "<u4").tobytes())
        assert r.doc_id in (None, 3) or (r.n_tokens, r.ids_crc32) == (len(texts[r.doc_id][0]), crc)
        start += r.n_tokens
    block = spark.read.parquet(target).where(F.array_contains("doc_ids", 200)).first()
    at = block.doc_ids.index(200)
    assert token_files.Block(bytes(block.payload)).tokens(at).tolist() == texts[200][0]
    token_files.write_token_files(no_docs, str(tmp_path / "none"), BYTES)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).collect() == []


def _cuts(text):
    """All segmentations of a text."""
    for marks in itertools.product([0, 1], repeat=len(text) - 1):
        parts, last = [], 0
        for i, m in enumerate(marks, 1):
            if m:
                parts.append(text[last:i])
                last = i
        yield [*parts, text[last:]]


def test_forward_sums_all_segmentations():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = language_id.load(PIECES)
    names = sorted(model.id_to_piece(i) for i in range(259, 32000) if len(model.id_to_piece(i)) <= vocabulary.longest)
    number = {p: k for k, p in enumerate(names)}
    rnd = np.random.default_rng(4)
    p = np.vstack([rnd.random((vocabulary.size + 1, 2)), np.zeros((1, 2))])
    p /= p.sum(axis=0)
    for word in ("the", "naïve", "☃x☃", "running"):
        pieces_of = [[number.get(x, vocabulary.size if len(x) == 1 else vocabulary.size + 1) for x in cut] for cut in _cuts("▁" + word)]
        each = np.array([p[c].prod(axis=0) for c in pieces_of])
        assert np.allclose(language_id.log_likelihood(vocabulary, [word], p)[0], np.log(each.sum(axis=0)))
        share, counts = each / each.sum(axis=0), np.zeros((vocabulary.size + 2, 2))
        for c, s in zip(pieces_of, share):
            np.add.at(counts, c, s * [2, 3])
        assert np.allclose(language_id.expected_counts(vocabulary, [word], np.array([[2.0, 3.0]]), p), counts[:-1])


def _sums_by_table(vocabulary, names, p, word):
    """Log likelihood and expected counts of one word and one language, place by place in logarithms."""
    number, text = {n: i for i, n in enumerate(names)}, "\u2581" + word
    size = len(text)

    def arcs(end):
        for begin in range(max(0, end - vocabulary.longest), end):
            k = number.get(text[begin:end], vocabulary.size if end - begin == 1 else None)
            if k is not None:
                yield begin, k

    ahead, back = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    ahead[0] = back[size] = 0
    for end in range(1, size + 1):
        for begin, k in arcs(end):
            ahead[end] = np.logaddexp(ahead[end], ahead[begin] + np.log(p[k]))
    counts = np.zeros(len(p))
    for end in range(size, 0, -1):
        for begin, k in arcs(end):
            step = np.log(p[k]) + back[end]
            back[begin] = np.logaddexp(back[begin], step)
            counts[k] += np.exp(ahead[begin] + step - ahead[size])
    return ahead[size], counts


@pytest.mark.parametrize("steps", [32, 2])
def test_long_runs_sum_all_segmentations(monkeypatch, steps):
    """Runs beyond one step, one stretch of steps and one batch: no segmentation is lost at a border."""
    import sentencepiece

    monkeypatch.setattr(language_id, "STEPS", steps)
    model, vocabulary = sentencepiece.SentencePieceProcessor(model_file=PIECES), language_id.load(PIECES)
    names = sorted(model.id_to_piece(i) for i in range(model.vocab_size())
                   if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    rng = np.random.default_rng(3)
    p = np.vstack([rng.dirichlet(np.full(vocabulary.size + 1, 0.3), 2).T + 1e-9, np.zeros((1, 2))])
    words = ["".join(rng.choice(list("etaoinshr\u00e9\u4e00"), n)) for n in (39, 40, 41, 63, 64, 65, 70, 128, 300, 1100)]
    words += ["the" * 30, "a" * 500, "short"]
    weights = rng.integers(0, 4, (len(words), 2)).astype(float)
    got, counts = language_id.log_likelihood(vocabulary, words, p), language_id.expected_counts(vocabulary, words, weights, p)
    wanted = np.zeros((vocabulary.size + 2, 2))
    for i, word in enumerate(words):
        for c in range(2):
            score, each = _sums_by_table(vocabulary, names, p[:, c], word)
            assert got[i, c] == pytest.approx(score, rel=1e-9)
            wanted[:, c] += weights[i, c] * each
    assert np.allclose(counts, wanted[:-1], atol=1e-7)


def test_blocks_of_languages_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["the cat and the dog", "le chat et le chien", "der Hund und die Katze", "el gato y el perro"][i % 4],
                                   ["en", "fr", "de", "es"][i % 4]) for i in range(16)] + [(99, None, "xx"), (98, "123", "en")], "doc_id long, text string, lang string")
    found = []
    for size in (256, 3, 1):
        monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", size)
        model = language_id.fit(docs, PIECES)
        assert model.languages == ["de", "en", "es", "fr"] and len(model.blocks) == -(-4 // size)
        found.append({r.doc_id: r.language for r in language_id.identify(docs, model, PIECES).collect()})
    for other in found[1:]:
        assert {k: v.lang_pred for k, v in other.items()} == {k: v.lang_pred for k, v in found[0].items()}
        assert all(other[k].score == pytest.approx(v.score) for k, v in found[0].items())
    assert all(v.lang_pred == ["en", "fr", "de", "es"][k % 4] for k, v in found[0].items() if k < 16)
    assert tuple(found[0][99]) == tuple(found[0][98]) == ("und", 0.0)


def test_languages(spark, odd_docs, odd_rows, no_docs):
    from arborfair.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = QUERIES["op7_segmentation_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").toPandas()
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.98
    model = language_id.fit(docs, PIECES)
    odd = language_id.identify(odd_docs, model, PIECES)
    got = {r.doc_id: r.language_ for r in odd.collect()}
    assert odd.count() == len(odd_rows)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (0, 1, 2, 11))
    assert all(0 < got[i].score <= 1 for i in (3, 13, 200, 300))
    nothing = language_id.fit(no_docs, PIECES)
    assert {r.language_.lang_pred for r in language_id.identify(odd_docs, nothing, PIECES).collect()} == {"und"}
    assert language_id.identify(no_docs, nothing, PIECES).collect() == []


def _best_by_table(model, text):
    """The best segmentation by a plain table over all substrings."""
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        options = []
        for begin in range(end):
            piece = text[begin:end]
            known = model._automaton.get(piece, None) if len(piece) <= 16 else None
            if known:
                options.append((best[begin][0] + known[1], best[begin][1] + [known[2]]))
            elif len(piece) == 1:
                options.append((best[begin][0] + model._unknown, best[begin][1] + [model.byte_ids[b] for b in piece.encode()]))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][1]


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_scored_pieces_against_a_table(text):
    model = pieces_viterbi.load(PIECES, merges=False)
    ids, first = model.encode(pa.array([text]))
    assert ids.tolist() == (_best_by_table(model, "▁" + text.replace(" ", "▁")) if text else [])
    assert model.decode(ids, first)[0].decode() == text.replace("▁", " ")


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_pieces_equal_the_library(text):
    import sentencepiece

    model = pieces_viterbi.load(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids, first = model.encode(pa.array([text]))
    assert ids.tolist() == library.encode(text)
    assert model.decode(ids, first)[0].decode() == text.replace("▁", " ")


def test_pieces_of_documents_equal_the_library():
    import pyarrow.parquet
    import sentencepiece

    texts = pyarrow.parquet.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0)
    ids, first = pieces_viterbi.load(PIECES).encode(texts)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [p.tolist() for p in np.split(ids, first[1:-1])] == library.encode(texts.to_pylist())


def test_scored_pieces_equal_the_library_as_unigrams(odd_rows):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, segmented by score
    library, model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces_viterbi.load(PIECES, merges=False)
    for word in sorted({w for _, t in odd_rows[17:] for w in plain.words(t)})[:2000]:
        mine = model.segment("▁" + word)
        score = lambda ids: sum(library.get_score(i) for i in ids)
        assert score(mine) == score(library.nbest_encode_as_ids(word, 1)[0]), word


def test_pieces_of_odd_rows(odd_docs, odd_rows, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coded = pieces_viterbi.encode(odd_docs, PIECES, name="coded")
    back = pieces_viterbi.decode(coded.select("doc_id", "text", F.col("coded.ids").alias("ids")), PIECES, ids="ids", name="back").collect()
    assert len(back) == len(odd_rows)
    for r in back:
        assert r.ids == library.encode(r.text or "") and r.back.text == (r.text or "").replace("▁", " ") == library.decode(r.ids)
    assert all(r.p.round_trip for r in pieces_viterbi.round_trip(odd_docs, PIECES, name="p").where("doc_id <> 10").collect())
    assert pieces_viterbi.encode(no_docs, PIECES).collect() == []
