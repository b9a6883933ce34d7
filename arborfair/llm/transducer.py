"""Byte-pair encoding through a minimal acyclic transducer of frequent words.

Words between ASCII blanks are tokenized apart from each other.  The words that are most frequent in the corpus are counted over
all documents, merged once, and compiled into a minimal acyclic transducer: a deterministic automaton over bytes that shares prefixes
and suffixes, with token ids written on its arcs as early as they are certain.  It is a flat file, which Spark hands to every executor and
whose pages all Python workers of a machine map.  All distinct words of a piece of text walk through it together; a word that
leaves it is merged exactly, lowest rank first (by the library itself if it has characters that Python's Unicode tables do not assign).  So the lexicon's size (``LEXICON_WORDS``) decides about speed, never about ids.

Cases: a null or empty text has no ids and an empty decoded text; special strings inside texts are one id each, as the
library takes them by default; null and repeated ids and repeated rows are passed through; a long text is read in parts cut at
blanks; an empty table gives an empty result; further columns stay as they are, and a clashing name is changed by ``free_name``.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import attach, free_name, keep, scratch, shared_folder, text_parts
from .units import unassigned
from .words import find_words

#: Words of the lexicon, and bytes of the longest one.
LEXICON_WORDS = 100_000
LEXICON_WORD_BYTES = 64
FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Merges:
    """The exact ids of single words, from a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        # Bytes that are no printable Latin-1 characters are written as characters from U+0100 on.
        sign = {**{b: chr(b) for b in plain}, **{b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}}
        self._inner = np.array([vocabulary[sign[b]] for b in range(256)], np.int64)
        self._last = np.array([vocabulary[sign[b] + suffix] for b in range(256)], np.int64)
        merges = spec["model"]["merges"]
        self._none = max(len(merges), max(vocabulary.values()) + 1)  # a rank, and an id, that is none
        pairs = np.array([vocabulary[a] * self._none + vocabulary[b] for a, b in merges], np.int64)
        self._ranks = np.argsort(pairs)
        self._pairs, self._made = pairs[self._ranks], np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self._special, key=len, reverse=True)
        self._at_special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._split = regex.compile(r"\n|" + split.replace(r"\s", r"\t-\r\x85\p{Z}"))
        self._path, self._library = path, None
        self.tokens = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self._special.items()}

    @staticmethod
    def _check(spec: dict) -> None:
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if spec["model"]["type"] != "BPE" or not spec["model"]["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("a word-level byte-pair tokenizer with word ends and no decoder is needed")

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (texts without ASCII blanks), one word after another, and how many each has."""
        special: dict[int, list] = {}
        plain = list(words)
        if self._at_special is not None and self._at_special.search("\n".join(words)):
            for k, word in enumerate(words):
                found = [(m.start(), m.end(), self._special[m[0]]) for m in self._at_special.finditer(word)]
                if found:
                    special[k], plain[k] = found, ""
        unsure = [k for k, word in enumerate(words) if unassigned(word)] if unassigned("".join(words)) else []
        for k in unsure:
            special.pop(k, None)
            plain[k] = ""
        flat, sizes = self._plain(plain)
        if special or unsure:
            at = np.concatenate([[0], np.cumsum(sizes)])
            lists = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
            for k in unsure:
                self._library = self._library or Tokenizer.from_file(self._path)
                lists[k] = np.array(self._library.encode(words[k], add_special_tokens=False).ids, np.int64)
            for k, found in special.items():
                cuts = [0, *(x for a, b, _ in found for x in (a, b)), len(words[k])]
                between, n = self._plain([words[k][a:b] for a, b in zip(cuts[::2], cuts[1::2])])
                gaps = np.split(between, np.cumsum(n)[:-1])
                lists[k] = np.concatenate([x for gap, (_, _, i) in zip(gaps, found) for x in (gap, [i])] + [gaps[-1]]).astype(np.int64)
            flat, sizes = np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
        return flat, sizes

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(texts)
        if not joined.isascii():
            # Lower-casing goes character by character: a sigma has no special form at a word's end.
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")
        found = self._split.findall(joined.lower())
        number: dict[str, int] = {"\n": 0}
        which = np.array([number.setdefault(p, len(number)) for p in found], np.int64)
        flat, n = self._merged([p.encode() for p in list(number)[1:]])
        place, n = np.concatenate([[0], np.cumsum(n) - n]), np.concatenate([[0], n])
        sizes = np.bincount(np.cumsum(which == 0), n[which], len(texts)).astype(np.int64) if len(which) else np.zeros(len(texts), np.int64)
        return flat[_spread(place[which], n[which])], sizes

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge every word's lowest pair, all its places at once, until no word has a known pair."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol, word = self._inner[data], np.repeat(np.arange(len(words)), size)
        end = np.cumsum(size) - 1
        symbol[end] = self._last[data[end]]
        rank = self._rank(symbol, word, np.arange(len(symbol)))
        done = [np.empty((2, 0), np.int64)]
        while len(symbol):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(begin, len(symbol)))
            least = np.minimum.reduceat(rank, begin)
            stays = np.repeat(least < self._none, length)
            done.append(np.stack([word[~stays], symbol[~stays]]))
            least = np.repeat(least, length)[stays]
            symbol, word, rank = symbol[stays], word[stays], rank[stays]
            hit = rank == least
            # Of a stretch of overlapping places (a a a) every second one, from the left.
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit))))
            hit &= run % 2 == 1
            at = np.flatnonzero(hit)
            symbol[at] = self._made[rank[at]]
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            symbol, word, rank = symbol[left], word[left], rank[left]
            moved = at - np.arange(len(at))  # one place was taken out behind each earlier merge
            for places in (moved, moved[moved > 0] - 1):
                rank[places] = self._rank(symbol, word, places)
        word, symbol = np.concatenate(done, axis=1)
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _rank(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pairs that begin at ``at``."""
        after = np.minimum(at + 1, len(symbol) - 1)
        pair = symbol[at] * self._none + symbol[after]
        found = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        known = (self._pairs[found] == pair) & (word[at] == word[after]) & (after > at)
        return np.where(known, self._ranks[found], self._none)


class _State:
    __slots__ = ("labels", "targets", "outputs", "final", "rest")

    def __init__(self):
        self.labels, self.targets, self.outputs, self.final, self.rest = [], [], [], False, ()


def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The minimal acyclic transducer of sorted distinct words, as the bytes of a file.

    States are numbered as they are found complete; complete states with equal arcs are one state."""
    register: dict[tuple, int] = {}
    done: list[tuple] = []

    def freeze(state: _State) -> int:
        key = (state.final, state.rest, tuple(state.labels), tuple(state.targets), tuple(state.outputs))
        number = register.get(key)
        if number is None:
            number = register[key] = len(done)
            done.append(key)
        return number

    path, before = [_State()], b""
    for word, output in entries:
        same = 0
        while same < len(before) and same < len(word) and before[same] == word[same]:
            same += 1
        while len(path) > same + 1:
            last = path.pop()
            path[-1].targets[-1] = freeze(last)
        # Keep on each shared arc what both words say there, push the rest towards the ends.
        for i in range(same):
            here, common = path[i].outputs[-1], 0
            while common < len(here) and common < len(output) and here[common] == output[common]:
                common += 1
            if common < len(here):
                pushed, below = here[common:], path[i + 1]
                below.outputs[:] = [pushed + o for o in below.outputs]
                if below.final:
                    below.rest = pushed + below.rest
                path[i].outputs[-1] = here[:common]
            output = output[common:]
        for byte in word[same:]:
            path[-1].labels.append(byte)
            path[-1].targets.append(-1)
            path[-1].outputs.append(())
            path.append(_State())
        path[-1].final = True
        if same < len(word):
            path[same].outputs[-1] = output
        else:
            path[-1].rest = output
        before = word
    while len(path) > 1:
        last = path.pop()
        path[-1].targets[-1] = freeze(last)
    root = freeze(path[0])

    spans: dict[tuple, int] = {(): 0}
    pool: list[int] = []

    def place(output: tuple) -> int:
        if output not in spans:
            spans[output] = len(pool)
            pool.extend(output)
        return spans[output]

    keys, targets, outputs, rests = [], [], [], []
    for number, (final, rest, labels, to, out) in enumerate(done):
        keys += [number << 8 | label for label in labels]
        targets += to
        outputs += [(place(o), len(o)) for o in out]
        rests.append((place(rest), len(rest) if final else -1))
    arrays = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64).reshape(-1, 2).ravel(),
              np.array(rests, np.int64).ravel(), np.array(pool, np.int64)]
    return np.concatenate([np.array([root, len(keys), len(done), len(pool)], np.int64), *arrays]).tobytes()


class Lexicon:
    """A compiled lexicon in a mapped file."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.int64, "r")
        self.root, arcs, states, pool = whole[:4].tolist()
        at = np.cumsum([4, arcs, arcs, 2 * arcs, 2 * states, pool])
        self._keys, self._targets, outputs, rests, self._pool = (whole[a:b] for a, b in zip(at[:-1], at[1:]))
        self._outputs, self._rests = outputs.reshape(-1, 2), rests.reshape(-1, 2)

    def walk(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is in the lexicon; the ids of those that are, one after another, and how many each has."""
        n = len(start)
        state, alive, at = np.full(n, self.root), np.arange(n), start.copy()
        word, place, size = [], [], []
        known = np.zeros(n, bool)
        while len(alive) and len(self._keys):
            ended = at[alive] == end[alive]
            if ended.any():
                stop = alive[ended]
                rest = self._rests[state[stop]]
                final = rest[:, 1] >= 0
                known[stop[final]] = True
                word.append(stop[final])
                place.append(rest[final, 0])
                size.append(rest[final, 1])
                alive = alive[~ended]
                continue
            key = state[alive] << 8 | data[at[alive]]
            arc = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            on = self._keys[arc] == key
            alive, arc = alive[on], arc[on]
            out = self._outputs[arc]
            word.append(alive)
            place.append(out[:, 0])
            size.append(out[:, 1])
            state[alive] = self._targets[arc]
            at[alive] += 1
        if not word:
            return known, np.empty(0, np.int64), np.zeros(n, np.int64)
        word, place, size = map(np.concatenate, (word, place, size))
        some = np.flatnonzero(known[word] & (size > 0))
        some = some[np.argsort(word[some], kind="stable")]
        word, place, size = word[some], place[some], size[some]
        return known, self._pool[_spread(place, size)], np.bincount(word, size, n).astype(np.int64)


def _spread(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """place, place + 1, .. of ``size`` entries each, one after another."""
    return np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all texts; each piece of text adds up its own words first."""
    def run(batches):
        for batch in batches:
            for part, _ in text_parts(batch.column(0)):
                w = find_words(part)
                _, at, n = np.unique(w.hash, return_index=True, return_counts=True)
                ok = w.end[at] - w.start[at] <= LEXICON_WORD_BYTES
                at, n = at[ok], n[ok]
                size = w.end[at] - w.start[at]
                flat = w.data[_spread(w.start[at], size)]
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, path: str, *, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts, ``size`` at most, and hand the file to all executors; returns its name."""
    spark = docs.sparkSession
    with scratch(spark):
        counted = keep(count_words(docs, text).withColumn("bin", F.floor(F.log2("n") * 64).cast("int")), "words")
        # At most 64 bins per doubling of the count, so a few thousand rows; whole bins are taken while they fit.
        least, held = None, 0
        for r in counted.groupBy("bin").count().orderBy(F.desc("bin")).collect():
            held += r["count"]
            if held > size:
                break
            least = r["bin"]
        frequent = [r["word"] for r in counted.where(F.col("bin") >= least).collect()] if least is not None else []
    merges = Merges(path)
    flat, n = merges.ids(frequent)
    outputs = np.split(flat, np.cumsum(n)[:-1]) if frequent else []
    compiled = compile_lexicon(sorted(zip((w.encode() for w in frequent), (tuple(map(int, o)) for o in outputs))))
    name = f"lexicon-{uuid.uuid4().hex}"
    jvm, target = spark._jvm, f"{shared_folder(spark)}/{name}"
    at = jvm.org.apache.hadoop.fs.Path(target)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(compiled))
    finally:
        out.close()
    spark.sparkContext.addFile(target)
    return name


class Coder:
    """Ids and decoded bytes of whole columns of texts, in one Python worker."""

    def __init__(self, path: str, lexicon: str):
        self.merges, self.lexicon = Merges(path), Lexicon(lexicon)
        # Without a decoder in the file, decoding joins the tokens as they are written by blanks.
        tokens = [self.merges.tokens.get(i, "").encode() for i in range(max(self.merges.tokens) + 1)]
        self._token_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in tokens])])
        self._token_bytes = np.frombuffer(b"".join(t + b" " for t in tokens), np.uint8)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none long), and where each text begins and the last ends."""
        w = find_words(column)
        _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        known, flat, size = self.lexicon.walk(w.data, w.start[at], w.end[at])
        rest = at[~known]
        merged, size[~known] = self.merges.ids([w.text(i) for i in rest.tolist()])
        place = np.empty(len(at), np.int64)
        place[known] = np.cumsum(size[known]) - size[known]
        place[~known] = len(flat) + np.cumsum(size[~known]) - size[~known]
        flat = np.concatenate([flat, merged])
        total = np.concatenate([[0], np.cumsum(size[back])])
        return flat[_spread(place[back], size[back])], total[w.first]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens joined by blanks, and one blank more at the end."""
        return self._token_bytes[_spread(self._token_at[ids], self.token_sizes(ids))].tobytes()

    def token_sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each token and the blank after it."""
        return self._token_at[ids + 1] - self._token_at[ids]


def _coder_of(path: str, lexicon: str):
    """Makes a coder once per task, when the first batch comes."""
    held = []

    def coder() -> Coder:
        if not held:
            held.append(Coder(path, SparkFiles.get(lexicon)))
        return held[0]

    return coder


def encode(docs: DataFrame, path: str, lexicon: str, *, text: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with a struct ``{ids}`` of an array of ints."""
    coder = _coder_of(path, lexicon)

    def compute(piece):
        made = [np.empty(0, np.int64)]
        counts = np.zeros(piece.num_rows, np.int64)
        for part, owner in text_parts(piece.column(text)):
            ids, at = coder().encode(part)
            made.append(ids)
            np.add.at(counts, owner, np.diff(at))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made).astype(np.int32)))]

    return attach(docs, name or free_name(docs, "pieces"), "ids array<int>", compute, text)


def decode(docs: DataFrame, path: str, lexicon: str, ids, *, name: str | None = None) -> DataFrame:
    """``docs`` with a struct ``{decoded}``: the text of the array column ``ids`` (a null array: an empty text)."""
    coder, given = _coder_of(path, lexicon), free_name(docs, "given_ids")

    def compute(piece):
        lists = piece.column(given)
        texts = [coder().decode(np.array(x or [], np.int64))[:-1].decode() for x in lists.to_pylist()]
        return [pa.array(texts, pa.string())]

    name = name or free_name(docs, "decoded")
    return attach(docs.withColumn(given, ids), name, "decoded string", compute, None).drop(given)


def round_trip(docs: DataFrame, path: str, lexicon: str, *, text: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with a struct ``{n_tokens, ids_sha256, decoded_sha256}`` of each text's ids and of what they decode to."""
    coder = _coder_of(path, lexicon)

    def compute(piece):
        rows = piece.num_rows
        counts, coded = np.zeros(rows, np.int64), [hashlib.sha256() for _ in range(rows)]
        decoded = [hashlib.sha256() for _ in range(rows)]
        for part, owner in text_parts(piece.column(text)):
            ids, at = coder().encode(part)
            raw, texts = ids.astype("<u4").tobytes(), coder().decode(ids)
            ends = np.concatenate([[0], np.cumsum(coder().token_sizes(ids))])[at].tolist()
            for k, row in enumerate(owner.tolist()):
                a, b = int(at[k]), int(at[k + 1])
                if b > a:
                    coded[row].update(raw[4 * a:4 * b])
                    decoded[row].update((b" " if counts[row] else b"") + texts[ends[k]:ends[k + 1] - 1])
                    counts[row] += b - a
        return [pa.array(counts), pa.array([s.hexdigest() for s in coded]), pa.array([s.hexdigest() for s in decoded])]

    return attach(docs, name or free_name(docs, "coded"), FIELDS, compute, text)
