"""Periodic runs of words: maximal stretches that repeat themselves with some period.

A run with period ``q`` is an interval of places ``t`` whose words ``t`` and ``t + q`` agree, at least ``q`` places long.  Periods
are dealt with by octave: for periods in ``[P, 2P)`` every such interval holds a multiple ``c`` of ``P``, a boundary.  What
the Z-functions of both sides of a boundary say (how far the words at ``c`` and ``c + q`` agree to the right and to the
left) is looked up only for the pairs that agree on ``P / 2`` words on one side, by prefix sums modulo two primes.

A text of up to ``TILE_WORDS`` words is one tile for all octaves.  A longer one is exploded into overlapping tiles per octave,
wide enough for every boundary they answer for; tiles are dealt over the cluster and solved without knowing of each
other.  All fragments, clipped to what their boundary sees, are shuffled by document and period, and fragments that touch are
stitched to whole runs.  A fragment whose period is a multiple of a smaller one is dropped where it is found.

Words are compared by 62-bit sums, so a wrong run has a chance of about one in 10**18 per comparison.

Cases: a null or empty text, and one of fewer than ``MIN_LENGTH`` words, has no runs; null and repeated ids and repeated
rows are documents of their own; texts of any length are cut into tiles; further columns are not looked at, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, pieces, strings, text_parts
from .words import find_words, joined_texts, mix

#: Shortest run.
MIN_LENGTH = 12
#: Words of a text that is solved as one tile, and boundaries' reach of a tile of a longer one.
TILE_WORDS = 1 << 13
#: Boundary distance of the first octave, which has all periods below twice that.
FIRST = 4
_PRIMES = ((2_147_483_647, 1_220_703_125), (2_147_483_629, 1_162_261_467))


class Sums:
    """Prefix sums of words modulo two primes: whether two stretches agree, and how far."""

    def __init__(self, h: np.ndarray):
        self.n, self._parts = len(h), []
        for k, (p, base) in enumerate(_PRIMES):
            power = np.ones(1, np.uint64)
            while len(power) < self.n + 1:
                power = np.concatenate([power, power * np.uint64(pow(base, len(power), p)) % np.uint64(p)])[:self.n + 1]
            value = (h >> np.uint64(29 * k)) % np.uint64(p)
            total = np.zeros(self.n + 1, np.uint32)
            total[1:] = np.cumsum(value * power[:self.n] % np.uint64(p)) % np.uint64(p)
            self._parts.append((np.uint64(p), power.astype(np.uint32), total))

    def same(self, a: np.ndarray, b: np.ndarray, m) -> np.ndarray:
        """Whether the ``m`` words from ``a`` on equal those from ``b`` on (``a < b``, both inside)."""
        out = np.ones(len(a), bool)
        for p, power, total in self._parts:
            left = (total[a + m].astype(np.uint64) + p - total[a]) % p
            right = (total[b + m].astype(np.uint64) + p - total[b]) % p
            out &= left * power[b - a] % p == right
        return out

    def reach(self, a: np.ndarray, b: np.ndarray, top: int, left: bool) -> np.ndarray:
        """How many words agree from ``a`` and ``b`` on (to the left: before them), up to ``2**(top + 1) - 1``."""
        n = np.zeros(len(a), np.int64)
        for j in range(top, -1, -1):
            w = 1 << j
            x, y = (a - n - w, b - n - w) if left else (a + n, b + n)
            can = np.flatnonzero((x >= 0) & (y + w <= self.n))
            n[can[self.same(x[can], y[can], w)]] += w
        return n


def _candidates(name: np.ndarray, P: int, m: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries ``c`` and places ``t`` (in the ``row``-th stretch of P words from c on) whose next, or last, ``m`` words agree."""
    found = []
    for shift in (0, m):
        # With a shift, entry i of the grid is the window before word i.
        usable = len(name) + shift
        rows = usable // P + 1
        grid = np.zeros(rows * P, np.uint64)
        grid[shift:usable] = name
        grid = grid.reshape(rows, P)
        r, off = np.nonzero(grid[row:] == grid[:rows - row, :1])
        c, t = r * P, (r + row) * P + off
        ok = (t > c) & (t < usable) & (c >= shift)
        found.append(np.stack([c[ok], t[ok]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


def _smallest_factor(n: int) -> np.ndarray:
    """The smallest prime factor of each number up to ``n``."""
    out = np.arange(n + 1)
    for i in range(2, int(n ** 0.5) + 1):
        if out[i] == i:
            part = out[i * i::i]
            part[part == np.arange(i * i, n + 1, i)] = i
    return out


def fragments(h: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``period, lo, hi`` with ``low <= period < high``: places from lo to hi - 1 equal the places a period further on.

    ``low`` and ``high`` are borders of octaves.  Each fragment holds a boundary, is at least as long as makes a run, and
    is merged with those it touches."""
    n, out = len(h), []
    high = min(high, n // 2 + 1)
    if n < MIN_LENGTH or low >= high:
        return (np.empty(0, np.int64),) * 3
    sums, P, m, name = Sums(h), FIRST, 1, h
    factor = _smallest_factor(high)
    while P < high:
        while m < P // 2 and len(name) > m:
            name = mix(name[:-m] * np.uint64(0x9E3779B97F4A7C15) + (name[m:] ^ np.uint64(0xD1B54A32D192ED03)))
            m *= 2
        if 2 * P > low:
            for row in (0, 1) if P == FIRST else (1,):
                c, t = _candidates(name, P, m, row)
                q = t - c
                top = P.bit_length()
                left, right = sums.reach(c, t, top, True), sums.reach(c, t, top, False)
                ok = (left + right >= np.maximum(q, MIN_LENGTH - q)) & (q < high)
                lo, hi, q = (c - left)[ok], (c + right)[ok], q[ok]
                out.append(np.stack([q, lo, hi])[:, _primitive(sums, lo, q, factor)])
        P *= 2
    q, lo, hi = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
    return _merged(q, lo, hi)


def _primitive(sums: Sums, lo: np.ndarray, q: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Marks of the stretches of ``q`` words from ``lo`` on that have no smaller period dividing ``q``."""
    out, rest = np.ones(len(q), bool), q.copy()
    while len(some := np.flatnonzero(rest > 1)):
        r = factor[rest[some]]
        d = q[some] // r
        out[some] &= ~sums.same(lo[some], lo[some] + d, q[some] - d)
        rest[some] //= r
    return out


def _merged(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(q):
        return q, lo, hi
    order = np.lexsort((lo, q))
    q, lo, hi = q[order], lo[order], hi[order]
    wide = int(hi.max()) + 2
    most = np.maximum.accumulate(hi + q * wide)
    new = np.append(True, lo[1:] + q[1:] * wide > most[:-1])
    first = np.flatnonzero(new)
    return q[first], lo[first], np.maximum.reduceat(hi, first)


def tiles_of(n: int, tile: int) -> list[tuple[int, int, int, int]]:
    """``(low, high, first word, last word + 1)`` of the tiles of a text of ``n`` words."""
    out, P, low = [], FIRST, 1
    while 4 * P < tile:
        P *= 2
    while low <= n // 2:  # the first tiles have all octaves up to P, the others one each
        # A boundary sees 2P words to its left and, past the period, 2P to its right.
        reach = max(tile, 4 * P)
        for c in range(0, n, reach):
            out.append((low, 2 * P, max(0, c - 2 * P), min(n, c + reach + 4 * P)))
        low = P = 2 * P
    return out


PARTS = "row long, id {id}, text string, plain_sha256 string, period long, lo long, hi long, low long, high long, base long, words binary"


@dataclass
class Found:
    """``parts``: one row per document (``row``, ``id``; ``text`` where there may be runs) and the fragments; ``runs``: ``row, start,
    period, length``."""

    parts: DataFrame
    runs: DataFrame


def find_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", tile: int = TILE_WORDS) -> Found:
    """All maximal runs of the texts of ``docs``."""
    if tile < 8 * FIRST or tile & (tile - 1):
        raise ValueError("a tile is a power of two, 32 words at least")
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).alias("text"))
    schema = PARTS.format(id=source.schema["id"].dataType.simpleString())
    parts = keep(source.mapInArrow(_cutter(tile), schema), "runs")
    tiles = parts.where("words IS NOT NULL").select("row", "low", "high", "base", "words").repartition("row", "low", "base")
    found = parts.where("period IS NOT NULL").select("row", "period", "lo", "hi").unionByName(
        tiles.mapInArrow(_solve_tiles, "row long, period long, lo long, hi long")
    )
    return Found(parts, stitch(found))


def stitch(found: DataFrame) -> DataFrame:
    """``row, start, period, length`` of the runs whose fragments touch."""
    by = Window.partitionBy("row", "period").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = found.withColumn("new", F.when(F.col("lo") <= before, 0).otherwise(1)).withColumn("stretch", F.sum("new").over(by))
    whole = cut.groupBy("row", "period", "stretch").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = (F.col("hi") + F.col("period") - F.col("start")).alias("length")
    return whole.select("row", "start", "period", length).where(F.col("length") >= F.greatest(F.lit(MIN_LENGTH), 2 * F.col("period")))


def _read(column) -> tuple[np.ndarray, np.ndarray, list]:
    """Word fingerprints of all texts, the first word of each, and the sha256 of each text's words joined by one blank."""
    hashes, counts, sha = [np.empty(0, np.uint64)], np.zeros(len(column), np.int64), [hashlib.sha256() for _ in range(len(column))]
    for part, owner in text_parts(column):
        w = find_words(part)
        hashes.append(w.hash)
        _update(sha, counts, w, owner)
        np.add.at(counts, owner, w.counts)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)]), sha


def _update(sha: list, before: np.ndarray, w, owner: np.ndarray, keep_words: np.ndarray | None = None) -> None:
    """Go on with each text's sha256; ``before`` tells of each row whether a kept word came already."""
    joined, at = joined_texts(w, keep_words)
    joined, seen = joined.tobytes(), before.copy()
    for row, a, b in zip(owner.tolist(), at[:-1].tolist(), at[1:].tolist()):
        if b > a:
            sha[row].update(b" " + joined[a:b] if seen[row] else joined[a:b])
            seen[row] += 1


def _cutter(tile: int):
    names = [x.split()[0] for x in PARTS.split(", ")]

    def rows_of(like: pa.DataType, n: int, **columns) -> pa.RecordBatch:
        kinds = {"id": like, "text": pa.string(), "plain_sha256": pa.string(), "words": pa.binary()}
        arrays = [pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                row, ids = piece.column("row").to_numpy(), piece.column("id")
                h, first, sha = _read(piece.column("text"))
                counts = np.diff(first)
                owner, q, lo, hi = _solve_short(h, first, np.flatnonzero((counts >= MIN_LENGTH) & (counts <= tile)))
                if len(owner):
                    yield rows_of(ids.type, len(owner), row=row[owner], period=q, lo=lo, hi=hi)
                marked = counts > tile
                marked[owner] = True
                texts = strings(piece.column("text"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row), ids, texts.take(pa.array(np.arange(len(row)), mask=~marked)).cast(pa.string()),
                    pa.array([None if m else s.hexdigest() for m, s in zip(marked.tolist(), sha)], pa.string()),
                    *[pa.nulls(len(row), pa.int64())] * 6, pa.nulls(len(row), pa.binary()),
                ], names=names)
                for i in np.flatnonzero(counts > tile).tolist():
                    mine = h[first[i]:first[i + 1]]
                    for low, high, a, b in tiles_of(len(mine), tile):
                        yield rows_of(ids.type, 1, row=[int(row[i])], low=[low], high=[high], base=[a], words=[mine[a:b].tobytes()])

    return run


def _solve_short(h: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """``row, period, lo, hi`` of the fragments of whole texts; texts of like size are solved together, parted by a word
    that is nowhere else."""
    size = np.diff(first)[rows]
    scale = np.log2(np.maximum(size, 1)).astype(np.int64)
    out = [np.empty((4, 0), np.int64)]
    for k in np.unique(scale).tolist():
        mine, n = rows[scale == k], size[scale == k] + 1
        at = np.concatenate([[0], np.cumsum(n)])
        words = np.empty(at[-1], np.uint64)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        words[at[1:] - 1] = mix(np.arange(1, len(mine) + 1, dtype=np.uint64) << np.uint64(32))
        words[inside] = h[np.repeat(first[mine] - (np.cumsum(n - 1) - (n - 1)), n - 1) + np.arange(int((n - 1).sum()))]
        q, lo, hi = fragments(words, 1, 1 << k)  # periods are at most half of 2**(k + 1) - 1
        text = np.searchsorted(at, lo, "right") - 1
        ok = (hi + q < at[text + 1]) & (hi + q - lo >= np.maximum(MIN_LENGTH, 2 * q))
        text, q, lo, hi = text[ok], q[ok], lo[ok], hi[ok]
        out.append(np.stack([mine[text], q, lo - at[text], hi - at[text]]))
    return tuple(np.concatenate(out, axis=1))


def _solve_tiles(batches):
    for batch in batches:
        for row, low, high, base, words in zip(*[batch.column(c).to_pylist() for c in ("row", "low", "high", "base", "words")]):
            q, lo, hi = fragments(np.frombuffer(words, np.uint64), low, high)
            arrays = [pa.array(x, pa.int64()) for x in (np.full(len(q), row), q, lo + base, hi + base)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "period", "lo", "hi"])


def _with_runs(found: Found) -> DataFrame:
    """The documents' rows with ``runs``, an ordered array of (start, period, length)."""
    of_text = found.runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    docs = found.parts.where("period IS NULL AND words IS NULL").select("row", "id", "text", "plain_sha256")
    return docs.join(of_text, "row", "left")


def collapse(found: Found, name: str = "text") -> DataFrame:
    """``row, id`` and, for texts with a run, the words that no run contains after its first period."""
    joined = _with_runs(found).where("runs IS NOT NULL")
    schema = f"row long, id {joined.schema['id'].dataType.simpleString()}, {name} string"

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                texts = [b" ".join(parts).decode() for parts in _kept_words(piece)]
                yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("id"), pa.array(texts, pa.string())], names=["row", "id", name])

    return joined.mapInArrow(run, schema)


def _kept_words(piece) -> list[list[bytes]]:
    """Of each text the kept words, in parts that are to be joined by one blank."""
    column, drops, out = piece.column("text"), _drops(piece.column("runs")), [[] for _ in range(piece.num_rows)]
    done = np.zeros(piece.num_rows, np.int64)
    for part, owner in text_parts(column):
        w = find_words(part)
        keep_words = np.ones(len(w.start), bool)
        for i, row in enumerate(owner.tolist()):
            a, n = int(w.first[i]), int(w.counts[i])
            for lo, hi in zip(*drops[row]):
                keep_words[a + min(max(lo - done[row], 0), n):a + min(max(hi - done[row], 0), n)] = False
            done[row] += n
        joined, at = joined_texts(w, keep_words)
        joined = joined.tobytes()
        for row, x, y in zip(owner.tolist(), at[:-1].tolist(), at[1:].tolist()):
            if y > x:
                out[row].append(joined[x:y])
    return out


def _drops(runs) -> list[tuple[list[int], list[int]]]:
    """Of each row the intervals of words after the first period of each run, joined where they overlap."""
    at = runs.offsets.to_numpy().astype(np.int64)
    flat = runs.values
    start, period, length = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "period", "length"))
    out = []
    for a, b in zip(at[:-1], at[1:]):
        lo, hi = start[a:b] + period[a:b], start[a:b] + length[a:b]
        _, lo, hi = _merged(np.zeros(b - a, np.int64), lo, hi)
        out.append((lo.tolist(), hi.tolist()))
    return out


def digest(found: Found) -> DataFrame:
    """Per document ``doc_id, n_runs``, the longest run, ``exponent_milli`` and the sha256 of all runs and of the kept words."""
    docs = _with_runs(found)
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                runs = [[(r["start"], r["length"], r["period"]) for r in x or ()] for x in piece.column("runs").to_pylist()]
                best = [min(x, key=lambda r: (-r[1], r[0], r[2])) if x else (None, None, None) for x in runs]
                text = ["".join(f"{a},{n},{q}\n" for a, n, q in x) for x in runs]
                collapsed = list(piece.column("plain_sha256").to_pylist())
                some = pa.array([x is None for x in collapsed])
                rest = piece.filter(some)
                hashed = iter([hashlib.sha256(b" ".join(p)).hexdigest() for p in _kept_words(rest)] if rest.num_rows else [])
                collapsed = [next(hashed) if x is None else x for x in collapsed]
                yield pa.RecordBatch.from_arrays([
                    piece.column("id"), pa.array([len(x) for x in runs], pa.int64()),
                    *[pa.array([b[k] for b in best], pa.int64()) for k in range(3)],
                    pa.array([1000 * b[1] // b[2] if b[2] else None for b in best], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text]), pa.array(collapsed),
                ], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.mapInArrow(run, schema)
