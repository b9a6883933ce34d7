"""Hard negatives by angular triangle filtering.

Vectors are made whole numbers (``floor(scale * x)``), so that scores are exact integers.  A bounded sample of rows gives reference
directions; every row is stored with its norm and its angle to each of them, rows of one home direction ordered by their angle to it.
By the triangle inequality on the sphere, an anchor at angle ``a`` and rows at angles ``[b0, b1]`` to a reference are between ``max(0,
b0 - a, a - b1)`` and ``min(a + b1, 2 pi - a - b0)`` apart.  The cosine interval over all references, times the norms, widened
by more than rounding can move it, bounds the scores of a block of rows; only where it overlaps what an anchor still looks for are
integer scores taken (one matrix product per block).

An anchor looks for two things, each in one pass over the stored rows: the rows of its own label above the least score that the
sample guarantees; then, for every positive, rows of other labels inside its score window.  Anchors go out in blocks of
``ANCHOR_BYTES``, so what a task is sent is bounded; each task returns the few best rows per anchor, which Spark ranks.  Every row
stays in the partition it was read in: no shuffle of vectors, no skew.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part; a vector shorter than the longest
counts as filled up with zeros, an empty one scores 0 with all; ties go to the smaller id; repeated rows are rows of their own, but a row
with the anchor's id is never its positive; an anchor without positives, or a positive without a negative, returns nothing; an empty
table gives an empty result; further columns are not looked at.  Components beyond 2**31 after scaling raise ``OverflowError``.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, scratch, shared_folder

#: Rows that the references are fitted on, and references.
SAMPLE_ROWS = 4096
REFERENCES = 32
#: Rows of a block that share an interval, bytes of anchors of one pass.
BLOCK_ROWS = 256
ANCHOR_BYTES = 16 << 20
ANCHORS_PER_PRODUCT = 2048
NONE = -(1 << 62)


@dataclass(frozen=True)
class Share:
    """Shares of a positive's score, in hundredths, between which negatives lie."""

    low: int = 50
    high: int = 95

    def of(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -(-self.low * score // 100), self.high * score // 100


class References:
    """Reference directions, and the angles of vectors to them."""

    def __init__(self, sample: np.ndarray, width: int):
        self.width = width
        unit = _unit(sample, np.sqrt((sample * sample).sum(1)))
        unit = unit[np.abs(unit).sum(1) > 0]
        centers = unit[:: max(1, len(unit) // REFERENCES)][:REFERENCES]
        for _ in range(8):  # each direction moves to the mean of those nearest to it
            if not len(centers):
                break
            nearest = np.argmax(unit @ centers.T, 1)
            total = np.zeros_like(centers)
            np.add.at(total, nearest, unit)
            size = np.sqrt((total * total).sum(1))
            centers = np.where(size[:, None] > 0, _unit(total, size), centers)
        self.directions = centers if len(centers) else np.zeros((1, width))

    def angles(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_unit(vectors, norms) @ self.directions.T, -1, 1)).astype(np.float32)


def _unit(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return vectors / np.where(norms > 0, norms, 1)[:, None]


def _scores(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Exact inner products; ``limit`` bounds their size (and that of all partial sums)."""
    if limit < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if limit < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if limit < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("scores do not fit into 64 bits")


@dataclass
class Anchors:
    """The anchors of one pass and what each of them looks for in ``slots``: ``want`` best rows per slot."""

    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray  # int32
    norm: np.ndarray
    angles: np.ndarray
    low: np.ndarray  # anchors x slots: least and greatest score that counts
    high: np.ndarray
    same: bool  # rows of the same label, or of others
    want: int


class Best:
    """The ``want`` best rows per anchor and slot among the blocks seen so far."""

    def __init__(self, anchors: Anchors):
        self.a = anchors
        self.low = anchors.low.copy()  # rises to the score of the last row that is still among the best
        self.held = np.empty((4, 0), np.int64)  # anchor, slot, -score, id
        self.new: list[np.ndarray] = []
        self.size = 0

    def see(self, label: np.ndarray, ids: np.ndarray, vector: np.ndarray, norm: np.ndarray, angles: np.ndarray | None) -> int:
        """Look at a block of rows; returns how many pairs were scored."""
        a = self.a
        if not len(ids):
            return 0
        some = np.arange(len(a.id))
        if angles is not None:
            low, high = _bounds(a, norm, angles)
            some = np.flatnonzero(((high[:, None] >= self.low) & (low[:, None] <= a.high) & (self.low <= a.high)).any(1))
        for lo in range(0, len(some), ANCHORS_PER_PRODUCT):
            self._score(some[lo:lo + ANCHORS_PER_PRODUCT], label, ids, vector, norm)
        return len(some) * len(ids)

    def _score(self, some: np.ndarray, label: np.ndarray, ids: np.ndarray, vector: np.ndarray, norm: np.ndarray) -> None:
        a = self.a
        score = _scores(a.vector[some], vector, float(a.norm[some].max() * norm.max()) * 1.001 + 1)
        takes = (a.label[some, None] == label) == a.same
        if a.same:
            takes &= a.id[some, None] != ids
        score = np.where(takes, score, NONE - 1)
        for slot in range(a.low.shape[1]):
            x, y = np.nonzero((score >= self.low[some, slot, None]) & (score <= a.high[some, slot, None]))
            if len(x):
                self.new.append(np.stack([some[x], np.full(len(x), slot), -score[x, y], ids[y]]))
                self.size += len(x)
        if self.size > 200_000:
            self.settle()

    def settle(self) -> np.ndarray:
        found = np.concatenate([self.held, *self.new], axis=1)
        order = np.lexsort((found[3], found[2], found[1], found[0]))
        found = found[:, order]
        group = found[0] * self.a.low.shape[1] + found[1]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        last = np.flatnonzero(rank == self.a.want - 1)
        self.low[found[0, last], found[1, last]] = -found[2, last]
        self.held, self.new, self.size = found[:, rank < self.a.want], [], 0
        return self.held


def _bounds(a: Anchors, norm: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers between which the scores of each anchor with any row of a block lie."""
    b0, b1 = angles.min(0).astype(np.float64), angles.max(0).astype(np.float64)
    x = a.angles.astype(np.float64)
    near = np.maximum(0, np.maximum(b0 - x, x - b1)).max(1)
    far = np.minimum(math.pi, np.minimum(x + b1, 2 * math.pi - x - b0)).min(1)
    largest, least = float(norm.max()), float(norm.min())
    slack = a.norm * largest * 1e-5 + 1
    upper, lower = np.cos(near), np.cos(np.maximum(far, near))
    high = a.norm * np.where(upper > 0, largest, least) * upper
    low = a.norm * np.where(lower > 0, least, largest) * lower
    return np.floor(low - slack).astype(np.int64), np.ceil(high + slack).astype(np.int64)


STORED = "n long, id long, label long, is_anchor boolean, vector binary, norm double, angles binary, home int, away float"


def store(rows: DataFrame, references: References) -> DataFrame:
    """Rows ``(n, id, label, vector)`` with whole-number vectors, norms and angles, near ones next to each other."""
    width = references.width

    def run(batches):
        for batch in batches:
            vector = _matrix(batch.column("vector"), width)
            norm = np.sqrt((vector.astype(np.float64) ** 2).sum(1))
            angles = references.angles(vector.astype(np.float64), norm)
            home = np.argmin(angles, 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("n"), batch.column("id"), batch.column("label"), batch.column("is_anchor"), _packed(vector), pa.array(norm), _packed(angles),
                pa.array(home.astype(np.int32)), pa.array(angles[np.arange(len(home)), home]),
            ], names=[x.split()[0] for x in STORED.split(", ")])

    # Rows stay where they were read, whatever their labels and values.
    return keep(rows.mapInArrow(run, STORED).sortWithinPartitions("home", "away"), "vectors")


def _matrix(column, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``width`` entries, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten())
    if len(flat) and np.abs(flat).max() >= 1 << 31:
        raise OverflowError("a component is beyond 2**31")
    out = np.zeros((len(size), width), np.int32)
    if len(flat):
        out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _packed(matrix: np.ndarray) -> pa.Array:
    offsets = (np.arange(len(matrix) + 1) * matrix.shape[1] * matrix.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _unpacked(column, kind, n: int) -> np.ndarray:
    """The rows of a binary column as a matrix."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat.view(kind).reshape(n, -1) if n else np.empty((0, 0), kind)


def _columns(batch) -> dict[str, np.ndarray]:
    n = batch.num_rows
    return {
        "id": batch.column("id").to_numpy(), "label": batch.column("label").to_numpy(),
        "norm": batch.column("norm").to_numpy(), "vector": _unpacked(batch.column("vector"), np.int32, n),
        "angles": _unpacked(batch.column("angles"), np.float32, n), "home": batch.column("home").to_numpy(),
    }


def _scan(stored: DataFrame, anchors: Anchors, known: dict[str, np.ndarray]) -> DataFrame:
    """``anchor, slot, rank, score, id``, and ``known`` arrays of anchors x slots: the best rows of the whole table."""
    def run(batches):
        best = Best(anchors)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                rows = _columns(batch.slice(at, BLOCK_ROWS))
                # A block that begins in one home and ends in another is cut between them.
                cuts = [0, *(np.flatnonzero(np.diff(rows["home"])) + 1).tolist(), len(rows["id"])]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    best.see(*(rows[c][lo:hi] for c in ("label", "id", "vector", "norm", "angles")))
        anchor, slot, score, ids = best.settle()
        arrays = [anchor, slot, -score, ids, *[a[anchor, slot] for a in known.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["anchor", "slot", "score", "id", *known])

    parts = stored.mapInArrow(run, ", ".join(f"{c} long" for c in ("anchor", "slot", "score", "id", *known)))
    by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= anchors.want)


def _floor(anchors: Anchors, sample: dict[str, np.ndarray]) -> None:
    """Raise each slot's least score to what the sample's rows already guarantee."""
    best = Best(anchors)
    for at in range(0, len(sample["id"]), BLOCK_ROWS):
        best.see(*(sample[c][at:at + BLOCK_ROWS] for c in ("label", "id", "vector", "norm")), None)
    best.settle()
    anchors.low = best.low


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame, anchor: Column, *, id: str = "vec_id", label: Column | str = "label", vector: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """For each anchor (a row for which ``anchor`` holds) and each of its ``positives`` best rows of the same label, the
    ``negatives`` best rows of other labels that score between ``low`` and ``high`` hundredths of the positive."""
    spark, share = vectors.sparkSession, Share(low, high)
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.where(F.col(id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite)
        .select(
            F.monotonically_increasing_id().alias("n"), F.col(id).cast("long").alias("id"), label.cast("long").alias("label"),
            F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"),
            F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        )
    )
    width = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 1)
    sample = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE_ROWS).select("id", "label", "vector").toArrow()
    sampled = _matrix(sample.column("vector").combine_chunks(), width) if sample.num_rows else np.zeros((0, width), np.int32)
    known = {
        "id": sample.column("id").to_numpy(), "label": sample.column("label").to_numpy(), "vector": sampled,
        "norm": np.sqrt((sampled.astype(np.float64) ** 2).sum(1)),
    }
    target = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(target)
    with scratch(spark):
        stored = store(rows, References(sampled.astype(np.float64), width))
        for lo, hi in passes(stored.where("is_anchor"), max(1, ANCHOR_BYTES // (4 * width + 4 * REFERENCES + 200))):
            part = _anchors(stored.where(F.col("is_anchor") & F.col("n").between(lo, hi)))
            _one_pass(stored, part, known, share, positives, negatives).write.mode("append").parquet(target)
    return spark.read.schema(RESULT).parquet(target)


def passes(anchors: DataFrame, most: int) -> list[tuple[int, int]]:
    """Intervals of running numbers with at most ``most`` anchors each.

    Running numbers count the rows of each partition from a multiple of 2**33 on, so a stretch of ``most`` of them never has
    more anchors; neighbouring stretches are joined as long as they fit."""
    stretch = (F.col("n") - F.col("n") % most).alias("lo")
    out: list[tuple[int, int]] = []
    held = 0
    for lo, size in anchors.groupBy(stretch).count().orderBy("lo").collect():
        if out and held + size <= most:
            out[-1], held = (out[-1][0], lo + most - 1), held + size
        else:
            out.append((lo, lo + most - 1))
            held = size
    return out


def _anchors(rows: DataFrame) -> dict[str, np.ndarray]:
    return _columns(rows.orderBy("n").toArrow().combine_chunks().to_batches(None)[0])


def _one_pass(stored: DataFrame, a: dict, sample: dict, share: Share, positives: int, negatives: int) -> DataFrame:
    count = len(a["id"])
    first = Anchors(*(a[c] for c in ("id", "label", "vector", "norm", "angles")), np.full((count, 1), NONE), np.full((count, 1), -NONE), True, positives)
    _floor(first, sample)
    found = _scan(stored, first, {}).select("anchor", "rank", "score", "id").toArrow()  # positives of this pass's anchors only
    at = found.column("anchor").to_numpy(), found.column("rank").to_numpy() - 1
    score, ids = np.zeros((count, positives), np.int64), np.zeros((count, positives), np.int64)
    low, high = np.ones((count, positives), np.int64), np.zeros((count, positives), np.int64)
    score[at], ids[at] = found.column("score").to_numpy(), found.column("id").to_numpy()
    low[at], high[at] = share.of(score[at])
    second = Anchors(*(a[c] for c in ("id", "label", "vector", "norm", "angles")), low, high, False, negatives)
    _floor(second, sample)
    every = {"anchor_id": np.repeat(a["id"][:, None], positives, 1), "positive_id": ids, "positive_score": score}
    return _scan(stored, second, every).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
