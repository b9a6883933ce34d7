"""Token ids in binary blocks whose document boundaries are Elias-Fano coded.

A block is ``magic, n_docs, n_ids, id width, low width`` and then the low bits of all boundaries, the high bits in
unary, the number of ones before every 512 bits, and the ids of all documents one after another.  Of n boundaries
up to u it takes about ``2 + log2(u / n)`` bits each; ``select`` finds a boundary from the samples and one superblock.
Blocks are rows of a Parquet table, since that is what every store Spark writes to can hold; within a part they are
numbered, and parts follow each other in ascending order of document id.

Cases: a null or empty text is just its end id; null document ids come first; rows that repeat an id are neighbours,
ordered by text; an empty table writes no block and reads back no row; extra columns are not read.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, pieces, raw_bytes, shared_folder, strings, text_bytes
from .units import UnitCoder

MAGIC = b"EFB1"
_HEADER = struct.Struct("<4sQQBB")
_SUPER = 512
#: Text bytes of a part.
PART_BYTES = 16 << 20
#: Blanks that are not ASCII, or only sometimes blanks: a text that has one is encoded as it is.
_ODD = regex.compile(r"[\x1c-\x1f\x85\p{Cf}]|(?! )\p{Z}")
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        width = max(0, int(math.floor(math.log2(universe / n)))) if n and universe > n else 0
        low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
        bits = np.zeros(-(-((universe >> width) + n + 1) // _SUPER) * _SUPER, np.uint8)
        bits[(values >> width) + np.arange(n)] = 1
        ones = bits.reshape(-1, _SUPER).sum(axis=1)
        samples = (np.cumsum(ones) - ones).astype("<u4")
        return cls(n, width, np.packbits(low.reshape(-1), bitorder="little"), np.packbits(bits, bitorder="little"), samples)

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        out = np.empty(len(i), np.int64)
        for lo in range(0, len(i), 1024):
            at = i[lo:lo + 1024]
            block = np.searchsorted(self.samples, at, "right") - 1
            rows = self.high.reshape(-1, _SUPER // 8)[block]
            ones = np.cumsum(np.unpackbits(rows, axis=1, bitorder="little"), axis=1, dtype=np.int32)
            place = (ones <= (at - self.samples[block])[:, None]).sum(axis=1)
            bit = at[:, None] * self.width + np.arange(self.width)
            low = (((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << np.arange(self.width)).sum(axis=1)
            out[lo:lo + 1024] = ((block * _SUPER + place - at) << self.width) | low
        return out


def pack_block(ends: np.ndarray, ids: np.ndarray, wide: bool) -> bytes:
    ef = EliasFano.encode(ends, len(ids))
    head = _HEADER.pack(MAGIC, ef.n, len(ids), 4 if wide else 2, ef.width)
    sizes = struct.pack("<QQQ", len(ef.low), len(ef.high), len(ef.samples))
    return b"".join([head, sizes, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), ids.astype("<u4" if wide else "<u2").tobytes()])


class Block:
    """Random access to the documents of a block."""

    def __init__(self, raw: bytes):
        magic, self.n_docs, self.n_ids, wide, width = _HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token block")
        low, high, samples = struct.unpack_from("<QQQ", raw, _HEADER.size)
        at = _HEADER.size + 24
        part = lambda kind, n, at: np.frombuffer(raw, kind, n, at)
        self.ends = EliasFano(self.n_docs, width, part(np.uint8, low, at), part(np.uint8, high, at + low),
                              part("<u4", samples, at + low + high))
        self.ids = part(f"<u{wide}", self.n_ids, at + low + high + 4 * samples)

    def starts_and_ends(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = self.ends.select(docs)
        return np.where(docs > 0, self.ends.select(np.maximum(docs - 1, 0)), 0), end

    def tokens(self, i: int) -> np.ndarray:
        (a,), (b,) = self.starts_and_ends(np.array([i]))
        return self.ids[a:b]


_coders: dict[str, tuple] = {}


def _coder(path: str):
    if path not in _coders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lists = [e.ids for k in range(0, len(units), 4096)
                     for e in tokenizer.encode_batch_fast(units[k:k + 4096], add_special_tokens=False)]
            return np.array([i for ids in lists for i in ids], np.int32), np.array([len(ids) for ids in lists], np.int64)

        _coders[path] = tokenizer, encode, UnitCoder(encode, _BLANK)
    return _coders[path]


def encode_column(column, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array and where each text begins, as the library encodes whole texts.

    The pre-tokenizer never joins a blank to what precedes it, so a text can be cut before its ASCII blanks and every
    distinct unit be encoded once.  Texts with other blanks are given to the library whole."""
    _, encode, units = _coder(path)
    column = strings(column)
    ids, first = units.code(column)
    data, rows = raw_bytes(column)
    marks = np.concatenate([[0], np.cumsum(_ODD_LEAD[data])])
    odd = [k for k in np.flatnonzero(marks[rows[1:]] > marks[rows[:-1]]).tolist() if _ODD.search(column[k].as_py())]
    if odd:
        parts = np.split(ids, first[1:-1])
        for k in odd:
            parts[k] = encode([column[k].as_py()])[0]
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        ids = np.concatenate(parts)
    return ids, first


def largest_id(path: str) -> int:
    """The largest id that a tokenizer file can give."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0)


def write_token_files(docs: DataFrame, target: str, path: str, *, doc_id: str = "doc_id", text: str = "text",
                      end_id: int = 0, wide: bool | None = None, part_bytes: int = PART_BYTES) -> None:
    """Write the ids of every text and ``end_id``, in ascending order of ``doc_id``, as a table of blocks at ``target``.

    Ids take 4 bytes if ``wide``, else 2; by default whatever the largest id of the vocabulary and ``end_id`` need."""
    largest = max(end_id, largest_id(path))
    if wide is None:
        wide = largest >= 1 << 16
    if end_id < 0 or largest >= 1 << (32 if wide else 16):
        raise ValueError(f"ids of {largest} or an end id of {end_id} do not fit into {4 if wide else 2} bytes")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = max(1, math.ceil(text_bytes(narrow) / part_bytes))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first(F.xxhash64("text")), F.asc_nulls_first("text")]
    dealt = narrow.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)

    def run(batches):
        part, number, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for piece in pieces(batch):
                ids, first = encode_column(piece.column("text"), path)
                n = piece.num_rows
                ended = np.insert(ids, first[1:], end_id)
                ends = first[1:] + np.arange(1, n + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
                     pa.array([len(ended)], pa.int64()), pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                     pa.array([pack_block(ends, ended, wide)], pa.binary())],
                    names=["part", "block", "start", "n_ids", "doc_ids", "payload"])
                number, start = number + 1, start + len(ended)

    kind = "part int, block int, start long, n_ids long, doc_ids array<bigint>, payload binary"
    dealt.mapInArrow(run, kind).write.option("compression", "zstd").parquet(target)


def read_token_files(spark: SparkSession, target: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the blocks at ``target``."""
    blocks = spark.read.parquet(target)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("size"))  # a row per part
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = keep(sizes.select("part", before.alias("before")), "offsets")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("start", "before", "doc_ids")}
                block = Block(batch.column("payload")[k].as_buffer())
                a, b = block.starts_and_ends(np.arange(block.n_docs))
                crc = [zlib.crc32(block.ids[i:j].astype("<u4").tobytes()) for i, j in zip(a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(a + row["start"].as_py() + row["before"].as_py(), pa.int64()),
                     pa.array(b - a, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(offsets, "part").select("start", "before", "doc_ids", "payload") \
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
