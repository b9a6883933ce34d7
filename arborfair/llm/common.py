"""What the text operators share: shared tables, free column names, bounded pieces of Arrow data."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time (one longer text is one piece).
PIECE_BYTES = 1 << 18
#: Bytes of text in one slice of the documents that a cogrouped task holds.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and everything runs on one machine, as in
    tests, one is made and set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="arborfair-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_open_scratch: list[list[str]] = []


def keep(df: DataFrame, name: str, *, lasting: bool = False) -> DataFrame:
    """Write to the shared folder of ``spark.checkpoint.dir`` and read back: no lineage, and a lost
    executor costs a re-read.  Inside ``scratch`` the table goes when the block ends, unless it is ``lasting``."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _open_scratch and not lasting:
        _open_scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside this block are deleted when it ends; what leaves it must be written by then."""
    _open_scratch.append([])
    try:
        yield
    finally:
        for path in _open_scratch.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def pieces(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows with about ``limit`` bytes of text each (PIECE_BYTES if not given), one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    if len(sizes) == 0:
        return
    at = np.cumsum(sizes.astype(np.int64) + 16) // (limit or PIECE_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def strings(column) -> pa.Array:
    """One string array without nulls (a null is an empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def raw_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column in one array, and where each row begins and the last ends."""
    column = strings(column)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def text_parts(column, limit: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Groups of texts with about ``limit`` bytes each, and the row that each text belongs to.

    A longer text is cut in front of ASCII blanks into several consecutive texts of one row, so that words stay whole
    (a single word may be longer).  Nothing is copied."""
    limit = limit or PIECE_BYTES
    data, at = raw_bytes(column)
    cuts, owner = [0], []
    for row in range(len(at) - 1):
        lo, end = int(at[row]), int(at[row + 1])
        while end - lo > limit:
            cut = _next_blank(data, lo + limit, end)
            if cut == end:
                break
            cuts.append(cut)
            owner.append(row)
            lo = cut
        cuts.append(end)
        owner.append(row)
    cuts, owner = np.array(cuts, np.int64), np.array(owner, np.int64)
    group = (cuts[1:] + 16 * np.arange(1, len(cuts))) // limit if len(owner) else owner
    borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(owner)]
    for lo, hi in zip(borders[:-1], borders[1:]):
        if hi > lo:
            a, b = int(cuts[lo]), int(cuts[hi])
            buffers = [None, pa.py_buffer(cuts[lo:hi + 1] - a), pa.py_buffer(data[a:b])]
            yield pa.Array.from_buffers(pa.large_string(), hi - lo, buffers), owner[lo:hi]


def _next_blank(data: np.ndarray, lo: int, end: int) -> int:
    """The first ASCII blank from ``lo`` on, or ``end``."""
    while lo < end:
        part = data[lo:min(lo + 4096, end)]
        found = np.flatnonzero((part == 0x20) | ((part >= 0x09) & (part <= 0x0D)))
        if len(found):
            return lo + int(found[0])
        lo += len(part)
    return end


def attach(docs: DataFrame, name: str, fields: str, compute, sized_by: str | None = "text",
           piece_bytes: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with one struct column more, computed piece by piece.

    ``compute(piece)`` gets rows as Arrow data and returns one array per field; pieces are cut by the size of the column
    ``sized_by`` (``piece_bytes``, else PIECE_BYTES), or are Spark's batches."""
    from pyspark.sql.types import StructType

    columns = docs.columns
    schema = StructType([*docs.schema.fields]).add(name, StructType.fromDDL(fields))
    names = [f.name for f in StructType.fromDDL(fields).fields]

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, sized_by, piece_bytes) if sized_by else [batch]:
                made = pa.StructArray.from_arrays(compute(piece), names=names)
                yield pa.RecordBatch.from_arrays([*piece.columns, made], names=[*columns, name])

    return docs.mapInArrow(run, schema)
