"""Sharding by extendible hashing.

Documents are hashed, and the leading bits of the hash index a directory.  It starts as one bucket; a bucket that is
over the byte limit splits on its next bit, and only such a bucket does, until every shard fits.  The sizes of all
candidate buckets of some levels come from one aggregate per hash prefix; only prefixes that are still too large
at the finest level are aggregated again, some bits deeper.  Sizes and directory stay Spark tables.

Cases: a bucket whose rows all have one hash cannot split.  That is one document above the limit, which is a shard of its
own, or rows that repeat id and text, which are dealt to numbered parts of the shard within the limit.  Null texts have no
bytes; null ids hash as an empty id; an empty table has no shards; other columns take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, keep

#: Text bytes of a shard.
SHARD_BYTES = 64 << 20
_BITS = 60
_DEEPER = 8


def hash_bits(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The first 60 bits of an md5 over id and text."""
    texts = F.coalesce(F.col(text), F.lit(""))
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(texts.cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def _prefix(h: str, depth: int) -> Column:
    return F.shiftright(F.col(h), _BITS - depth)


def directory(hashed: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """From rows ``(hash, bytes)``: per pass its finest depth and a table ``(prefix, shard, depth, shard_bytes, shard_docs,
    repeats)`` of the prefixes at that depth.  ``repeats`` marks shards of one hash above the limit."""
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    low, fine = 0, min(_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 3))
    rest, passes = hashed, []
    while True:
        finest = keep(rest.groupBy(_prefix("hash", fine).alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("hash").alias("least"), F.max("hash").alias("most")), "prefixes")
        up = finest.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(fine))))
        at = F.call_function("shiftright", F.col("prefix"), (F.lit(fine) - F.col("depth")).cast("int"))
        nodes = up.groupBy("depth", at.alias("node")).agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("least").alias("least"), F.max("most").alias("most"))
        settled = (F.col("shard_bytes") <= limit) | (F.col("least") == F.col("most"))
        # Settling is inherited, so the shard of a prefix is its first settled ancestor.
        found = up.select("prefix", "depth", at.alias("node")).join(nodes.where(settled), ["depth", "node"]).groupBy("prefix").agg(
            F.min_by(F.struct("depth", "node", "shard_bytes", "shard_docs", "least", "most"), "depth").alias("s"))
        bits = F.lpad(F.bin("s.node"), F.col("s.depth"), "0")
        passes.append((fine, keep(found.select(
            "prefix", F.when(F.col("s.depth") == 0, "").otherwise(bits).alias("shard"), F.col("s.depth").alias("depth"),
            F.col("s.shard_bytes").alias("shard_bytes"), F.col("s.shard_docs").alias("shard_docs"),
            ((F.col("s.shard_bytes") > limit) & (F.col("s.shard_docs") > 1)).alias("repeats")), "directory")))
        large = keep(finest.where(f"bytes > {limit} and least <> most").select("prefix"), "large")
        if fine == _BITS or large.isEmpty():
            return passes
        rest = keep(rest.join(large, _prefix("hash", fine) == F.col("prefix"), "left_semi"), "rest")
        low, fine = fine + 1, min(_BITS, fine + _DEEPER)


def assign_shards(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES,
                  name: str | None = None) -> DataFrame:
    """``docs`` with a struct ``{n_bytes, shard, depth, shard_bytes, shard_docs}``; ``shard`` is the bits of its bucket (and the
    number of its part where rows repeat beyond the limit), shard_bytes and shard_docs are those of the bucket."""
    name = name or free_name(docs, "sharding")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    passes = directory(docs.select(hash_bits(doc_id, text).alias("hash"), size.alias("bytes")), limit)
    h = free_name(docs, "hash_bits")
    out, found = docs.withColumn(h, hash_bits(doc_id, text)), []
    fields = ["shard", "depth", "shard_bytes", "shard_docs", "repeats"]
    for k, (fine, entries) in enumerate(passes):
        key, entry = free_name(docs, f"prefix_{k}"), free_name(docs, f"entry_{k}")
        out = out.join(entries.select(F.col("prefix").alias(key), F.struct(*fields).alias(entry)),
                       _prefix(h, fine) == F.col(key), "left").drop(key)
        found.append(entry)
    shard = F.coalesce(*[F.col(f) for f in found])
    out = out.withColumn(name, F.struct(size.alias("n_bytes"), *[shard[f].alias(f) for f in fields])).drop(*found)
    if any(not entries.where("repeats").isEmpty() for _, entries in passes):
        part, number = free_name(docs, "part"), free_name(docs, "number")
        single = out.where(~F.col(name)["repeats"])
        many = out.where(F.col(name)["repeats"]).withColumn(part, F.spark_partition_id())
        many = many.withColumn(number, F.row_number().over(Window.partitionBy(h, part).orderBy(h)) - 1)
        fits = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col(name)["n_bytes"])))
        label = F.concat_ws("-", F.col(name)["shard"], F.col(part), F.floor(F.col(number) / fits).cast("string"))
        out = single.unionByName(many.withColumn(name, F.col(name).withField("shard", label)).drop(part, number))
    return out.withColumn(name, F.col(name).dropFields("repeats")).drop(h)


def write_shards(docs: DataFrame, target: str, **options) -> None:
    """One folder of files per shard under ``target``; a shard fits one task by its limit."""
    name = free_name(docs, "sharding")
    placed = assign_shards(docs, name=name, **options)
    column = free_name(docs, "shard")
    placed.withColumn(column, F.concat(F.lit("b"), F.col(name)["shard"])).drop(name).repartition(F.col(column)) \
        .write.partitionBy(column).parquet(target)
