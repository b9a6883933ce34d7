"""Near-duplicate documents from bottom-k sketches.

A document is its set of distinct word shingles.  One hash function orders all shingles, and a sketch keeps the k
least values of a set.  Documents with equal sets are one class from the start and are never compared.

1. *Inverted lists.*  Each pair of neighbouring values of a sketch has a list of the sketches that hold it.  Of two sets
   with a similarity of 0.8, each of the k least values of the union lies in both with probability 0.8, and two such values
   in a row make a common pair; 32 values without two in a row have a probability of 5 in 10**10.  If both sets
   have no more than k shingles, a common pair is certain.  A passage that many documents share fills no lists: its
   values are seldom neighbours among the others.
2. *Candidates.*  A list is not expanded into all its pairs.  In star rounds its members are compared with the member that
   has most in common with others and with one picked by hash; then only pairs of different components are left to
   compare, and all of these are, sorted by size: sets of more than a quarter's difference never meet.
   A list whose members are all of one component is closed and not read again.
   Every pair must pass an exact bound inside the join that makes it: the parities of the hash buckets of two sets differ in
   at most as many buckets as the sets differ in shingles.
3. *Union sketch.*  The k least values of both sketches together estimate the similarity; pairs that share fewer
   than ``NEED`` of them are dropped (one linked pair in 10**9).
4. *Exact Jaccard* on the full sets confirms what remains.  Sketches and texts are read where they lie and shuffled only if a
   bitmap of fixed size allows that a pair asks for them.

Cases: a null or empty text has the empty set and is linked with nothing but stays as a row; one word is one shingle;
null ids take part and never name a component unless it has no other; rows that repeat an id are returned as often
and share a component; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pieces, scratch
from .components import components
from .words import BLANK_WORDS, find_words, mix, window_hashes, window_starts

#: Values kept of each set, and shared values that a link is sure to have.
SKETCH = 32
NEED = 11
#: Buckets whose parities bound the difference of two sets.
PARITIES = 512
#: Words of a shingle, unless a caller asks for others.
SHINGLE = 5
_PER_CENT = 80
#: Sets that may be linked are in the same or in neighbouring bands of sizes (a little wider than 100 / _PER_CENT).
_BAND = 1.2501
#: Bits of a node's number that choose its word in the bitmap of asked nodes.
_WORD_BITS = 17


def shingle_sets(column, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each text, ascending, all texts in one array; and where each text begins."""
    w = find_words(column, BLANK_WORDS, lower=True)
    starts = np.flatnonzero(window_starts(w.first, shingle))
    h, row = window_hashes(w.hash, shingle)[starts], w.row[starts]
    short = np.flatnonzero((w.counts > 0) & (w.counts < shingle))
    if len(short):  # the whole sequence is the only shingle
        whole = [w.hash[w.first[r]:w.first[r + 1]] for r in short]
        h = np.concatenate([h, [np.bitwise_xor.reduce(mix(x + np.arange(1, len(x) + 1, dtype=np.uint64))) for x in whole]])
        row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, np.searchsorted(row, np.arange(len(w.counts) + 1))


def _sketches(sketch: int, shingle: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                h, first = shingle_sets(piece.column("text"), shingle)
                n = np.diff(first)
                # Two sums over the set name its class.
                total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)))]) for salt in (0x5851F42D, 0x14057B7E)]
                a, b = ((t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total)
                bucket = np.repeat(np.arange(len(n)), n) * PARITIES + (mix(h) >> np.uint64(55)).astype(np.int64)
                odd = np.bincount(bucket, minlength=len(n) * PARITIES).astype(np.uint8) & 1
                odd = np.packbits(odd, bitorder="little").view(np.int64)
                # The order of the shingles is that of their fingerprints, as signed numbers.
                signed = h.view(np.int64)
                kept = [np.sort(signed[i:j])[:sketch] for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("row_key"), pa.array(n.astype(np.int64)), pa.array(a), pa.array(b),
                     pa.array(kept, pa.list_(pa.int64())), pa.FixedSizeListArray.from_arrays(pa.array(odd), PARITIES // 64).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "row_key", "n_shingles", "set_a", "set_b", "sketch", "odd"])
    return run


def _neighbours():
    """The keys of the neighbouring values of a sketch of two or more."""
    return F.transform(F.sequence(F.lit(1), F.size("sketch") - 1), lambda i: F.xxhash64(F.get("sketch", i - 1), F.get("sketch", i)))


def _postings(classes: DataFrame) -> DataFrame:
    """``(value, node, weight)``: the lists of neighbouring sketch values that hold more than one node; the weight of a node is
    the length of all its lists."""
    listed = classes.where(F.size("sketch") > 1).select(F.explode(_neighbours()).alias("value"), "node")
    lists = keep(listed.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    postings = keep(listed.join(lists, "value"), "postings")
    weights = postings.groupBy("node").agg(F.sum("n").alias("weight"))
    sizes = classes.select("node", "n_shingles", "odd")
    return keep(postings.join(weights, "node").join(sizes, "node").select("value", "node", "weight", "n_shingles", "odd"), "postings")


def _may_link(a, b):
    """Whether sizes and parities leave room for a link: the sets differ in at most a ninth of their shingles together."""
    together = a["n_shingles"] + b["n_shingles"]
    differ = sum((F.bit_count(F.get(a["odd"], F.lit(i)).bitwiseXOR(F.get(b["odd"], F.lit(i)))) for i in range(PARITIES // 64)), F.lit(0))
    sizes = 100 * F.least(a["n_shingles"], b["n_shingles"]) >= _PER_CENT * F.greatest(a["n_shingles"], b["n_shingles"])
    return sizes & (differ * (100 + _PER_CENT) <= together * (100 - _PER_CENT))


def _asked(table: DataFrame, node, pairs: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``node`` may be an end of ``pairs``: all that are, and few others while ends are few."""
    word = lambda n: F.shiftrightunsigned(n, 64 - _WORD_BITS)
    bit = lambda n: F.shiftrightunsigned(n, 58 - _WORD_BITS).bitwiseAND(63).cast("int")
    ends = pairs.select(F.col("u").alias("end")).unionAll(pairs.select("v"))
    bits = ends.groupBy(word("end").alias("asked_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("end")))).alias("asked_bits"))
    marked = table.withColumns({"asked_at": word(node), "asked_bit": bit(node)})
    there = F.call_function("shiftrightunsigned", F.col("asked_bits"), F.col("asked_bit")).bitwiseAND(1) == 1
    return marked.join(F.broadcast(bits), (F.col("asked_at") == F.col("asked_word")) & there).select(*table.columns)


def _exact(pairs: DataFrame, narrow: DataFrame, shingle: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets are similar enough; ``narrow`` has the texts of all rows.  Each text that pairs ask
    for is cut into shingles once."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                h, first = shingle_sets(piece.column("text"), shingle)
                sets = pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column("node"), sets], names=["node", "shingles"])

    ends = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct()
    texts = _asked(narrow, F.col("row_key"), pairs).select(F.col("row_key").alias("node"), "text")
    texts = texts.join(ends, "node", "left_semi").dropDuplicates(["node"])
    sets = keep(texts.mapInArrow(run, "node long, shingles array<bigint>"), "sets")
    named = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}"))
    joined = pairs.join(named("v"), "v").join(named("u"), "u")
    counted = joined.select("u", "v", F.size(F.array_intersect("set_u", "set_v")).cast("long").alias("both"), (F.size("set_u").cast("long") + F.size("set_v")).alias("together"))
    return counted.where(100 * F.col("both") >= _PER_CENT * (F.col("together") - F.col("both"))).select("u", "v")


def _alike(pairs: DataFrame, classes: DataFrame, sketch: int) -> DataFrame:
    """Pairs ``(u, v)`` that the union sketch leaves possible."""
    held = _asked(classes.select("node", "sketch"), F.col("node"), pairs)
    named = lambda end: held.select(F.col("node").alias(end), F.col("sketch").alias(f"s_{end}"))
    joined = pairs.join(named("v"), "v").join(named("u"), "u")
    union = F.slice(F.array_sort(F.array_union("s_u", "s_v")), 1, sketch)
    counted = joined.select("u", "v", F.size(union).alias("k"), F.size(F.array_intersect(F.array_intersect(union, F.col("s_u")), F.col("s_v"))).alias("both"))
    enough = F.when(F.col("k") < sketch, 100 * F.col("both") >= _PER_CENT * F.col("k")).otherwise(F.col("both") >= NEED)
    return counted.where(enough).select("u", "v")


def _open(listed: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with all their members."""
    several = listed.groupBy("value").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("value")
    return listed.join(several, "value", "left_semi")


def _compared(open_lists: DataFrame) -> DataFrame:
    """All pairs ``(u, v)`` of different components that share a list and may be linked."""
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(_BAND)))
    rest = ["value", "node", "component", "n_shingles", "odd", "keys"]
    left = open_lists.select(*rest, band.alias("band"), F.lit(0).alias("below")).alias("a")
    # Each member meets those of its own band that follow it, and all of the band below.
    right = open_lists.select(*rest, F.posexplode(F.array(band, band - 1)).alias("below", "band")).alias("b")
    a, b = ({c: F.col(f"{side}.{c}") for c in [*rest, "band", "below"]} for side in "ab")
    # A pair that shares several lists comes out of the first of them only.
    once = a["value"] == F.array_min(F.array_intersect(a["keys"], b["keys"]))
    follows = (b["below"] == 1) | (a["node"] < b["node"])
    pairs = left.join(right, (a["value"] == b["value"]) & (a["band"] == b["band"]) & follows & (a["component"] != b["component"]) & _may_link(a, b) & once)
    return pairs.select(F.least(a["node"], b["node"]).alias("u"), F.greatest(a["node"], b["node"]).alias("v"))


def row_key(doc_id="doc_id", text="text"):
    """The number that stands for an id together with its text."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    sketch: int = SKETCH, key: str | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``, and ``row_key`` under the name ``key`` if given.

    An id that stands for several texts is several documents: each text is linked on its own, and both components
    may be named by that id.  So a caller who filters ``docs`` by the result must match ``key``, not the id."""
    with scratch(docs.sparkSession):  # what the result reads stays, all other tables go here
        narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        narrow = narrow.withColumn("row_key", row_key())
        kind = "doc_id long, row_key long, n_shingles long, set_a long, set_b long, sketch array<bigint>, odd array<bigint>"
        rows = keep(narrow.mapInArrow(_sketches(sketch, shingle), kind), "sketches", lasting=True)
        name = ["set_a", "set_b", "n_shingles"]
        classes = keep(rows.where("n_shingles > 0").groupBy(*name).agg(
            F.min("row_key").alias("node"), F.any_value("sketch").alias("sketch"), F.any_value("odd").alias("odd"), F.min("doc_id").alias("least_id")), "classes")
        postings = _postings(classes)

        links, tested = None, None
        for round_number in range(3):
            if links is None:
                listed = postings.withColumn("component", F.col("node"))
            else:
                labels = components(links)
                listed = keep(_open(listed.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))), "open")
            if round_number < 2:
                # All lists agree on how they prefer nodes, so a group of copies tends to share its leaders.
                rest = ["node", "component", "n_shingles", "odd"]
                central = F.struct(-F.col("weight"), F.xxhash64("node", F.lit(round_number)), *rest)
                any_one = F.struct(F.xxhash64("node", F.lit(round_number)), *rest)
                leaders = keep(listed.groupBy("value").agg(F.min(central).alias("lead_0"), F.min(any_one).alias("lead_1")).select(
                    "value", F.explode(F.array(*[F.struct(*[F.col(f"lead_{i}.{c}") for c in rest]) for i in range(2)])).alias("lead")), "leaders")
                here = {c: listed[c] for c in rest}
                pairs = listed.join(leaders, (listed["value"] == leaders["value"]) & (listed["component"] != F.col("lead.component"))
                                    & _may_link(here, F.col("lead"))).select(
                    F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v"))
            else:
                keys = classes.where(F.size("sketch") > 1).select("node", _neighbours().alias("keys"))
                pairs = _compared(keep(listed.join(keys, "node"), "open"))
            pairs = pairs.distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["u", "v"], "left_anti")
            possible = keep(_alike(keep(pairs, "candidates"), classes, sketch), "pairs")
            tested = possible if tested is None else tested.unionAll(possible)
            found = keep(_exact(possible, narrow, shingle), "links")
            links = found if links is None else links.unionAll(found)

        labels = components(links)
        named = classes.join(labels, "node", "left").select(*name, "least_id", F.coalesce("component", "node").alias("component"))
        # Both sides written: a component of very many classes is then split by the adaptive join.
        named = keep(named, "named", lasting=True)
        least = keep(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "least", lasting=True)
        named = named.join(least, "component").select(*name, "component_id", F.lit(True).alias("named"))
    out = rows.select("doc_id", "row_key", *name).join(named, name, "left")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    more = [F.col("row_key").alias(key)] if key else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), *more)
