"""A corpus pipeline from five of the text operators.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept.  Every stage but the last returns the
columns of ``docs``; the last returns the piece ids of each document.

Cases: stages take null, empty and very long texts, repeated rows, empty tables and any further columns; what becomes of each is
said in the operators.  A document all of whose words are repeated elsewhere stays with an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfair.llm import bottomk, decontaminate, divergence, pieces_viterbi, repeats
from arborfair.llm.common import free_name, keep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence from all language references leave."""
    name = free_name(docs, "quality_rules")
    judged = divergence.judge(docs, divergence.fit_references(docs), name=name)
    return judged.where(F.col(name)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on shingles of five words: the one with the least id.

    Rows are matched by id and text, so a null id or one id of several texts decides about its own text only."""
    key = free_name(docs, "kept_row")
    kept = bottomk.near_duplicates(docs, key=key).where("kept").select(key).distinct()
    return docs.join(kept, bottomk.row_key() == F.col(key), "left_semi")


def repeated_phrases(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated passages; texts without any repeat stay as they are."""
    name = free_name(docs, "repeats")
    cut = repeats.remove_repeats(docs, name=name)
    text = F.when(F.col(name)["n_removed"] > 0, F.col(name)["kept"]).otherwise(F.col("text"))
    return cut.withColumn("text", text).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    name = free_name(docs, "contamination")
    marked = decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"), name=name)
    return marked.where(F.col(name)["n_hit"] == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_pieces, ids)``: the piece ids of each document."""
    name = free_name(docs, "pieces")
    coded = pieces_viterbi.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), name=name)
    ids = F.col(name)["ids"]
    return coded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_pieces"), ids.alias("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_phrases", repeated_phrases),
    ("decontamination", decontamination),
    ("encode", encode),
]
#: No SQL: reference histograms and the segmentation search have no equal there; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
