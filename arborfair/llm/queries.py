"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bottomk, decontaminate, divergence, hard_negatives, language_id, periodic_runs, pieces_viterbi, quality_gam, repeats, sharding, token_counts,
    token_files, transducer,
)
from .common import attach, keep, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def op1_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.digest(repeats.remove_repeats(docs, name="cut"), "cut")


def op2_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = keep(quality_gam.with_features(table(spark, sf_dir, "documents")), "features")
    return quality_gam.score(featured, quality_gam.fit(featured, table(spark, sf_dir, "labels")))


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = divergence.judge(docs.select("doc_id", "text"), divergence.fit_references(docs), name="rules")
    return judged.select("doc_id", "rules.*")


def op4_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op5_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"), name="found")
    return decontaminate.digest(marked, "found")


def op6_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, name="placed").select("doc_id", "placed.*")


def op7_segmentation_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    model = language_id.fit(docs.where(~out), path)
    named = language_id.identify(docs.select("doc_id", "text"), model, path, name="named")
    return named.select("doc_id", out.alias("held_out"), "named.*")


def op8_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces_viterbi.round_trip(docs, path, name="coded").select("doc_id", "coded.*")


def op9_elias_fano_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = token_files.scratch_path(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), target, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, target)


def op10_rank_synchronous_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(docs, path, name="counted").select("doc_id", "counted.*")


def op11_angular_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, label=label)


def op12_tiled_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digest(periodic_runs.find_runs(docs))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth document, by the crc32 of its id, gets a tail of words that repeats itself."""
    def change(batch):
        texts = batch.column("text").to_pylist()
        for i, h in enumerate(batch.column("h").to_pylist()):
            w = _WORD.findall(texts[i] or "") if h is not None and h % 10 == 0 else []
            if n := len(w):
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                texts[i] = " ".join(w[:a] + [w[a + (k % p)] for k in range(n - a)])
        return [pa.array(texts, pa.string())]

    hashed = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    return attach(hashed, "changed", "text string", change).select("doc_id", "changed.text")


def op13_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    return transducer.round_trip(docs, path, transducer.fit_lexicon(docs, path), name="coded").select("doc_id", "coded.*")


QUERIES = {f.__name__: f for f in (
    op1_repeated_phrases, op2_additive_quality, op3_divergence_rules, op4_bottom_k_near_duplicates, op5_wu_manber_decontamination,
    op6_extendible_hash_shards, op7_segmentation_language_id, op8_piece_viterbi, op9_elias_fano_token_files, op10_rank_synchronous_token_counts,
    op11_angular_hard_negatives, op12_tiled_periodic_runs, op13_transducer_bpe,
)}
