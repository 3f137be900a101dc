"""Queries of the text operators: (spark, folder of parquet tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autostat.llm import bpe, conversations, fingerprints, jaccard, language, lm, mixing, pii, quality, repeats, resample, trie, warc
from autostat.llm.oracle import ORACLE  # noqa: F401  registered beside the queries
from autostat.sources.checkpoints import delete_at_exit, new_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    listed = lambda of: F.array_join(
        F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    found = pii.tagged(table(spark, folder, "documents"))
    base = found.withColumn("base", F.filter("spans", lambda s: s["base"]))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return base.select(
        "doc_id", *[number(k) for k in ("email", "ip", "card", "phone")],
        sha256(listed(F.col("base"))).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.joined(table(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rendered(table(spark, folder, "conversations"))


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = lm.train(docs.where(~lm.held_out("doc_id")))
    scored = lm.scored(model, docs)
    return scored.select(
        "doc_id", lm.held_out("doc_id").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents")).select("doc_id", "source", "lang", "text", *mixing.ADDED)


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), TOKENIZER).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        sha256(F.col("text")).alias("decoded_sha256"),
    )


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.fingerprinted(fingerprints.versions(table(spark, folder, "documents")))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), sha256(F.col("edited")).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.archived(warc.resolved(warc.records(table(spark, folder, "pages"))), path)
    delete_at_exit(spark, path)
    return warc.read_archives(spark, path, payloads=False).select(
        F.col("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = lm.held_out("doc_id", folds=4, fold=2)
    found = language.predicted(language.train(docs.where(~held_out)), docs)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_ngram_jaccard, op3_quality_rules, op4_chat_snapshots, op5_suffix_dedup, op6_lm_scoring,
        op7_source_mixing, op8_bpe, op9_fingerprints, op10_warc, op11_resampling,
        op12_language_id, op13_prefix_trie,
    )
}
