"""From raw documents to tokens: filter, deduplicate, redact, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autostat.llm import bpe, jaccard, mixing, pii, quality
from autostat.llm.queries import TOKENIZER
from autostat.sources.checkpoints import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality.passing(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return jaccard.one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is cut out of the texts; n_chars follows."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the weights of their sources, in mixed order; copies keep their doc_id."""
    return mixing.mixed(docs).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, packed token ids, and the text decoded from them, of every row."""
    return bpe.round_trip(docs, TOKENIZER).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", ngram_jaccard),
    ("pii", private_data),
    ("source mixing", source_mixing),
    ("bpe", byte_bpe),
]

#: The classifier and the tokenizer are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
