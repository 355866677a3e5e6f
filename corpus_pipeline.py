"""From raw documents to token ids: five stages, each one operator of corvane.llm.

Every stage takes and returns documents (doc_id, text, lang, source, n_chars); the last returns
each mixed document's token ids. n_chars follows the text where a stage changes it.

Documents with null, empty or blank text fail the quality rules and go with the first stage. Rows that repeat
whole stay one row after the join of near duplicates; rows that share only a doc_id are documents of their own.
Columns besides the five are let be, whatever their names. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, jaccard, line_dedup, mixing, quality
from corvane.llm.base import Scratch, n_words, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs.select(*COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; those that lose all their words go."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS))
    kept = done.where((F.col("n_removed") == 0) | (n_words(F.col("text")) > 0))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say."""
    return mixing.mix_sources(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit) and the SHA-256 of the decoded text."""
    coded = bpe.encode_documents(docs.select(*COLUMNS))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: n-gram joins and BPE can't be said in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    between = Scratch(spark)  # what a stage kept is deleted when the next one has written its own
    for _, stage in STAGES[:-1]:
        done = between.mark()
        docs = between.stored(stage(spark, docs, sf_dir))
        between.spent(done - 1, done)
    return STAGES[-1][1](spark, docs, sf_dir)
