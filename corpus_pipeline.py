"""Documents to training tokens: five stages, each an operator of ``postlake.llm``.

A stage takes the documents that its predecessor kept, and its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import linededup, mixing, ngramjoin, quality, spieces
from postlake.llm.common import stored, table
from postlake.llm.queries import PIECES


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine doesn't reject (score of 0.3 or more), whole."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that occur earlier; n_chars follows the text."""
    cleaned = linededup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a similarity of 0.8."""
    return ngramjoin.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; in a partial epoch, the classifier's score is its quality weight.

    The score isn't a column of documents, so the classifier is fitted again, on the same rows as in the first stage.
    """
    machine = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs.select("doc_id", "text", "source", "n_chars"), machine)
    return mixing.repeat_mixed(docs, scored=scored, quality=F.col("score"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each document."""
    return spieces.encode(docs, PIECES)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_jaccard),
          ("mixing sources", mix_sources), ("SentencePiece", sentencepiece)]

#: SQL can express neither the trained classifier nor the tokenizer; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
