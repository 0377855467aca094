"""A training-data pipeline: documents in, token ids out. Each stage is one operator of talus.llm at its own defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import op2_substring_dedup, op7_simhash, op8_quality_rules, op9_sentencepiece, op10_decontaminate
from talus.llm.storage import keep, release, scratch
from talus.llm.tables import read
from talus.llm.vocabulary import default_model


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the model reject go."""
    return op8_quality_rules.filter_documents(docs, op8_quality_rules.train(docs, read(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return op7_simhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur earlier go from the texts; all documents stay, and n_chars follows the text."""
    return op2_substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, its slots changed or not, go."""
    return op10_decontaminate.filter_documents(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, the number of ids, and as text what the ids decode to."""
    return op9_sentencepiece.encode(docs, default_model(), decoded=True).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL expresses neither the trained model nor the tokenizer; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each leaves is a table in the shared folder, and goes when the next one's is written. That of
    the last but one stays, as the result reads it."""
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch(spark):
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"), stay=True)
        if number:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
