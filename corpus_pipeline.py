"""A pipeline over documents: five stages, each written as Parquet and read again as the next one's documents.

Null and empty texts are scored like others, have no lines, shingles or contained items, and are encoded to no ids, so they
go through all stages. Texts of any length are worked on whole. Of documents that are near copies the smallest doc_id stays,
a null id being smaller than all; rows of equal doc_id are one document and stay or go together. Without labels of
both kinds nothing counts as toxic, without benchmark items nothing as contaminated. An empty table of documents gives no
rows. Columns beside text come through all stages but the last untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm import decontamination, line_dedup, ngram_join, queries, toxicity
from gapweave.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are too frequent on their source go; all documents stay, n_chars follows the text."""
    return line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarity, the one with the smallest doc_id stays."""
    return ngram_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of what is left, and of the texts that they decode to."""
    return queries.sentencepiece_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece", encode_pieces),
]

#: Training a classifier, MinHash pruning and tokenising are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages leave of the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
