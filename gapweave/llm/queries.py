"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm import decontamination, dual_tree, exact_dedup, hard_negatives, language_id, line_dedup, nearest, ngram_join, sentencepiece_bpe, token_counts, toxicity, vbyte, warc
from gapweave.llm.common import scratch, table
from gapweave.llm.features import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(table(spark, sf_dir, "documents"))


def sentencepiece_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    return sentencepiece_bpe.digests(docs, vocabulary("piece_bpe_32k.model"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.write_and_count(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), separator=50256)


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vbyte.write_and_read(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, report=True).drop("source")


ORACLE_SQL["op8_line_dedup"] = line_dedup.SQL


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op5_decontamination"] = decontamination.SQL


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, "warc"))


ORACLE_SQL["op6_warc"] = warc.SQL


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model | None:
    """Learnt from the labels of documents that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    return toxicity.fit(docs, labels)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return toxicity.score(docs, toxicity_model(spark, sf_dir))


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.clustered(table(spark, sf_dir, "embeddings"), F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256), k=40, rounds=5, dims=64)


ORACLE_SQL["op11_centroids"] = dual_tree.SQL


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 50 == 0)


ORACLE_SQL["op12_hard_negatives"] = hard_negatives.SQL


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assigned(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_exact_dedup"] = exact_dedup.SQL
