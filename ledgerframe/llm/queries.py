"""One query per operator, with production parameters over its whole table, and SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, pagediff, pieces, repeats, scoring, tokenfiles, toxicity, urls, vectors
from .common import Scratch, table
from .decontaminate import benchmark_matches

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("files")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path)
    return tokenfiles.checksums(tokenfiles.read_tokens(spark, path))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op2_backoff_scores_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's production order, 3: trigrams where they were seen, else as order 2."""
    return _rounded(scoring.backoff_scores(table(spark, sf_dir, "documents")))


def op2_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 2, as in its SQL."""
    return _rounded(scoring.backoff_scores(table(spark, sf_dir, "documents"), order=2))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_text(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents")))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"), within=True).withColumn("n_words", F.expr("end_word - start_word"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_files, op2_backoff_scores_order3, op2_backoff_scores, op3_main_text, op4_sentencepiece, op5_minhash_near_duplicates, op6_url_rules, op7_toxicity, op8_decontamination, op9_near_vectors, op10_repeated_passages)}


def oracle_sql() -> dict[str, str]:
    return {"op2_backoff_scores_order3": scoring.ORACLE_3, "op2_backoff_scores": scoring.ORACLE, "op5_minhash_near_duplicates": minhash.ORACLE, "op6_url_rules": urls.ORACLE, "op9_near_vectors": vectors.ORACLE, "op10_repeated_passages": repeats.ORACLE}
