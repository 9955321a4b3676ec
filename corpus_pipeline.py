"""From raw documents to token ids in five stages, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of ``documents``, whatever others there are and whatever they are called. Null texts count as
empty texts and stay; rows with a null id stay (no group, passage or match can name them); rows that repeat an id are judged and cut one by one,
but near duplicates go by id; very long texts are read whole; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import pieces
from ledgerframe.llm.common import Scratch, without_ids
from ledgerframe.llm.decontaminate import clean_documents
from ledgerframe.llm.minhash import near_duplicates
from ledgerframe.llm.repeats import remove_repeats
from ledgerframe.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The score is learned from labels of the given documents."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays; of rows that repeat an id, all or none."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return without_ids(docs, Scratch(spark, "gone").write(gone, "ids"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that has them and are cut from all others."""
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the source bytes of each piece, and their number, for each doc_id."""
    rows = pieces.encode(docs)
    return rows.select("doc_id", "ids", "starts", "ends", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("repeats", repeats), ("decontamination", decontamination), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole table ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)  # nothing reads it any more
        last = name
    return docs


#: DuckDB SQL can express neither the learned score nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None
