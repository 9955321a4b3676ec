"""Counters of a change log as one row, and of its files by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import latest


def log_stats(log: DataFrame, key: list[str]) -> DataFrame:
    """One row: writes, puts, deletes, last seq, keys, live keys and tombstones."""
    writes = log.agg(F.count("*").alias("writes"), F.count_if(F.col("op") == "P").alias("puts"), F.count_if(F.col("op") == "D").alias("deletes"), F.max("seq").alias("last_seq"))
    newest = latest(log.select(*key, "seq", "op"), key)
    keys = newest.agg(F.count("*").alias("keys"), F.count_if(F.col("op") != "D").alias("live_keys"), F.count_if(F.col("op") == "D").alias("tombstones"))
    return writes.crossJoin(keys)  # one row each


def level_stats(files: DataFrame) -> DataFrame:
    """By tier: files, rows and bytes, and the range of sequence numbers."""
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"))
