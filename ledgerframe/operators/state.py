"""Current and past state of a change log, and the merge of its parts.

A change log has one row per write: seq (unique, increasing), op ('P' put, 'D' delete), the key columns and the value columns. Filters on
keys and ``seq <= t`` go below the merge; filters on values must stay above it, or older versions would come back to life.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = ("seq", "node_id", "ts", "op", "origin", "large")


def value_columns(log: DataFrame, key: list[str]) -> list[str]:
    return [c for c in log.columns if c not in (*META, *key)]


def rows_at(log: DataFrame, seqs: DataFrame) -> DataFrame:
    """The writes with these sequence numbers (one column ``seq``). Numbers are hashed on their side; the log is neither sorted nor gathered by key."""
    return log.join(seqs.hint("shuffle_hash"), "seq", "left_semi").select(*log.columns)


def latest(log: DataFrame, key: list[str]) -> DataFrame:
    """The newest row of each key, tombstones included.

    The newest number of each key is a hash aggregation over numbers and keys alone, summed before the shuffle; the rows with these
    numbers are then picked by an equi-join on seq, which is unique. So a hot key costs a task one number, and values are read but once.
    """
    return rows_at(log, log.groupBy(*key).agg(F.max("seq").alias("seq")).select("seq"))


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("op") != "D")


def current(log: DataFrame, key: list[str]) -> DataFrame:
    """The live rows: the newest of each key without those deleted."""
    return live(latest(log, key))


def as_of(log: DataFrame, key: list[str], seq: int) -> DataFrame:
    """The live rows as they were after write ``seq``."""
    return current(log.where(F.col("seq") <= seq), key)


def overlay(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``delta``, and those of ``base`` whose key ``delta`` does not have, whatever their seq."""
    return delta.unionByName(base.join(delta.select(*key).distinct(), key, "left_anti"))


def merge_runs(runs: list[DataFrame], key: list[str]) -> DataFrame:
    """The newest row of each key over several sorted runs; tombstones stay."""
    union = runs[0]
    for run in runs[1:]:
        union = union.unionByName(run)
    return latest(union, key)


def compact(runs: list[DataFrame], key: list[str], bottom: bool) -> DataFrame:
    """The merge of runs into one. Tombstones are dropped only where nothing older lies below (``bottom``)."""
    merged = merge_runs(runs, key)
    return live(merged) if bottom else merged


def compacted_state(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """The live rows of a compacted base and the writes since then."""
    return live(overlay(base, latest(delta, key), key))
