"""Versions of keys: history, lookups in the past, rollback and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .state import current, rows_at, value_columns


def history(log: DataFrame, keep: Column) -> DataFrame:
    """All versions, tombstones included, of the keys that ``keep`` selects, oldest first."""
    return log.where(keep).orderBy("seq")


def get_at(log: DataFrame, key: list[str], keep: Column, seq: int) -> DataFrame:
    """The selected keys as they were after write ``seq``; deleted or not yet written ones have no row."""
    return current(log.where(keep & (F.col("seq") <= seq)), key)


def rollback_targets(log: DataFrame, key: list[str], seq: int) -> DataFrame:
    """Keys written after ``seq``, with op and values that they had then (op 'D': deleted or not written yet)."""
    values = value_columns(log, key)
    then_seq = F.max(F.when(F.col("seq") <= seq, F.col("seq"))).alias("__then")
    found = log.groupBy(*key).agg(F.max("seq").alias("__last"), then_seq).where(F.col("__last") > seq).drop("__last")
    then = log.where(F.col("seq") <= seq).select(F.col("seq").alias("__then"), F.col("op").alias("__op"), *[F.when(F.col("op") == "P", F.col(c)).alias(c) for c in values])
    return found.join(then, "__then", "left").select(*key, F.coalesce("__op", F.lit("D")).alias("op"), *values)


def rollback_rows(log: DataFrame, key: list[str], seq: int, order: list[Column], keep: Column | None = None) -> DataFrame:
    """The writes that bring all keys (or the selected ones) back to their state after ``seq``: numbered on from the log's last, in key order.

    With ``keep`` (a rollback of single keys) each selected key gets a write, changed or not.
    """
    scope = log if keep is None else log.where(keep)
    targets = rollback_targets(scope, key, seq)
    if keep is not None:
        unchanged = current(scope.where(F.col("seq") <= seq), key).join(targets.select(*key), key, "left_anti")
        targets = targets.unionByName(unchanged.select(*targets.columns))
    last = log.agg(F.max("seq").alias("seq")).first()["seq"] or 0
    return numbered(targets, order, "seq", last + 1)


def prune_before(log: DataFrame, key: list[str], seq: int, keep_newest: bool = True) -> DataFrame:
    """The log without versions older than ``seq``.

    keep_newest: the newest older version of each key stays, so that states from ``seq`` on do not change; without
    it every older version goes, a key's only one too.
    """
    if not keep_newest:
        return log.where(F.col("seq") >= seq)
    kept = log.groupBy(*key).agg(F.max(F.when(F.col("seq") < seq, F.col("seq"))).alias("seq")).where("seq is not null").select("seq")
    return log.where(F.col("seq") >= seq).unionByName(rows_at(log.where(F.col("seq") < seq), kept))


#: Versions that one window of an as-of join holds.
BLOCK_ROWS = 2_000_000


def probe_as_of(log: DataFrame, key: list[str], probes: DataFrame, at: str, probe_id: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each probe (``probe_id``, key, ``at``) the newest version with seq <= at; probes without one have nulls.

    Versions and probes of a key are put in one order of time, where each probe takes the last version before it: one pass, no
    pairs. Time is cut into blocks of about ``block_rows`` writes, so a key with a third of all versions is many windows; into each block goes the key's
    last version from the blocks before it. A null key or ``at`` finds nothing.
    """
    rest = [c for c in log.columns if c not in key]
    span = log.agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    blocks = max(1, -(-span["n"] // block_rows))
    width = max(1, -(-((span["b"] or 0) - (span["a"] or 0) + 1) // blocks))
    block = lambda t: F.least(F.greatest(F.floor((t - F.lit(span["a"] or 0)) / width), F.lit(0)), F.lit(blocks - 1)).cast("long").alias("__block")
    time = F.col(at).cast("long")
    versions = log.where(" and ".join(f"`{k}` is not null" for k in key)).select(*key, F.col("seq").alias("__t"), block(F.col("seq")), F.struct(*rest).alias("__row"))
    asked = probes.select(*key, time.alias("__t"), block(time), F.struct(*probes.columns).alias("__probe"))
    if blocks > 1:  # numbers only: a row for each key and block
        places = versions.select(*key, "__block", F.col("__t").alias("seq")).unionByName(asked.select(*key, "__block", F.lit(None).cast("long").alias("seq")))
        newest = places.groupBy(*key, "__block").agg(F.max("seq").alias("seq"))
        before = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        carried = newest.select("__block", F.max("seq").over(before).alias("seq")).where("seq is not null")
        versions = versions.unionByName(log.join(carried, "seq").select(*key, F.col("seq").alias("__t"), "__block", F.struct(*rest).alias("__row")))
    both = versions.unionByName(asked, allowMissingColumns=True)
    so_far = Window.partitionBy(*key, "__block").orderBy("__t", F.col("__probe").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__row", F.last("__row", True).over(so_far)).where("__probe is not null")
    row = F.when(F.col("__t").isNotNull(), F.col("__row"))
    return found.select(*[F.col(f"__probe.{c}").alias(c) for c in probes.columns], *[row[c].alias(c) for c in rest])
