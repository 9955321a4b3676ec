"""Consecutive numbers without bringing all rows to one task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def _split(df: DataFrame) -> DataFrame:
    """``df`` with the part and the row in it of each row."""
    placed = df.withColumn("__id", F.monotonically_increasing_id())
    return placed.withColumn("__part", F.shiftright("__id", _ROW_BITS)).withColumn("__row", F.col("__id").bitwiseAND((1 << _ROW_BITS) - 1)).drop("__id")


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... in ``order``, which should leave no ties.

    Rows are dealt to ranges and sorted there; a range's first number is the sum of the counts before it (one row per range,
    so the one window over all of them is small). The ranges are kept, because dealing the rows out again would sample
    other bounds; a lost part is made again within the same bounds.
    """
    keys = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    names = [f"__o{i}" for i in range(len(order))]
    placed = df.select("*", *keys)
    ranged = placed.repartitionByRange(parts, *names) if parts else placed.repartitionByRange(*names)  # else small ranges are put together
    ranged = ranged.sortWithinPartitions(*names)
    ranged = _split(ranged.select(*[F.col(f"`{c}`") for c in df.columns])).persist(StorageLevel.MEMORY_AND_DISK)
    sums = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("__part", before.cast("long").alias("__base"))
    out = ranged.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__row") + start)
    return out.drop("__part", "__row", "__base")


@contextmanager
def in_place(df: DataFrame, name: str, start: int = 1) -> Iterator[tuple[DataFrame, DataFrame, int]]:
    """``df`` with ``name``: start, start + 1, ... in the order that its rows have; the rows as they are kept; and how many there are.

    No row moves: a part's first number is the sum of the counts before it (one number per part at the driver). The rows are kept, so that
    counts and numbers tell of the same parts, and let go at the end of the block, when what needed them is written.
    """
    kept = _split(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = sorted((r["__part"], r["n"]) for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect())
        bases, at = [], start
        for part, n in counts:
            bases.append((part, at))
            at += n
        base = df.sparkSession.createDataFrame(bases, "__part long, __base long")
        out = kept.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__row")).drop("__part", "__row", "__base")
        yield out, kept, at - start
    finally:
        kept.unpersist()
