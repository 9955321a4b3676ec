"""Scans in key order, point and batched lookups, indexes, counts, and large values kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.ordering import at_least, before, key_order
from .state import META, rows_at

BLOB_BYTES = 16384


def in_range(rows: DataFrame, key: list[str], start: tuple | None = None, end: tuple | None = None, natural: bool = False) -> DataFrame:
    """Rows with start <= key < end in key order's sense; None is unbounded."""
    if start is not None:
        rows = rows.where(at_least(rows.schema, key, start, natural))
    if end is not None:
        rows = rows.where(before(rows.schema, key, end, natural))
    return rows


def scan(rows: DataFrame, key: list[str], start: tuple | None = None, end: tuple | None = None, natural: bool = False) -> DataFrame:
    """Rows of a key range in key order."""
    return in_range(rows, key, start, end, natural).orderBy(*key_order(rows.schema, key, natural))


def with_position(rows: DataFrame, key: list[str], name: str = "pos", natural: bool = False) -> DataFrame:
    """Rows with their place in key order, from 1."""
    return numbered(rows, key_order(rows.schema, key, natural), name)


def first_rows(rows: DataFrame, key: list[str], n: int, natural: bool = False) -> DataFrame:
    """The first ``n`` rows in key order: each task keeps n, none sorts more."""
    return rows.orderBy(*key_order(rows.schema, key, natural)).limit(n)


def lookup(rows: DataFrame, key: list[str], probes: DataFrame) -> DataFrame:
    """The rows of many keys at once; the join's way is chosen by the sizes of both sides."""
    return rows.join(probes.select(*key).distinct(), key)


def lookup_each(rows: DataFrame, key: list[str], probes: DataFrame) -> DataFrame:
    """Each probe with the row of its key; probes without one have none."""
    return probes.join(rows, key)


def count_found(rows: DataFrame, key: list[str], probes: DataFrame) -> DataFrame:
    """One row: how many probes there are, and how many have a row. No value is read."""
    there = rows.select(*key).distinct().withColumn("__found", F.lit(1))
    return probes.select(*key).join(there, key, "left").agg(F.count("*").alias("probes"), F.count("__found").alias("found"))


def any_row(rows: DataFrame, keep: Column, name: str) -> DataFrame:
    """One row: whether any row fits. The condition reaches the scan, and a task stops at its first match."""
    return rows.where(keep).select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias(name))


def keys(rows: DataFrame, key: list[str], start: tuple | None = None, end: tuple | None = None, natural: bool = False) -> DataFrame:
    """The keys of a range in key order; no value is read."""
    return scan(rows.select(*key), key, start, end, natural)


def find_by(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The row with a value in a unique index column (null finds null); of several the one written last."""
    found = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return found.agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).where("r is not null").select("r.*")


def find_all_by(rows: DataFrame, column: str, value: object) -> DataFrame:
    """All rows with a value in an index column."""
    return rows.where(F.col(column).eqNullSafe(F.lit(value)))


def unique_index(rows: DataFrame, column: str, key: list[str]) -> DataFrame:
    """(column, key...): each value and the row that was written last with it."""
    return rows_at(rows, rows.groupBy(column).agg(F.max("seq").alias("seq")).select("seq")).select(column, *key)


def split_blobs(rows: DataFrame, column: str, blob_id: str, threshold: int = BLOB_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows with large values replaced by null and a reference (<column>_blob: id, bytes, crc), and the values (blob_id, value)."""
    large = F.octet_length(column) >= threshold
    reference = F.when(large, F.struct(F.col(blob_id).alias("blob_id"), F.octet_length(column).cast("long").alias("bytes"), F.crc32(F.col(column).cast("binary")).alias("crc")))
    inline = rows.withColumn(f"{column}_blob", reference).withColumn(column, F.when(~large, F.col(column)))
    return inline, rows.where(large).select(F.col(blob_id).alias("blob_id"), F.col(column).alias("value"))


def join_blobs(inline: DataFrame, blobs: DataFrame, column: str) -> DataFrame:
    """The reverse of ``split_blobs``; a value whose checksum differs is dropped with its row."""
    reference = f"{column}_blob"
    joined = inline.join(blobs.withColumnRenamed("blob_id", "__id"), F.col(f"{reference}.blob_id") == F.col("__id"), "left")
    sound = F.col(reference).isNull() | (F.crc32(F.col("value").cast("binary")) == F.col(f"{reference}.crc"))
    return joined.where(sound).withColumn(column, F.coalesce(column, "value")).drop(reference, "__id", "value")


def blob_orphans(blobs: DataFrame, inline: DataFrame, column: str) -> DataFrame:
    """Large values that no row refers to."""
    used = inline.select(F.col(f"{column}_blob.blob_id").alias("blob_id")).where("blob_id is not null")
    return blobs.join(used, "blob_id", "left_anti")


def upsert_rows(rows: DataFrame, key: list[str], probes: DataFrame, assign: dict[str, Column]) -> DataFrame:
    """For each probed key its row after the assignments; a key without a row starts with nulls. Columns in ``assign`` see the old values."""
    values = [c for c in rows.columns if c not in (*META, *key)]
    joined = probes.select(*key).distinct().join(rows.select(*key, *values), key, "left")
    return joined.select(*key, *[assign[c].alias(c) if c in assign else F.col(c) for c in values])
