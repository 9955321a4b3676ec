"""A table's change log as Parquet batches under a manifest."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbering import in_place
from ..functions.ordering import key_order, key_place
from ..operators.state import META, compact
from .manifest import Batch, Conflict, Manifest, Version

#: Compacted files are cut at about so many bytes; level 1 may hold LEVEL_BYTES, each level below it ten times as much.
FILE_BYTES = LEVEL_BYTES = 64 << 20
LEVEL_FACTOR = 10


def log_schema(schema: T.StructType) -> T.StructType:
    """The columns of the log of a table: what each write has, then the table's own columns, nullable."""
    meta = [T.StructField("seq", T.LongType()), T.StructField("node_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("op", T.StringType()), T.StructField("origin", T.StringType())]
    meta.append(T.StructField("large", T.ArrayType(T.StringType())))  # the columns whose values are kept apart
    return T.StructType([*meta, *(T.StructField(f.name, f.dataType, True) for f in schema.fields)])


#: Large values kept apart: the write, its column, the value (text or bytes) and its checksum.
BLOBS = "seq long, column string, text string, data binary, crc long"


class ChangeLog:
    """Writes append numbered rows; reads see the newest committed version. ``on_commit`` functions get each version after its commit.

    With ``blob_bytes`` text and binary values of so many bytes or more go to files of their own, so that merges and scans do not carry them;
    ``whole`` puts them back.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: list[str], node_id: int = 0, natural: bool = False, blob_bytes: int | None = None) -> None:
        self.spark, self.root, self.key, self.node_id, self.natural = spark, root.rstrip("/"), key, node_id, natural
        self.schema = log_schema(schema)
        self.blob_bytes = blob_bytes
        self.heavy = [f for f in schema.fields if f.name not in key and isinstance(f.dataType, T.StringType | T.BinaryType)]
        self.manifest = Manifest(spark, self.root)
        self.on_commit: list[Callable[[Version], None]] = []

    def _place(self, values: tuple | list | None) -> tuple | None:
        return key_place(values, self.schema, self.key, self.natural)

    def overlapping(self, batches: list[Batch] | tuple[Batch, ...], start: tuple | None = None, end: tuple | None = None, last: tuple | None = None) -> list[Batch]:
        """The batches that may have keys with start <= key < end (or <= last); those whose ends are not known are among them."""
        a, b, c = self._place(start), self._place(end), self._place(last)
        found = []
        for x in batches:
            lo, hi = self._place(x.first), self._place(x.last)
            if lo is None or hi is None or not (a is not None and hi < a or b is not None and lo >= b or c is not None and lo > c):
                found.append(x)
        return found

    def read(self, level: int | None = None, **bounds: tuple | None) -> DataFrame:
        """The rows that tell the current state: compacted batches and the writes since. Batches without keys in the ``bounds`` of ``overlapping`` are not opened."""
        return self.rows_of(self.overlapping([b for b in self.manifest.current().batches if level is None or b.level == level], **bounds))

    def read_all(self) -> DataFrame:
        """All writes that are kept, those before a compaction too."""
        return self.rows_of(self.history_of(self.manifest.current()))

    @staticmethod
    def history_of(version: Version) -> list[Batch]:
        """The batches that have every kept write of a version once."""
        return [*version.past, *ChangeLog._new(version)]

    @staticmethod
    def _new(version: Version) -> list[Batch]:
        """Batches whose rows ``past`` does not have."""
        return [b for b in version.batches if not version.past or not b.level]

    def rows_of(self, batches: list[Batch]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{b.path}" for b in batches))

    def whole(self, rows: DataFrame) -> DataFrame:
        """Rows of the log (with ``seq`` and ``large``) with their large values; a row with a value whose checksum differs is left out."""
        version = self.manifest.current()
        paths = sorted({f"{self.root}/{x}" for b in (*version.batches, *version.past) for x in b.blobs})
        columns = [f for f in self.heavy if f.name in rows.columns]
        if not paths or not columns:
            return rows
        blobs = self.spark.read.schema(BLOBS).parquet(*paths).dropDuplicates(["seq", "column"])
        for f in columns:
            own = blobs.where(F.col("column") == f.name).select(F.col("seq").alias("__seq"), F.col("text" if isinstance(f.dataType, T.StringType) else "data").alias("__value"), F.col("crc").alias("__crc"))
            joined = rows.join(own, F.array_contains("large", f.name) & (F.col("seq") == F.col("__seq")), "left")
            apart = F.coalesce(F.array_contains("large", f.name), F.lit(False))
            sound = ~apart | F.coalesce(F.crc32(F.col("__value").cast("binary")) == F.col("__crc"), F.lit(False))
            rows = joined.where(sound).withColumn(f.name, F.when(apart, F.col("__value")).otherwise(F.col(f.name))).drop("__seq", "__value", "__crc")
        return rows

    def _apart(self, rows: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
        """Rows to write without their large values, and the folder that has these."""
        if self.blob_bytes is None or not self.heavy:
            return rows.withColumn("large", F.lit(None).cast("array<string>")), ()
        big = {f.name: F.coalesce(F.octet_length(f.name) >= self.blob_bytes, F.lit(False)) for f in self.heavy}
        values = []
        for f in self.heavy:
            text = F.col(f.name) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("string")
            data = F.col(f.name) if isinstance(f.dataType, T.BinaryType) else F.lit(None).cast("binary")
            value = F.struct(F.lit(f.name).alias("column"), text.alias("text"), data.alias("data"), F.crc32(F.col(f.name).cast("binary")).alias("crc"))
            values.append(F.when(big[f.name], value))
        path = f"blobs/{uuid.uuid4().hex}"
        apart = rows.select("seq", F.explode(F.array_compact(F.array(*values))).alias("b")).select("seq", "b.*")
        apart.write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        if self.spark.read.schema(BLOBS).parquet(f"{self.root}/{path}").isEmpty():
            self.manifest.files.delete(path)
            path = ""
        large = F.array_compact(F.array(*(F.when(big[name], F.lit(name)) for name in big)))
        slim = rows.withColumns({"large": F.when(F.size(large) > 0, large), **{name: F.when(~big[name], F.col(name)) for name in big}})
        return slim, (path,) if path else ()

    @staticmethod
    def _blobs_of(batches: list[Batch] | tuple[Batch, ...]) -> tuple[str, ...]:
        return tuple(sorted({x for b in batches for x in b.blobs}))

    def _ends(self) -> list[Column]:
        """Aggregates for the first and the last key."""
        key = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(key_order(self.schema, self.key, self.natural))), *self.key)
        return [F.min(key).alias("first"), F.max(key).alias("last")]

    def _key_of(self, row: Row | None) -> list | None:
        """An end's key for the manifest, if its kinds can be told there."""
        values = None if row is None else [row[k] for k in self.key]
        plain = values is not None and self._place(values) is not None and not any(isinstance(v, float) and not math.isfinite(v) for v in values)
        return values if plain else None

    def _batch(self, path: str, level: int, n: int, least: int, most: int, first: Row | None, last: Row | None, blobs: tuple[str, ...] = ()) -> Batch:
        return Batch(path, level, n, least, most, *self.manifest.files.size(path), self._key_of(first), self._key_of(last), blobs)

    def _save(self, rows: DataFrame, level: int, folder: str = "batches") -> str:
        path = f"{folder}/{uuid.uuid4().hex}"
        options = {"compression": "zstd"} | {f"parquet.bloom.filter.enabled#{k}": "true" for k in self.key if level}
        rows.select(*self.schema.fieldNames()).write.options(**options).parquet(f"{self.root}/{path}")
        return path

    def _write(self, rows: DataFrame, level: int, folder: str = "batches", blobs: tuple[str, ...] = ()) -> Batch | None:
        """Writes rows that have their numbers, and refer to large values in ``blobs``; what the manifest needs of them is told from the file's own number and key columns."""
        path = self._save(rows, level, folder)
        found = self.spark.read.schema(self.schema).parquet(f"{self.root}/{path}").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"), *self._ends()).first()
        if not found["n"]:
            self.manifest.files.delete(path)
            return None
        return self._batch(path, level, found["n"], found["a"], found["b"], found["first"], found["last"], blobs)

    def append(self, rows: DataFrame, op: str, origin: str = "user", ends: tuple[int, Row | None, Row | None] | None = None) -> int:
        """Adds one write per row, numbered in the order that the rows have; returns the last sequence number.

        ``ends`` (how many rows, first and last key) is given with rows that are numbered from 0 by a column ``__i``.
        """
        version = self.manifest.current()
        names = [f.name for f in self.schema.fields[len(META) :]]
        lacking = [F.lit(None).cast(self.schema[n].dataType).alias(n) for n in names if n not in rows.columns]

        def writes(numbered: DataFrame) -> DataFrame:
            return numbered.select("seq", F.lit(self.node_id).cast("long").alias("node_id"), F.current_timestamp().alias("ts"), F.lit(op).alias("op") if op else F.col("op"), F.lit(origin).alias("origin"), *[F.col(n).cast(self.schema[n].dataType) for n in names])

        def save(numbered: DataFrame) -> tuple[str, tuple[str, ...]]:
            slim, blobs = self._apart(writes(numbered))
            return self._save(slim, 0), blobs

        start, path, blobs = version.next_seq, "", ()
        if ends:
            n, first, last = ends
            if n:
                path, blobs = save(rows.select("*", *lacking).withColumn("seq", F.col("__i") + start))
        else:
            with in_place(rows.select("*", *lacking), "seq", start) as (numbered, kept, n):
                if n:
                    path, blobs = save(numbered)
                    first, last = kept.agg(*self._ends()).first()
        return self._commit(self._batch(path, 0, n, start, start + n - 1, first, last, blobs) if n else None, version)

    def replicate(self, rows: DataFrame) -> int:
        """Adds rows that have their sequence numbers already; those not above the last one are known and left out."""
        version = self.manifest.current()
        rows = rows.where(F.col("seq") >= version.next_seq).dropDuplicates(["seq"]).withColumn("origin", F.lit("replica"))
        slim, blobs = self._apart(rows)
        return self._commit(self._write(slim, 0, blobs=blobs), version)

    def commit(self, after: Version, add: list[Batch], *rest: object, **more: object) -> Version:
        """A new version; if another writer was first, the batches that were to be added go."""
        try:
            version = self.manifest.commit(after, add, *rest, **more)
        except Conflict:
            kept = {x for b in (*after.batches, *after.past) for x in b.blobs}
            for b in add:
                for path in (b.path, *(x for x in b.blobs if x not in kept)):
                    self.manifest.files.delete(path)
            raise
        for tell in self.on_commit:
            tell(version)
        return version

    def _commit(self, batch: Batch | None, version: Version) -> int:
        if batch is None:
            return version.next_seq - 1
        self.commit(version, [batch], next_seq=batch.max_seq + 1)
        return batch.max_seq

    def replace(self, rows: DataFrame) -> None:
        """Puts ``rows`` of this log in place of all batches (pruning); their large values stay where they are."""
        version = self.manifest.current()
        batch = self._write(rows, 0, blobs=self._blobs_of((*version.batches, *version.past)))
        self.commit(version, [batch] if batch else [], {b.path for b in version.batches}, past=[])

    def renew(self, rows: DataFrame, next_seq: int) -> None:
        """Puts whole rows of another log in place of all batches (a replica made anew)."""
        version = self.manifest.current()
        slim, blobs = self._apart(rows)
        batch = self._write(slim, 0, blobs=blobs)
        self.commit(version, [batch] if batch else [], {b.path for b in version.batches}, next_seq=next_seq, past=[])

    def _keep(self, version: Version, gone: list[Batch], history: bool) -> list[Batch]:
        """What goes to ``past`` when level-0 batches are compacted."""
        if not history:
            return []
        new = [b for b in self._new(version) if b in gone or b.level]
        moved = self._write(self.rows_of(new), 0, "past", self._blobs_of(new)) if new else None
        return [*version.past, *([moved] if moved else [])]

    def compacted(self, files: int | None = None, history: bool = False, file_bytes: int = FILE_BYTES) -> None:
        """Merges all batches into one base, clustered by key, without older versions and tombstones, in so many files or files of about ``file_bytes``.

        With ``history`` the writes go on to ``past``, else they go.
        """
        version = self.manifest.current()
        if version.batches:
            files = files or max(1, -(-sum(b.bytes for b in version.batches) // file_bytes))
            base = compact([self.read()], self.key, bottom=True).repartitionByRange(files, *self.key).sortWithinPartitions(*self.key)
            batch = self._write(base, 1, blobs=self._blobs_of(version.batches))
            past = self._keep(version, list(version.batches), history)
            self.commit(version, [batch] if batch else [], {b.path for b in version.batches}, past=past)

    def compact_level(self, level: int, history: bool = False, file_bytes: int = FILE_BYTES) -> None:
        """Merges level 0 (all of it), or the oldest batch of a level above, with the batches of the next level that have keys between its ends.

        Tombstones stay unless no level below has such keys.
        """
        version = self.manifest.current()
        mine = sorted((b for b in version.batches if b.level == level), key=lambda b: b.max_seq)
        mine = mine if level == 0 else mine[:1]
        if not mine:
            return
        first, last = self._span(mine)
        under = self.overlapping([b for b in version.batches if b.level == level + 1], start=first, last=last)
        merged = [*mine, *under]
        first, last = self._span(merged)
        below = self.overlapping([b for b in version.batches if b.level > level + 1], start=first, last=last)
        rows = compact([self.rows_of(merged)], self.key, bottom=not below)
        files = max(1, -(-sum(b.bytes for b in merged) // file_bytes))
        batch = self._write(rows.repartitionByRange(files, *self.key).sortWithinPartitions(*self.key), level + 1, blobs=self._blobs_of(merged))
        past = self._keep(version, merged, history) if level == 0 else None
        self.commit(version, [batch] if batch else [], {b.path for b in merged}, past=past)

    def _span(self, batches: list[Batch]) -> tuple[tuple | None, tuple | None]:
        """The first and last key of batches; None where one is not known."""
        if any(b.first is None or b.last is None for b in batches):
            return None, None
        return tuple(min((b.first for b in batches), key=self._place)), tuple(max((b.last for b in batches), key=self._place))

    def tidy(self, most: int, history: bool, level_bytes: int = LEVEL_BYTES, file_bytes: int = FILE_BYTES) -> None:
        """Compacts level 0 once it has ``most`` batches, then each level that holds more bytes than it may."""
        if sum(b.level == 0 for b in self.manifest.current().batches) < most:
            return
        self.compact_level(0, history, file_bytes)
        level = 1
        while any(b.level >= level for b in self.manifest.current().batches):
            batches = self.manifest.current().batches
            if sum(b.bytes for b in batches if b.level == level) > level_bytes * LEVEL_FACTOR ** (level - 1):
                self.compact_level(level, history, file_bytes)
            level += 1

    def files(self, **bounds: tuple | None) -> DataFrame:
        """The batches (those that a read within ``bounds`` opens)."""
        rows = [(b.path, b.level, b.rows, b.min_seq, b.max_seq, b.files, b.bytes) for b in self.overlapping(self.manifest.current().batches, **bounds)]
        return self.spark.createDataFrame(rows, "path string, level int, rows long, min_seq long, max_seq long, files int, bytes long")
