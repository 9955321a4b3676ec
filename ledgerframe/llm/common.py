"""What the operators of this subpackage share: scratch tables, bounded slices of Arrow batches, input sizes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A Python worker handles about so many bytes of text at a time (one document more at most).
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one is set only where the session has none and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it the session has ``key`` set so."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of any executor.

    Once a table is written nothing reads the shuffle files behind it, so Spark removes them at the end of the write.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        """Writes ``df`` as Parquet and reads it back."""
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("overwrite").options(**{k: str(v) for k, v in options.items()}).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def arrow_rows(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Within it, plans send Python at most so many rows at once: for rows that are large in themselves."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_rows(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names (dots too): batches in and out have their columns called _0, _1, ..."""
    plain = T.StructType([T.StructField(f"_{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))).mapInArrow(run, plain).toDF(*schema.names)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids`` (one column); all their columns. One shuffle of both sides whatever their size: a hash of each part's ids meets its rows."""
    name = fresh(docs.columns, "gone")
    ids = ids.toDF(name).hint("shuffle_hash")
    return docs.join(ids, docs["doc_id"].cast("long") == ids[name], "left_anti")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in all rows, by one aggregation."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def partitions_for(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, -(-n_bytes // each))


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices whose column ``text`` holds about ``most`` bytes: batches are bounded by rows, not by bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        if pa.types.is_null(column.type):
            yield batch
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


def fixed_path(name: str, path: str | None = None) -> str:
    """A tokenizer's file: the given path, else that of the public file ``name`` in the installed collection."""
    if path:
        return path
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
