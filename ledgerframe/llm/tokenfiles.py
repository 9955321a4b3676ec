"""Token ids as Parquet: list columns with dictionary encoding beside delta-encoded metadata, in ascending document order.

A set of token files is a folder with ``data`` (part, doc_id, n_tokens, local_start, tokens), one file per range of ids, and ``parts`` (part, base): the ids
before each file. Ids are dictionary-encoded (a vocabulary of 2**16 takes two bytes an id at most), metadata columns are
delta-encoded (Parquet's second data page version), row groups and pages are bounded and have column and offset indexes, so a
read by doc_id or of metadata alone touches few pages.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fixed_path, partitions_for, slices, text_bytes
from .fingerprints import words

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
PART_BYTES, GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 64 << 20, 32 << 20, 64 << 10, 2000
#: Slots of the table of words, ids that are remembered, words that are encoded together; longer words are not remembered.
SLOT_BITS, POOL_IDS, TOGETHER, LONGEST = 21, 8_000_000, 200, 64
_state: dict[tuple[str, int], _Encoder] = {}


class _Encoder:
    """The tokenizer, and the ids of words met before in one pool, found by the words' fingerprints.

    White space (0x09 to 0x0D and 0x20) is where the tokenizer's rules never join characters, so words between are encoded apart. Each
    word has two slots of a table: the first word to come keeps the first (frequent words come early), the last one has the second. The
    pool and all that points to it start anew when it is full.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << SLOT_BITS, np.uint64)
        self.place = np.zeros(1 << SLOT_BITS, np.int64)  # where in the pool, and how many ids (its low 32 bits)
        self.pool = np.array([self.end_id], np.int32)  # its first id is the end id
        self.used = 1

    def _library(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Places in the pool of the library's ids of words, given by their bytes.

        Words are encoded many together, with a space between; a word's ids are those whose characters lie in it.
        """
        stop = np.cumsum(length + 1)
        joined = data[np.minimum(np.repeat(start - stop + length + 1, length + 1) + np.arange(stop[-1]), len(data) - 1)]
        joined[stop - 1] = 0x20
        begin = stop - length - 1
        chars = np.cumsum((joined & 0xC0) != 0x80)  # characters up to each byte
        groups = range(0, len(start), TOGETHER)
        texts = [joined[begin[g] : stop[min(g + TOGETHER, len(start)) - 1]].tobytes().decode() for g in groups]
        ids, counts = [], []
        for g, encoded in zip(groups, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            own = chars[begin[g : g + TOGETHER]] - 1
            at = np.array([x for x, _ in encoded.offsets], np.int64)
            cut = np.append(np.searchsorted(at, own - (chars[begin[g]] - 1)), len(at))
            ids.append(np.array(encoded.ids, np.int32))
            counts.append(np.diff(cut))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        return at << 32 | counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with the end id behind it, and how many each text has."""
        if self.used > POOL_IDS:
            self.clear()
        w = words(column, fold=False)
        length = w.end - w.start
        near, far = (w.hash >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (w.hash & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        slot = np.where(self.key[near] == w.hash, near, far)
        place = self.place[slot]
        long = length > LONGEST
        miss = np.flatnonzero((self.key[slot] != w.hash) & ~long)
        if len(miss):
            one, first, which = np.unique(w.hash[miss], return_index=True, return_inverse=True)
            first = miss[first]
            found = self._library(w.data, w.start[first], length[first])
            place[miss] = found[which]
            near, far = near[first], far[first]
            free = self.key[near] == 0
            slot = np.where(free, near, far)
            self.key[slot], self.place[slot] = one, found  # of words with one slot the last stays
        alone = np.flatnonzero(long)
        for i in alone.tolist():  # each for itself: a long word is not told by its fingerprint
            place[i] = self._library(w.data, w.start[i : i + 1], length[i : i + 1])[0]
        ends = w.first[1:]
        place = np.insert(place, ends, 1)  # behind each text the end id: one id at 0
        at, count = place >> 32, place & 0xFFFFFFFF
        stop = np.cumsum(count)
        ids = self.pool[np.repeat(at - stop + count, count) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.diff(stop[ends + np.arange(len(ends))], prepend=0)


def _encoder(path: str, end_id: int) -> _Encoder:
    """One for each Python worker."""
    if (path, end_id) not in _state:
        _state[path, end_id] = _Encoder(path, end_id)
    return _state[path, end_id]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches, 1):
            ids, counts = _encoder(path, end_id).encode(batch.column(1))
            begin = start + np.cumsum(counts) - counts
            start += len(ids)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), part, np.int32)), batch.column(0), pa.array(counts), pa.array(begin), tokens], ["part", "doc_id", "n_tokens", "local_start", "tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> None:
    """Encodes every text and writes the ids to ``path`` in ascending doc_id order (equal ids by text, null ids first).

    One shuffle: rows are dealt to ranges of ids, each range a file. Null texts are empty (an end id alone), very long texts are encoded whole. Rows that
    repeat stay. Other columns, whatever their names, are ignored. An empty table gives a set without documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = partitions_for(text_bytes(rows), part_bytes, docs.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ranged.mapInArrow(_encode(fixed_path(TOKENIZER, tokenizer), end_id), "part int, doc_id long, n_tokens long, local_start long, tokens array<int>")
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.enable.dictionary#local_start": "false",
    }
    encoded.write.mode("overwrite").options(**{k: str(v) for k, v in options.items()}).parquet(f"{path}/data")
    sums = docs.sparkSession.read.parquet(f"{path}/data").groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base")).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without reading any ids; start counts the ids of all documents before."""
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of all documents, or of those with low <= doc_id < high (row groups and pages beyond are skipped)."""
    rows = spark.read.parquet(f"{path}/data")
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") < high)
    parts = spark.read.parquet(f"{path}/parts")  # a row per file: small at any size
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column(3)
        values, offsets = np.asarray(tokens.values).astype("<u4"), np.asarray(tokens.offsets)
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows of ``read_tokens``."""
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
