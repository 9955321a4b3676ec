"""Repeated passages by a sparse suffix array over words.

1. Kept suffixes begin at minimisers: of every ``min_words - seed + 1`` seeds in a row (a seed is ``seed`` words), those with the
   smallest fingerprint. Equal passages of ``min_words`` words hold equal seeds, so they keep the same suffixes, about one word in twenty.
2. The kept suffixes are sorted by the fingerprints of their first ``seed`` words and compared with their neighbours. One whose neighbours
   all begin otherwise has no match in another document and goes.
3. The others are extended left and right word by word: to each window of ``min_words`` words that has the suffix's seed as its minimiser.
   These are sorted and compared with their neighbours in the same way. Windows that match and touch make one span: a maximal match.
   Extending sorted neighbours alone would miss passages: a suffix with more words in common on the right, but none on the left, may sort between two equal ones.

A sort deals rows to ranges by key, document and place, so a passage in a third of all documents is a run over many tasks. Runs inside a range
are told there; of those that reach its first or last row smallest and largest rows are aggregated: two keys for each range of up to
``PART_ROWS`` rows, few enough to be sent to all tasks at any size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_rows, fresh, map_rows, slices
from .fingerprints import inside, ngrams, words

MIN_WORDS, SEED = 50, 10
#: Rows that one task sorts and compares (32 bytes each).
PART_ROWS = 2_000_000
_DOC = ("doc_id", "tag")

def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` values in a row, by one pass from the left and one from the right of each block."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = np.concatenate([x, np.full(-len(x) % width, x[-1], x.dtype)]).reshape(-1, width)
    left = pick.accumulate(blocks, axis=1).ravel()
    right = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(right[:n], left[width - 1 : width - 1 + n])


def _least(hashes: np.ndarray, first: np.ndarray, min_words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds' fingerprints, and for each window of ``min_words`` words that of its smallest seed (0: it crosses texts)."""
    grams = ngrams(hashes, seed)
    grams |= np.uint64(1)
    least = _sliding(grams, min_words - seed + 1, np.minimum)
    least = least * inside(first, min_words)[: len(least)]
    return grams, least


def _suffixes(min_words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            w = words(batch.column(2))
            grams, least = _least(w.hash, w.first, min_words, seed)
            if not len(least):
                continue
            # a seed is kept if it is the smallest of a window that it lies in
            side = np.zeros(min_words - seed, np.uint64)
            at = np.flatnonzero(_sliding(np.concatenate([side, least, side]), min_words - seed + 1, np.maximum)[: len(grams)] == grams)
            doc = np.searchsorted(w.first, at, "right") - 1
            pairs = np.unique(np.stack([doc.astype(np.uint64), grams[at]]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
            which = pa.array(pairs[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), batch.column(0).take(which), batch.column(1).take(which), pa.array(np.zeros(len(which), np.int64))], ["key", *_DOC, "place"])

    return run


def _compare(within: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (key, doc_id, tag, place) of one range, each compared with the one before it: those whose key another document has (with ``within``: or another place).

        All rows of the range's first key, and of its last one if nothing differs there, are ``edge``: other ranges may have more of them. Of a last
        key with differing rows, which are told here, the smallest row comes once more as ``mark``. Only rows that wait for a differing one are
        held from batch to batch: those of one document at most.
        """
        held = [np.zeros(0, np.int64)] * 4  # the first row of the last key, and the others that wait
        told = False  # the last key has differing rows: all that came are out
        opening = True  # the last key is also the range's first

        def out(rows: list[np.ndarray], first: np.ndarray, edge: np.ndarray | bool, mark: bool = False) -> pa.RecordBatch:
            _, doc, tag, _ = rows
            n = len(doc)
            own = (doc == doc[first]) & (tag == tag[first])
            keep = edge if isinstance(edge, np.ndarray) else np.full(n, edge)
            return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(doc[first]), pa.array(own), pa.array(keep), pa.array(np.full(n, mark))], ["key", *_DOC, "place", "source", "own", "edge", "mark"])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting = len(held[0])
            rows = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns, strict=True)]
            key, doc, tag, place = rows
            n = len(key)
            new = np.ones(n, bool)
            new[1:] = key[1:] != key[:-1]
            begin = np.flatnonzero(new)
            other = np.zeros(n, bool)
            other[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (within & (place[1:] != place[:-1]))
            other[begin] = False
            several = np.logical_or.reduceat(other, begin)
            several[0] |= told
            length = np.diff(np.append(begin, n))
            edge = np.zeros(len(begin), bool)
            edge[0] = opening
            fresh_ = np.ones(n, bool)
            if told:
                fresh_[:waiting] = False
            ready = several | edge
            ready[-1] = several[-1]  # more rows of it may come
            give = np.flatnonzero(np.repeat(ready, length) & fresh_)
            first = np.repeat(begin, length)
            if len(give):
                found = out(rows, first, np.repeat(edge, length))
                yield found.take(pa.array(give))
            last, told = int(begin[-1]), bool(several[-1])
            opening = opening and len(begin) == 1
            held = [x[last : last + 1] if told else x[last:] for x in rows]
        if len(held[0]) and not (told and opening):
            yield out(held, np.zeros(len(held[0]), np.int64), not told, told)

    return run


def _matches(rows: DataFrame, scratch: Scratch, name: str, within: bool) -> DataFrame:
    """Rows (key, doc_id, tag, place) whose key stands in another document too (with ``within``: or at another place), with ``source``, the smallest document of the key, and ``own``: it is the row's."""
    order = ["key", *_DOC, "place"]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    ranged = rows.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = scratch.write(ranged.mapInArrow(_compare(within), "key long, doc_id long, tag long, place long, source long, own boolean, edge boolean, mark boolean"), name)
    edges = found.where("edge or mark").groupBy("key").agg(F.min(F.struct(*_DOC)).alias("least"), F.max(F.struct(*_DOC)).alias("most"), F.min("place").alias("p"), F.max("place").alias("q"))
    differ = (F.col("least") != F.col("most")) | (F.lit(within) & (F.col("p") != F.col("q")))
    edges = scratch.write(edges.where(differ).select("key", "least"), f"{name}-edges")  # two keys a range at most
    joined = found.join(F.broadcast(edges), "key", "left").where("not mark and (not edge or least is not null)")
    own = F.when(F.col("edge"), F.struct(*_DOC) == F.col("least")).otherwise(F.col("own"))
    return joined.select(*order, F.coalesce("least.doc_id", "source").alias("source"), own.alias("own"))


def _windows(min_words: int, seed: int, within: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns doc_id, tag, text, seeds: a row for each window whose smallest seed is among ``seeds``, and (key null) for others that the same text has twice."""
        for batch in slices(batches, 2):
            w = words(batch.column(2))
            _, least = _least(w.hash, w.first, min_words, seed)
            if not len(least):
                continue
            live = np.zeros(len(least), bool)
            here = np.zeros(len(least), bool)
            back = np.zeros(len(least), np.int64)
            prints = ngrams(w.hash, min_words)
            seeds = batch.column(3)
            for d in range(batch.num_rows):
                a, b = int(w.first[d]), int(w.first[d + 1]) - min_words + 1
                if b > a:
                    if seeds[d].is_valid:
                        live[a:b] = np.isin(least[a:b], np.asarray(seeds[d].values).view(np.uint64))
                    if within:
                        _, at, same, count = np.unique(prints[a:b], return_index=True, return_inverse=True, return_counts=True)
                        back[a:b] = np.arange(b - a) - at[same]
                        here[a:b] = count[same] > 1
            at = np.flatnonzero(live | here)
            doc = np.searchsorted(w.first, at, "right") - 1
            place = ((at - w.first[doc]) << 32) | back[at]
            which = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(prints[at].view(np.int64), mask=~live[at]), batch.column(0).take(which), batch.column(1).take(which), pa.array(place)], ["key", *_DOC, "place"])

    return run


def _spans(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns doc_id, tag, places, sources, owns: the maximal spans of each document."""
        for batch in batches:
            out: list[tuple] = []
            for doc, tag, *lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                place, source = (np.asarray(x.values) for x in lists[:2])
                own = np.asarray(lists[2].values.cast(pa.int8())) > 0
                order = np.argsort(place, kind="stable")
                at, back, source, own = place[order] >> 32, place[order] & 0xFFFFFFFF, source[order], own[order]
                # a window that overlaps the first one like it begins where that one ends, so the kept copy stays whole
                start = np.where(own & (back > 0), np.maximum(at, at - back + min_words), at)
                for kept in (True, False):
                    mine = (own & (back == 0)) == kept
                    a, z, s = start[mine], at[mine] + min_words, source[mine]
                    if len(a):
                        order = np.argsort(a, kind="stable")
                        a, z, s = a[order], np.maximum.accumulate(z[order]), s[order]
                        cut = np.flatnonzero(a[1:] > z[:-1]) + 1  # windows that touch or overlap make one span
                        for x, y in zip([0, *cut], [*cut, len(a)], strict=True):
                            out.append((doc, tag, int(a[x]), int(z[y - 1]), kept, int(s[x:y].min())))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()), strict=True)], [*_DOC, "start_word", "end_word", "kept", "source_id"])

    return run


def _tagged(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tag, text): rows with an id; tag is a digest of the text, so that rows which repeat an id with another text are told apart."""
    text_ = F.col(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(text_).alias("tag"), text_.alias("text")).where("doc_id is not null")


def _passages(docs: DataFrame, min_words: int, seed: int, within: bool) -> DataFrame:
    """The spans of rows of ``_tagged``: (doc_id, tag, start_word, end_word, kept, source_id)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    if not docs.groupBy(*_DOC).count().where("count > 1").isEmpty():
        docs = docs.groupBy(*_DOC).agg(F.min("text").alias("text"))  # equal rows are one document
    suffixes = scratch.write(docs.mapInArrow(_suffixes(min_words, seed), "key long, doc_id long, tag long, place long"), "suffixes")
    found = _matches(suffixes, scratch, "seeds", False).groupBy(*_DOC).agg(F.collect_list("key").alias("seeds"))  # a document's own seeds: bounded by its text
    found = docs.join(found.hint("shuffle_hash"), list(_DOC), "left" if within else "inner")
    with arrow_rows(docs.sparkSession, 500):
        windows = scratch.write(found.select(*_DOC, "text", "seeds").mapInArrow(_windows(min_words, seed, within), "key long, doc_id long, tag long, place long"), "windows")
    for name in ("suffixes", "seeds", "seeds-edges"):
        scratch.drop(name)
    hits = _matches(windows.where("key is not null"), scratch, "matches", within).drop("key")
    if within:
        alone = windows.where("key is null").select(*_DOC, "place", F.col("doc_id").alias("source"), F.lit(True).alias("own"))
        hits = hits.unionByName(alone)
    hits = hits.groupBy(*_DOC).agg(*(F.collect_list(c).alias(c) for c in ("place", "source", "own")))
    return hits.mapInArrow(_spans(min_words), "doc_id long, tag long, start_word int, end_word int, kept boolean, source_id long")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """All passages of ``min_words`` words or more that occur in two documents at least; with ``within``, also those that occur twice in one.

    Words are runs of other than ASCII white space with A-Z lower-cased. Returns (doc_id, start_word, end_word, kept,
    source_id), one row per document and maximal span, words counted from 0, end excluded. kept: the document is the
    one with the smallest id that has the passage (with ``within``: and this is its first place there); source_id is that smallest id (of a
    longer span the smallest of its windows). Documents without such a passage have no row. With ``within``, a repeat that overlaps the
    kept copy counts from that copy's end only, so such a span may be shorter. Null ids are left out, null texts are empty, very long texts are
    searched whole. Rows that repeat an id with the same text count once; with another text they are documents of their own, the one with the
    smaller digest first. Other columns, whatever their names, are ignored. An empty table gives no row.
    """
    return _passages(_tagged(docs, id_col, text_col), min_words, seed, within).drop("tag")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, starts, ends, and others: the text without the words of its spans."""
    for batch in slices(batches, 0):
        w = words(batch.column(0))
        out = []
        for d, (starts, ends) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            text = batch.column(0)[d].as_py()
            if starts.is_valid and len(starts.values) and text is not None:
                base, first, raw = int(w.offsets[d]), int(w.first[d]), w.text_bytes(d)
                gone = np.zeros(int(w.first[d + 1]) - first, bool)
                for a, b in zip(starts.as_py(), ends.as_py(), strict=True):
                    gone[a:b] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                keep, at = [], 0
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    keep.append(raw[at : int(w.start[first + a]) - base])
                    at = int(w.start[first + b]) - base if b < len(gone) else len(raw)
                text = b"".join([*keep, raw[at:]]).decode()
            out.append(text)
        columns = [pa.array(out, pa.string()), *batch.columns[3:]]
        yield pa.RecordBatch.from_arrays(columns, [f"_{i}" for i in range(len(columns))])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED, within: bool = False) -> DataFrame:
    """The documents with every repeated passage cut out except in the document with its smallest id; with ``within``, there too but for its first place.

    All rows and columns stay, whatever the columns are called; n_chars follows the text where it is a column. A document that was all repeats keeps its
    row with what is left, perhaps an empty text. Nulls stay as they are. Of rows that repeat an id each is cut where its own text has repeats.
    """
    names = {x: fresh(docs.columns, x) for x in ("starts", "ends", "row_id", "row_tag")}
    spans = _passages(_tagged(docs, "doc_id", "text"), min_words, seed, within).where("not kept")
    lists = spans.groupBy(*_DOC).agg(F.collect_list("start_word"), F.collect_list("end_word")).toDF(*(names[x] for x in ("row_id", "row_tag", "starts", "ends")))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    mine = (docs["doc_id"].cast("long") == F.col(names["row_id"])) & (F.xxhash64(docs["text"]) == F.col(names["row_tag"]))
    joined = docs.join(lists.hint("shuffle_hash"), mine, "left").select("text", names["starts"], names["ends"], *others)
    cut = map_rows(joined, _cut, T.StructType([T.StructField("text", T.StringType()), *(f for f in docs.schema.fields if f.name != "text")]))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*(f"`{c}`" for c in docs.columns))


#: The same spans in DuckDB (repeats within a document too), from all windows of 50 words.
ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
o AS (SELECT doc_id, word, array_to_string(w[word + 1 : word + 50], ' ') AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS word FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS source FROM o GROUP BY h HAVING count(*) > 1),
p AS (SELECT doc_id, word, source, doc_id = source AS own, word - min(word) OVER (PARTITION BY doc_id, h) AS back FROM o JOIN f USING (h)),
q AS (SELECT doc_id, word, source, own AND back = 0 AS kept, CASE WHEN own AND back > 0 THEN greatest(word, word - back + 50) ELSE word END AS a, word + 50 AS z FROM p),
g AS (SELECT *, max(z) OVER (PARTITION BY doc_id, kept ORDER BY a, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, kept ORDER BY a, word) AS span FROM g)
SELECT doc_id, CAST(min(a) AS INTEGER) AS start_word, CAST(max(z) AS INTEGER) AS end_word, kept, min(source) AS source_id, CAST(max(z) - min(a) AS INTEGER) AS n_words FROM i GROUP BY doc_id, kept, span
"""
