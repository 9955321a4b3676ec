"""Benchmark passages in documents: CGK embedding, repeated bit sampling, exact edit verification.

Texts and items are sequences of words (runs of letters and digits, A-Z lower-cased; other ASCII characters separate).
A document holds an item if some stretch of it turns into the item by at most ``(1 - similarity) * words`` insertions,
deletions and substitutions of words.

* Blocks. An item of more than ``BLOCK_WORDS`` words is searched by blocks of about equal length, since walks drift apart in long texts. If the
  whole has at most its share of edits, so has one of its blocks; where a block is found, the whole item is compared. Below, a
  short item is its own block.
* Windows. A block with k allowed edits falls into k + 1 pieces; each such stretch has one of them unchanged (pigeonhole), so
  block-sized windows are cut just where a piece occurs, as far before it as in the block. No match is lost by that.
* The CGK random walk reads a window and at each of 3 * n steps writes the word it stands on, then moves on or stays as a
  random bit drawn for the step and word says: edit distance becomes Hamming distance between the walks.
* Bit sampling. ``SAMPLED`` steps of a walk make one key. ``WALKS * TABLES`` keys make the chance that a window at the allowed
  distance shares none with its block small (tests measure recall against brute force).
* Where a window and a block share a key, the item is compared exactly, by the bit-parallel edit distance (Myers, 1999).

The items' tables reach all tasks as a broadcast of checked size: items are read in groups of at most ``GROUP_BYTES`` of text, one group is
held at a time, and each is one pass over the documents. A benchmark does not grow with the corpus. No row is shuffled but the few matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_rows, slices
from .fingerprints import PUNCT, _splitmix, mix, ngrams, words

SIMILARITY = 0.8
WALKS, TABLES, SAMPLED = 16, 3, 2
GROUP_BYTES = 8 << 20
#: Up to this length recall was measured as 1.0 with these walks and keys.
BLOCK_WORDS = 60


class Items:
    """The tables of one group of items: pieces to find, walks to take, keys to look up."""

    def __init__(self, ids: list[int], texts: list[str | None], similarity: float = SIMILARITY) -> None:
        self.similarity = similarity
        w = words(pa.array(texts, pa.string()), PUNCT)
        kept = [i for i in range(len(ids)) if ids[i] is not None and w.first[i + 1] > w.first[i]]
        self.ids = [ids[i] for i in kept]
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in kept]
        self.edits = [int((1 - similarity) * len(x) + 1e-9) for x in self.words]
        #: what is searched: each block's words, its item, and where it begins there
        self.blocks: list[np.ndarray] = []
        self.owner: list[tuple[int, int]] = []
        for i, x in enumerate(self.words):
            parts = -(-len(x) // BLOCK_WORDS)
            bounds = [len(x) * j // parts for j in range(parts + 1)]
            self.blocks += [x[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            self.owner += [(i, a) for a in bounds[:-1]]
        pieces: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for x in self.blocks:
            k = int((1 - similarity) * len(x) + 1e-9)
            bounds = [len(x) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                pieces[b - a][int(ngrams(x[a:b], b - a)[0])].add((a, len(x)))
        #: by length: sorted fingerprints, where each one's windows begin (before the piece) and how long they are
        self.pieces = {}
        for n, by in pieces.items():
            keys = np.array(sorted(by), np.uint64)
            rows = [sorted(by[int(x)]) for x in keys]
            bits = np.zeros(1 << 16, bool)
            bits[keys >> np.uint64(48)] = True
            self.pieces[n] = (keys, bits, np.cumsum([0, *map(len, rows)]), np.array([r for q in rows for r in q], np.int64).reshape(-1, 2))
        self.lengths = sorted({len(x) for x in self.blocks})
        self.keys = {}
        for n in self.lengths:
            own = [i for i, x in enumerate(self.blocks) if len(x) == n]
            table = walk_keys(np.stack([self.blocks[i] for i in own]))
            flat, which = table.ravel(), np.repeat(np.array(own), table.shape[1])
            order = np.argsort(flat, kind="stable")
            self.keys[n] = (flat[order], which[order])


def walk_keys(x: np.ndarray) -> np.ndarray:
    """The bit-sampling keys of windows of one length (rows of words): WALKS * TABLES for each."""
    count, n = x.shape
    steps = 3 * n
    padded = np.concatenate([x, np.zeros((count, 1), np.uint64)], axis=1)
    rows = np.arange(count)
    out = np.empty((count, WALKS * TABLES), np.uint64)
    for r in range(WALKS):
        draw = _splitmix(steps + TABLES * SAMPLED, 1000 * r + n)
        chosen: dict[int, list[int]] = defaultdict(list)
        for j, v in enumerate(draw[steps:] % np.uint64(steps * 2 // 3)):  # most walks have not run out by then
            chosen[int(v)].append(j // SAMPLED)
        keys = np.repeat(draw[steps : steps + TABLES][None], count, 0)
        at = np.zeros(count, np.int64)
        for step in range(max(chosen) + 1):
            here = padded[rows, at]
            for t in chosen.get(step, ()):
                keys[:, t] = mix(keys[:, t] ^ here)
            at += ((here * (draw[step] | np.uint64(1))) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, n, out=at)
        out[:, r * TABLES : (r + 1) * TABLES] = keys
    return out


def edit_distance(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """The fewest word edits between ``item`` and any part of ``stretch``, and where the first such part ends (Myers' bit vectors)."""
    n = len(item)
    where: dict[int, int] = defaultdict(int)
    for i, v in enumerate(item.tolist()):
        where[v] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for j, v in enumerate(stretch.tolist(), 1):
        eq = where.get(v, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (full & ~(zero | up)), up & zero
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1) & full, (less << 1) & full
        up, down = less | (full & ~(zero | more)), more & zero
        if score < best:
            best, end = score, j
    return best, end


def matches(hashes: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, distance, end word) of every confirmed pair; the nearest stretch of each, the first of equal ones."""
    cut: dict[int, list[np.ndarray]] = defaultdict(list)
    for n, (keys, bits, offsets, rows) in items.pieces.items():
        grams = ngrams(hashes, n)
        at = np.flatnonzero(np.take(bits, (grams >> np.uint64(48)).astype(np.int64)))
        slot = np.searchsorted(keys, grams[at])
        slot[slot == len(keys)] = 0
        ok = keys[slot] == grams[at]
        at, slot = at[ok], slot[ok]
        doc = np.searchsorted(first, at, "right") - 1
        ok = at + n <= first[doc + 1]
        at, slot = at[ok], slot[ok]
        times = offsets[slot + 1] - offsets[slot]
        which = np.repeat(offsets[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        begin = np.repeat(at, times) - rows[which, 0]
        # a start before the text is kept: words may be missing there
        doc = np.searchsorted(first, np.repeat(at, times), "right") - 1
        for length in np.unique(rows[which, 1]).tolist():
            mine = rows[which, 1] == length
            cut[length].append(np.unique(np.stack([doc[mine], begin[mine]]), axis=1))
    pairs: set[tuple[int, int, int]] = set()
    for length, parts in cut.items():
        doc, begin = np.unique(np.concatenate(parts, axis=1), axis=1)
        keys, which = items.keys[length]
        for a in range(0, len(doc), 4096):
            d, b = doc[a : a + 4096], begin[a : a + 4096]
            spot = b[:, None] + np.arange(length)
            outside = (spot < first[d][:, None]) | (spot >= first[d + 1][:, None])
            seen = walk_keys(np.where(outside, np.uint64(0), hashes[np.clip(spot, 0, len(hashes) - 1)]))
            lo, hi = np.searchsorted(keys, seen.ravel(), "left"), np.searchsorted(keys, seen.ravel(), "right")
            for q in np.flatnonzero(hi > lo).tolist():
                i = q // seen.shape[1]
                for block in which[lo[q] : hi[q]].tolist():
                    item, offset = items.owner[block]
                    pairs.add((int(d[i]), item, int(b[i]) - offset))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    stretches: list[list[int]] = []
    for d, item, b in sorted(pairs):
        k, n = items.edits[item], len(items.words[item])
        a, e = max(int(first[d]), b - k), min(int(first[d + 1]), b + n + k)
        if n > BLOCK_WORDS and stretches and stretches[-1][:2] == [d, item] and a <= stretches[-1][3]:
            stretches[-1][3] = max(e, stretches[-1][3])  # the blocks of one long passage: compared once
        else:
            stretches.append([d, item, a, e])
    for d, item, a, e in stretches:
        k = items.edits[item]
        distance, end = edit_distance(items.words[item], hashes[a:e])
        if distance <= k:
            found = (distance, a + end - int(first[d]))
            best[d, item] = min(best.get((d, item), found), found)
    for (d, item), (distance, end) in best.items():
        yield d, item, distance, end


def _search(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = items.value
        for batch in slices(batches, 1):
            w = words(batch.column(1), PUNCT)
            out = []
            for d, item, distance, end in matches(w.hash, w.first, table) if len(w.hash) else ():
                n = len(table.words[item])
                out.append((batch.column(0)[d].as_py(), table.ids[item], n, distance, 1 - distance / n, end))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "item_words", "distance", "similarity", "end_word"])

    return run


def _groups(benchmark: DataFrame, similarity: float, group_bytes: int) -> Iterator[tuple[Items, bool]]:
    """The items' tables, ``group_bytes`` of text or less at a time (hash parts of about half of it), and whether there are more."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"), F.octet_length("text").alias("bytes"))
    items = items.where("item_id is not null and bytes > 0")
    total = items.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    parts = max(1, -(-2 * total // group_bytes))
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows], similarity), p + 1 < parts


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, item_id, item_words, distance, similarity, end_word): every document and benchmark item that it holds.

    One row per pair, for the nearest stretch; end_word is where the first nearest one ends, in words from 0. Items of fewer than five words
    must occur unchanged. Items and documents without words, or with a null text or id, match nothing; rows that repeat an id count as
    one. Very long texts and items are searched whole; other columns, whatever their names, are ignored. An empty table on either side gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "matches")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    found = None
    for i, (items, more) in enumerate(_groups(benchmark, similarity, group_bytes)):
        group = spark.sparkContext.broadcast(items)
        one = docs.mapInArrow(_search(group), "doc_id long, item_id long, item_words int, distance int, similarity double, end_word int")
        if more or i:  # of several groups one at a time is held
            one = scratch.write(one, f"group-{i}")
            group.destroy()
        found = one if found is None else found.unionByName(one)
    best = F.min(F.struct("distance", "item_words", "similarity", "end_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.item_words", "b.distance", "b.similarity", "b.end_word")


def _without(items, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            w = words(batch.column(at), PUNCT)
            leaks = {d for d, *_ in matches(w.hash, w.first, items.value)} if len(w.hash) else ()
            yield batch.filter(pa.array([d not in leaks or not known for d, known in enumerate(batch.column(batch.num_columns - 1).to_pylist())], pa.bool_())).drop_columns([batch.schema.names[-1]])

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The documents that hold no benchmark item; all their columns, whatever their names. Rows with a null id stay.

    Each row is judged where its text is read: nothing is shuffled and no list of ids is kept. Rows that repeat an id are judged one by one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "clean")
    known = fresh(docs.columns, "known")
    for i, (items, more) in enumerate(_groups(benchmark, similarity, group_bytes)):
        group = spark.sparkContext.broadcast(items)
        kept = map_rows(docs.withColumn(known, F.col("doc_id").cast("long").isNotNull()), _without(group, docs.columns.index("text")), docs.schema)
        if more:
            kept = scratch.write(kept, f"group-{i}")
            group.destroy()
            if i:
                scratch.drop(f"group-{i - 1}")
        docs = kept
    return docs
