"""Near-duplicate documents: universal-hash minima with banding, signature verification, exact confirmation, components.

1. Every text becomes its set of word shingles (64-bit fingerprints). Documents with one and the same set form a
   class, found by a 128-bit digest whose first half names the class; from here on a class is one row, so thousands of copies cost no more.
2. A class has ``bands * rows`` minima of multiply-shift hashes (universal, 32-bit), folded into one key per band, and one
   byte of each minimum as the signature.
3. Round one links each class to the two likeliest of its buckets' centres. A centre is drawn anew for each bucket, so
   the bands try different ones. Confirmed links give components.
4. Round two compares, in every bucket whose members are not yet in one component, the members of different
   components, in the first band that they share. Small buckets give pairs that pass the signature step (``SURE`` below);
   in large ones blocks of members meet with their full sets and give confirmed links only, so a group of copies never turns into
   all its pairs. No bucket is cut short: every pair that shares one is either confirmed, refuted or already connected.
5. All confirmations compare full shingle sets in whole numbers. The sets of all classes that share a bucket are made once: the texts meet
   the ids of these classes by one shuffle, at every size the same.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8**5)**32 = 3e-6; it fails the signature step with about 1e-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, slices
from .components import connected_components
from .fingerprints import _splitmix, mix, ngrams, words

BANDS, ROWS = 32, 5
#: Share of equal signature bytes below which a pair is given up: 0.8 less 3.8 standard deviations of 160 minima.
SURE = 0.68
#: Buckets of more members are compared with full sets at hand, in blocks of about so many shingles; smaller ones give pairs.
SMALL, BLOCK_SHINGLES = 64, 100_000


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words has one shingle of them all, one without words none."""
    w = words(column)
    grams, out = ngrams(w.hash, size), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(grams[a : b - size + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(ngrams(w.hash[a:b], b - a))
        else:
            out.append(w.hash[:0])
    return out


def _minima(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of bands * rows minima for each set; none of them may be empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    a, b = _splitmix(bands * rows, 101) | np.uint64(1), _splitmix(bands * rows, 202)
    out = np.empty((bands * rows, len(sets)), np.uint32)
    buffer = np.empty_like(flat)
    for j in range(bands * rows):
        np.multiply(flat, a[j], out=buffer)
        np.add(buffer, b[j], out=buffer)
        out[j] = np.minimum.reduceat(buffer, at) >> np.uint64(32)
    return out.T


def _digests(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over the shingles of each set, whatever their order; sets begin at ``at`` and none is empty."""
    if not len(at):
        return flat[:0], flat[:0]
    return mix(np.add.reduceat(mix(flat), at)), mix(np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at))


def _sketch(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1), size)
            lengths = np.array([len(x) for x in sets], np.int64)
            full = [x for x in sets if len(x)]
            n = len(sets)
            d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            keys, signs = [None] * n, [None] * n
            if full:
                which = np.flatnonzero(lengths)
                d1[which], d2[which] = _digests(np.concatenate(full), np.cumsum([0, *map(len, full[:-1])]))
                minima = _minima(full, bands, rows)
                folded = ngrams_rows(minima.astype(np.uint64).reshape(len(full), bands, rows), bands)
                low = (minima & 255).astype(np.uint8)
                for i, k in enumerate(which.tolist()):
                    keys[k], signs[k] = folded[i], low[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "bands", "signature"],
            )

    return run


def ngrams_rows(minima: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band's minima; the band's number is part of the key."""
    key = np.repeat(_splitmix(bands, 303)[None], len(minima), 0)
    for j in range(minima.shape[2]):
        key = mix(key ^ minima[:, :, j])
    return key.view(np.int64)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            sets = [x for x in shingle_sets(batch.column(0), size) if len(x)]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            offsets = np.cumsum([0, *map(len, sets)])
            d1, _ = _digests(flat, offsets[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(d1.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))], ["id", "shingles"])

    return run


def _equal_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, sa, sb): the pairs whose signatures agree in a share of SURE at least."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            like = (x == y).mean(1)
            keep = pa.array(like >= SURE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(like).filter(keep)], ["a", "b", "alike"])


class _Block:
    """Members of one bucket in arrays."""

    def __init__(self, rows: pa.StructArray) -> None:
        self.id, self.component, self.size = (np.asarray(rows.field(x)) for x in ("id", "component", "n_shingles"))
        self.signature = np.frombuffer(b"".join(rows.field("signature").to_pylist()), np.uint8).reshape(len(rows), -1)
        self.bands = np.asarray(rows.field("bands").flatten()).reshape(len(rows), -1)
        # sorted as the unsigned numbers that they are
        self.sets = [np.asarray(x.values).view(np.uint64) for x in rows.field("shingles")] if "shingles" in [f.name for f in rows.type] else None


def _likely_in(key: int, x: _Block, y: _Block, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of x those of y in other components that may be similar: sizes allow it, signatures agree, and no earlier band has the pair."""
    band = int(np.flatnonzero(x.bands[0] == key)[0])
    need = SURE * x.signature.shape[1]
    for i in range(len(x.id)):
        ok = (y.component != x.component[i]) & (100 * np.minimum(y.size, x.size[i]) >= percent * np.maximum(y.size, x.size[i]))
        ok &= ~(y.bands[:, :band] == x.bands[i, :band]).any(1)
        other = np.flatnonzero(ok)
        if len(other):
            other = other[(y.signature[other] == x.signature[i]).sum(1) >= need]
        if len(other):
            yield i, other


def _pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, xs, ys) of small buckets: the likely pairs across components, smaller id first."""
        for batch in batches:
            found = [np.zeros((2, 0), np.int64)]
            for key, xs, ys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x, y = _Block(xs.values), _Block(ys.values)
                for i, other in _likely_in(key, x, y, percent):
                    ids = y.id[other]
                    found.append(np.stack([np.minimum(x.id[i], ids), np.maximum(x.id[i], ids)]))
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, xs, ys) of large buckets, with full sets: confirmed links, one for each member and component that it meets."""
        for batch in batches:
            found: list[tuple[int, int]] = []
            for key, xs, ys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x, y = _Block(xs.values), _Block(ys.values)
                for i, other in _likely_in(key, x, y, percent):
                    own = x.sets[i]
                    flat = np.concatenate([y.sets[k] for k in other])
                    spot = np.searchsorted(own, flat)
                    spot[spot == len(own)] = 0
                    ends = np.cumsum([len(y.sets[k]) for k in other])
                    both = np.add.reduceat((own[spot] == flat).astype(np.int64), np.concatenate([[0], ends[:-1]]))
                    hit = other[100 * both >= percent * (len(own) + y.size[other] - both)]
                    _, one = np.unique(y.component[hit], return_index=True)
                    found += [(int(x.id[i]), int(y.id[k])) for k in hit[one]]
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked when 100 * intersection >= percent * union of their distinct ``size``-word shingles.

    Words are runs of other than ASCII white space with A-Z lower-cased. Returns one row per input row: doc_id,
    n_shingles, component_id (smallest id reachable through links, itself included) and kept (doc_id = component_id).
    Null or empty texts and texts without words have no shingles and link with nothing. A null id takes part in no group: its component_id is
    null and it is kept. Rows that repeat an id are one document for grouping: whatever any of their texts is linked with. Very long texts count
    whole. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = scratch.write(docs.mapInArrow(_sketch(size, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"), "sketches")
    linked = sketches.where("n_shingles > 0 and doc_id is not null")
    # a class is called by the first half of its digest; its smallest document stands for it
    classes = scratch.write(linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")), "classes")
    heads = linked.join(classes, ["d1", "d2", "doc_id"]).dropDuplicates(["doc_id", "d1", "d2"])
    heads = scratch.write(heads.select(F.col("d1").alias("id"), "doc_id", "n_shingles", "bands", "signature"), "heads")
    slim = scratch.write(sketches.select("doc_id", "n_shingles", "d1", "d2"), "slim")
    scratch.drop("sketches")
    # buckets with two members at least; what is known of each is written first, so that a join may split a bucket with a third of all entries
    entries = heads.select("id", "n_shingles", F.explode("bands").alias("key"))
    busy = entries.groupBy("key").agg(F.count("*").alias("total"), F.min(F.struct(F.xxhash64("id", "key"), "id"))["id"].alias("centre")).where("total > 1")
    buckets = scratch.write(entries.join(scratch.write(busy, "busy"), "key"), "buckets")
    scratch.drop("busy")

    signature = heads.select("id", "signature")

    def likely(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(signature.toDF("a", "sa"), "a").join(signature.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        return pairs.mapInArrow(_equal_bytes, "a long, b long, alike double")

    # the full sets of all classes in such buckets; a document's other texts may give sets that no pair asks for
    needed = heads.select("id", "doc_id").join(buckets.select("id").distinct(), "id", "left_semi").select("doc_id").distinct()
    sets = docs.join(needed.hint("shuffle_hash"), "doc_id", "left_semi").select("text").mapInArrow(_sets(size), "id long, shingles array<long>")
    sets = scratch.write(sets.dropDuplicates(["id"]), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose full sets reach the similarity; both sets are met by equi-joins."""
        joined = pairs.select("a", "b").join(sets.toDF("a", "xs"), "a").join(sets.toDF("b", "ys"), "b")
        joined = joined.withColumn("both", F.size(F.array_intersect("xs", "ys")).cast("long"))
        return scratch.write(joined.where(f"100 * both >= {percent} * (size(xs) + size(ys) - both)").select("a", "b"), f"links-{name}")

    ends = [F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")]
    stars = buckets.where("id <> centre").groupBy(*ends, "id").agg(F.min("total").alias("least")).select("a", "b", "id", "least")
    rank = Window.partitionBy("id").orderBy(F.desc("alike"), "a", "b")  # at most one row per band
    best = likely(stars.select("a", "b").distinct()).join(stars, ["a", "b"]).withColumn("rank", F.row_number().over(rank))
    # the one pair of a bucket of two is always tried, so round two has larger buckets only
    first = scratch.write(best.where("rank <= 2 or least = 2").select("a", "b").distinct(), "pairs-1")
    links = confirmed(first, "1")
    part = connected_components(links.toDF("u", "v"), scratch, "cc-1")

    placed = buckets.where("total > 2").select("key", "id", "n_shingles", "total").join(part.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sums = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")).groupBy("key")
    mixed = sums.agg(F.sum("weight").alias("weight"), F.count("*").alias("components"), F.max(F.struct("n", "component"))["component"].alias("main"))
    mixed = scratch.write(mixed.where("components > 1").drop("components"), "mixed")
    placed = scratch.write(placed.join(mixed, "key"), "placed")
    scratch.drop("buckets")
    scratch.drop("mixed")
    sketch = heads.select("id", "signature", "bands")

    def met(members: DataFrame, count: Column, *more: str) -> DataFrame:
        """Blocks (key, xs, ys) that must be compared, each bucket in ``count`` of them: a bucket's largest component is met by the rest alone."""
        members = members.withColumn("block", F.pmod(F.xxhash64("id", "key"), count))
        member = F.struct("id", "component", "n_shingles", "signature", "bands", *more)
        blocks = members.groupBy("key", "block", (F.col("component") == F.col("main")).alias("in_main")).agg(F.collect_list(member).alias("rows"))
        rest = blocks.where("not in_main").select("key", F.col("block").alias("xb"), F.col("rows").alias("xs"))
        others = blocks.select("key", F.col("block").alias("yb"), "in_main", F.col("rows").alias("ys"))
        return rest.join(others, "key").where("in_main or xb <= yb").select("key", "xs", "ys")

    with arrow_rows(spark, 500):
        small = met(placed.where(f"total <= {SMALL}").join(sketch, "id"), F.lit(1)).mapInArrow(_pairs(percent), "a long, b long")
        second = scratch.write(small.join(first, ["a", "b"], "left_anti"), "pairs-2")
    large = placed.where(f"total > {SMALL}")
    with arrow_rows(spark, 8):
        third = scratch.write(met(large.join(sketch, "id").join(sets, "id"), F.ceil(F.col("weight") / BLOCK_SHINGLES), "shingles").mapInArrow(_links(percent), "a long, b long"), "links-3")
    links = links.unionByName(confirmed(second, "2")).unionByName(third)
    # texts of one document are one node: each of its classes is tied to the smallest
    several = linked_classes(slim)
    for name in ("heads", "placed", "sets"):
        scratch.drop(name)
    component = scratch.write(connected_components(links.toDF("u", "v").unionByName(several), scratch, "cc-2"), "components")
    classes = classes.join(component.toDF("d1", "component"), "d1", "left").withColumn("component", F.coalesce("component", "d1"))
    least = scratch.write(classes.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    out = slim.join(classes.select("d1", "d2", "component").join(least, "component").drop("component"), ["d1", "d2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def linked_classes(slim: DataFrame) -> DataFrame:
    """(u, v): classes that hold texts of one document, tied to the smallest of them."""
    own = slim.where("n_shingles > 0 and doc_id is not null").select("doc_id", F.col("d1").alias("u")).distinct()
    least = own.groupBy("doc_id").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1")
    return own.join(least, "doc_id").where("u <> v").select("u", "v")


#: The same groups in DuckDB, by all pairs of distinct sets that share a shingle (four words, 80 of 100).
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END)) AS g FROM d),
c AS (SELECT min(doc_id) AS id, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT id, n, unnest(g) AS h FROM c),
l AS (SELECT a.id AS u, b.id AS v FROM x a JOIN x b ON a.h = b.h AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
m AS (SELECT u, least(u, min(v)) AS m FROM r GROUP BY u)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(m.m, c.id, s.doc_id) AS component_id, s.doc_id = coalesce(m.m, c.id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN m ON m.u = c.id
"""
