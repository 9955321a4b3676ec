"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Equal vectors of one label form a class; only one of them is looked up.
2. ITQ (Gong and Lazebnik, 2011) learns a rotation of the principal axes whose signs make balanced binary codes. It is fitted on
   at most ``sample_rows`` classes chosen by hash; every class is coded and indexed. Each ``Index`` has as many rotations as its tables need.
3. Codes are cut into parts, a table each. A class enters each table under its part and all parts one bit away, so two
   classes meet wherever a part differs in two bits at most. Parts grow with the number of vectors (``MORE_BITS`` above its logarithm), so
   that chance meetings of a vector stay few; the number of tables grows with them to keep the recall.
4. Each pair counts once, in the first such table and under one key. Codes that differ in more than ``FAR`` bits are no candidates.
5. Buckets of up to ``BLOCK`` members give candidate pairs, which meet their original vectors by joins. Larger ones carry the vectors and are
   compared block by block with matrix products, which give each vector's number of links and a few links that span what hangs together: a
   group of thousands of near copies never becomes a row for each of its pairs.

All cosines are of the original vectors in double precision. At cosine 0.93 a bit differs with a chance of about 0.12.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows
from .components import connected_components
from .fingerprints import _splitmix

SAMPLE_ROWS, ROUNDS = 20_000, 50
BITS, FAR, BLOCK = 64, 20, 512
#: Parts have so many bits more than the logarithm of the largest label's number of vectors; within these bounds.
MORE_BITS, LEAST_BITS, MOST_BITS = 3, 14, 40
#: The chance of a bit to differ at the least cosine, and of a pair there to meet in no table.
BIT_DIFFERS, MISSED = 0.12, 0.005


class Rotation:
    """ITQ on unit vectors: the mean, and the axes whose signs are the bits."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> None:
        self.mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
        x = sample - self.mean
        values, axes = np.linalg.eigh(x.T @ x)
        width = min(bits, x.shape[1])
        axes = axes[:, np.argsort(-values)[:width]]
        projected = x @ axes
        r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(projected @ r >= 0, 1.0, -1.0).T @ projected)
            r = (u @ v).T
        self.axes = axes @ r
        self.width = width

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = ((unit - self.mean) @ self.axes >= 0).astype(np.uint64)
        return (bits << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)


class Index:
    """Rotations, and how their codes are cut into tables for ``n`` vectors."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        self.dim = sample.shape[1]
        bits = min(BITS, self.dim)
        self.width = min(bits, max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(max(2, n))) + MORE_BITS)))
        meet = sum(math.comb(self.width, k) * BIT_DIFFERS**k * (1 - BIT_DIFFERS) ** (self.width - k) for k in range(3))
        self.each = bits // self.width  # tables of one rotation
        self.tables = 1 if self.width <= 2 else math.ceil(math.log(MISSED) / math.log(1 - meet))
        self.rotations = [Rotation(sample, seed=7 + i) for i in range(-(-self.tables // self.each))]

    def place(self, slot: int) -> tuple[int, int]:
        """The rotation of a table, and where its part begins."""
        return slot // self.each, slot % self.each * self.width


def fold(v: np.ndarray, dim: int) -> np.ndarray:
    """A vector of any length as one of ``dim``: sums with fixed random signs, so that vectors of one length keep about their angles."""
    padded = np.zeros(-(-len(v) // dim) * dim)
    padded[: len(v)] = v * np.where(_splitmix(len(v), 5) >> np.uint64(63), 1.0, -1.0)
    return padded.reshape(-1, dim).sum(0)


def folded(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of ``dim`` for the codes; those that are of this length as they are."""
    flat, offsets = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    if (np.diff(offsets) == dim).all():
        rows = flat.reshape(-1, dim)
    else:
        rows = np.stack([flat[a:b] if b - a == dim else fold(flat[a:b], dim) for a, b in zip(offsets, offsets[1:], strict=False)])
    return rows / np.maximum(np.sqrt((rows * rows).sum(1)), 1e-300)[:, None]


def _code(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns v and others: the codes by all rotations."""
        for batch in batches:
            if batch.num_rows:
                unit = folded(batch.column(0), index.value.dim)
                codes = np.stack([r.codes(unit) for r in index.value.rotations], axis=1).view(np.int64)
                offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), *batch.columns[1:]], ["codes", *batch.schema.names[1:]])

    return run


def _tells(index: Index, slot: int, key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs (rows of codes x and y, met under ``key``) this table and key are to tell."""
    mask = np.uint64((1 << index.width) - 1)
    ok = np.ones(len(x), bool)
    for t in range(slot + 1):
        r, at = index.place(t)
        mine = (x[:, r] >> np.uint64(at)) & mask
        diff = mine ^ ((y[:, r] >> np.uint64(at)) & mask)
        n = np.bitwise_count(diff)
        if t < slot:
            ok &= n > 2
    # the part itself, the smaller of both, or the smaller of the two between
    return ok & (n <= 2) & np.where(n == 0, key == mine, np.where(n == 1, key == np.minimum(mine, mine ^ diff), key < key ^ diff))


def _candidates(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (slot, key, rows) of small buckets: candidate pairs, the smaller id first."""
        for batch in batches:
            slots, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            members = batch.column(2)
            size = np.diff(np.asarray(members.offsets))
            ids = np.asarray(members.flatten().field("id"))
            codes = np.asarray(members.flatten().field("codes").flatten()).view(np.uint64).reshape(len(ids), -1)
            start = np.cumsum(size) - size
            pairs = np.cumsum(size.astype(np.int64) * (size - 1) // 2)
            # buckets with a million pairs or so at once
            cuts = np.searchsorted(pairs, np.arange(1 << 20, pairs[-1] + 1 if len(pairs) else 0, 1 << 20))
            found = [np.zeros((2, 0), np.int64)]
            for a, b in zip([0, *np.unique(cuts)], [*np.unique(cuts), len(size)], strict=True):
                which = np.repeat(np.arange(a, b), size[a:b])
                row = np.arange(len(which)) + (start[a] if a < b else 0)
                later = start[which] + size[which] - 1 - row
                i = np.repeat(row, later)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
                bucket = np.repeat(which, later)
                near = np.flatnonzero(np.bitwise_count(codes[i, 0] ^ codes[j, 0]) <= FAR)
                i, j, bucket = i[near], j[near], bucket[near]
                for slot in np.unique(slots[bucket]).tolist():
                    mine = np.flatnonzero(slots[bucket] == slot)
                    mine = mine[_tells(index.value, slot, keys[bucket[mine]], codes[i[mine]], codes[j[mine]])]
                    x, y = ids[i[mine]], ids[j[mine]]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length in double precision."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix the smallest one that hangs together with it."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None], len(linked)).min(1, initial=len(linked)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _dense(index, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (slot, key, same, xs, ys) of large buckets, with vectors: (a, null, n) for each vector's linked others, (a, b, null) for links that span them."""
        for batch in batches:
            out: list[tuple] = []
            for slot, key, same, xs, ys in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4), strict=True):
                x, y = (np.asarray(z.values.field("id")) for z in (xs, ys))
                p, q = (np.asarray(z.values.field("codes").flatten()).view(np.uint64).reshape(len(z.values), -1) for z in (xs, ys))
                ok = np.bitwise_count(p[:, :1] ^ q[:, 0]) <= FAR
                if same:
                    ok &= y > x[:, None]
                i, j = np.nonzero(ok)
                told = _tells(index.value, slot, np.uint64(key), p[i], q[j])
                ok[i, j] = told
                if not told.any():
                    continue
                u, v = matrix(xs.values.field("v")), matrix(ys.values.field("v"))
                cosine = (u @ v.T) / (np.sqrt((u * u).sum(1))[:, None] * np.sqrt((v * v).sum(1)))
                linked = ok & (cosine >= least)
                for ids, count in ((x, linked @ np.asarray(ys.values.field("n"))), (y, linked.T @ np.asarray(xs.values.field("n")))):
                    out += [(int(ids[i]), None, int(count[i])) for i in np.flatnonzero(count)]
                ids = np.concatenate([x, y])
                both = np.zeros((len(ids), len(ids)), bool)
                both[: len(x), len(x) :] = linked
                label = spanning(both | both.T)
                out += [(int(ids[i]), int(ids[label[i]]), None) for i in np.flatnonzero(label != np.arange(len(ids)))]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b, x, y: the cosine of x and y, which have one length in a row."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.asarray(batch.column(i).flatten(), np.float64) for i in (2, 3))
            at = np.asarray(batch.column(2).offsets)[:-1] - batch.column(2).offsets[0].as_py()
            dot, xx, yy = (np.add.reduceat(z, at) for z in (x * y, x * x, y * y))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(dot / (np.sqrt(xx) * np.sqrt(yy)))], ["a", "b", "cosine"])


def _links(heads: DataFrame, least: float, sample_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(u, v), links that span all that is linked; and (id, n), numbers of linked others to be summed. heads: id, label, size, v, n."""
    spark = heads.sparkSession
    sizes = heads.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    most = heads.groupBy("label", "size").count().agg(F.max("count").alias("n")).first()["n"]
    some = heads.where(F.col("size") == sizes["size"])
    if sizes["n"] > sample_rows:
        some = some.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(sample_rows / sizes["n"] * (1 << 30))))
    sample = some.select("v").toArrow()["v"].combine_chunks()  # bounded by sample_rows
    plan = Index(folded(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample, sizes["size"]), most)
    index = spark.sparkContext.broadcast(plan)
    kind = heads.schema["label"].dataType.simpleString()
    codes = heads.select("v", "id", "label", "size").mapInArrow(_code(index), f"codes array<long>, id long, label {kind}, size int")
    part = lambda t: F.shiftrightunsigned(F.col("codes")[plan.place(t)[0]], plan.place(t)[1]).bitwiseAND(F.lit((1 << plan.width) - 1))
    slots = F.explode(F.array(*(F.struct(F.lit(t).alias("slot"), part(t).alias("part")) for t in range(plan.tables))))
    entries = codes.select("id", "label", "size", "codes", slots.alias("s")).select("id", "label", "size", "codes", "s.slot", "s.part")
    around = F.explode(F.array(F.col("part"), *(F.col("part").bitwiseXOR(F.lit(1 << b)) for b in range(plan.width))))
    bucket = ["label", "size", "slot", "key"]
    entries = scratch.write(entries.select("id", "label", "size", "codes", "slot", around.alias("key")), "entries")
    counts = scratch.write(entries.groupBy(*bucket).agg(F.count("*").alias("members")).where("members > 1"), "counts")
    small = entries.join(counts.where(f"members <= {BLOCK}"), bucket).groupBy(*bucket).agg(F.collect_list(F.struct("id", "codes")).alias("rows"))
    with arrow_rows(spark, 2000):
        pairs = scratch.write(small.select("slot", "key", "rows").mapInArrow(_candidates(index), "a long, b long"), "pairs")
    v = heads.select("id", "v", "n")
    near = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    with arrow_rows(spark, 2000):
        links = scratch.write(near.select("a", "b", "x", "y").mapInArrow(_cosines, "a long, b long, cosine double").where(F.col("cosine") >= least), "links")
    # large buckets: members in blocks, with their vectors; counted out once, so that a hot bucket is many blocks
    large = entries.join(counts.where(f"members > {BLOCK}"), bucket).join(v, "id")
    block = F.pmod(F.xxhash64("id", "key"), F.ceil(2 * F.col("members") / BLOCK))
    blocks = large.groupBy(*bucket, block.alias("block")).agg(F.collect_list(F.struct("id", "codes", "v", "n")).alias("rows"))
    blocks = scratch.write(blocks, "blocks")
    scratch.drop("entries")
    left, right = blocks.withColumnsRenamed({"block": "xb", "rows": "xs"}), blocks.withColumnsRenamed({"block": "yb", "rows": "ys"})
    met = left.join(right, bucket).where("xb <= yb").select("slot", "key", (F.col("xb") == F.col("yb")).alias("same"), "xs", "ys")
    with arrow_rows(spark, 20):
        dense = scratch.write(met.mapInArrow(_dense(index, least), "a long, b long, n long"), "dense")
    scratch.drop("blocks")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    numbers = both.join(heads.select(F.col("id").alias("b"), "n"), "b").select(F.col("a").alias("id"), "n").unionByName(dense.where("b is null").select(F.col("a").alias("id"), "n"))
    spans = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(dense.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    return spans, numbers


def near_vectors(vectors: DataFrame, least: float = 0.93, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Two vectors link when their labels are equal and not null, their lengths are equal and their cosine is ``least`` or more. n_links counts the
    other vectors linked directly, copies included; component_id is the smallest vec_id reachable, itself included; kept: it is that one. Vectors
    that are null, zero, or hold null or non-finite components link with nothing. A null id links with nothing and is kept. Rows that repeat an
    id are one node: whatever any of their vectors reaches; each counts its own links. Other columns, whatever their names, are ignored. An
    empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    key = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("size")]
    rows = rows.select("vec_id", "label", usable.alias("ok"), "v", *key)
    same = ["label", "size", "h1", "h2"]
    good = rows.where("ok")
    # a class is called by a hash of all that its vectors share
    classes = good.groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("v").alias("v"))
    heads = scratch.write(classes.select(F.xxhash64(*same).alias("id"), "*"), "heads")
    if heads.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links, numbers = _links(heads.select("id", "label", "size", "v", "n"), least, sample_rows, scratch)
    own = good.select("vec_id", F.xxhash64(*same).alias("u")).distinct()  # classes that share an id are tied to the smallest
    tied = own.join(own.groupBy("vec_id").agg(F.min("u").alias("v"), F.count("*").alias("m")).where("m > 1"), "vec_id").where("u <> v").select("u", "v")
    component = scratch.write(connected_components(links.unionByName(tied), scratch), "components")
    classes = heads.drop("v").join(component.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least_id = scratch.write(classes.groupBy("component").agg(F.min("vec_id").alias("component_id")), "least")
    counts = numbers.groupBy("id").agg(F.sum("n").alias("others"))
    classes = classes.join(least_id, "component").join(counts, "id", "left").select(*same, "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    placed = good.drop("v").join(classes, same).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The same links in DuckDB, by brute force within each label.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT u, u AS v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
c AS (SELECT u, min(v) AS c FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, vec_id) AS component_id, vec_id = coalesce(c.c, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id
"""
