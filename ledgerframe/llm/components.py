"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """The smallest node reachable from each node of ``edges`` (u, v of one orderable type).

    Returns (node, component), one row per node that has an edge. Null ends, loops and repeated edges count as absent.
    Each round is written to the shared folder. A star step needs a node's smallest neighbour (aggregated before
    the shuffle) joined back to its edges (a plain equi-join, whose skewed side AQE may split): a hub's neighbours
    never meet in one task. The end is told by a count and an order-free checksum of the edges, two numbers.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.write(edges, f"{name}-0")
    before = None
    for i in range(1, most_rounds + 1):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now["n"] == 0 or now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.write(small, f"{name}-{i}")
        if i >= 2:
            scratch.drop(f"{name}-{i - 2}")
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
