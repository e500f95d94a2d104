"""Connected components of a graph given as an edge table, by alternating large and small stars.

Every round is a few joins and sums by key, so no task holds a component and nothing but a count and a checksum comes
to the driver. A vertex with very many edges is only ever summed before a shuffle or joined with a single row, a join
whose skewed side Spark splits. Rounds grow with the logarithm of the longest path.

Edges with a null end and those of a vertex to itself tie nothing and are left out; repeated ones count once. No edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import checkpointed


def _least(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(e: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours are tied to the least vertex around it."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are tied to the least of them; e has u > v."""
    m = _least(e)
    return e.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: u, v (long). Returns node, component (its least vertex) for each vertex that has an edge to another."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, last = checkpointed(e), None
    for _ in range(max_rounds):
        e = checkpointed(_small(_large(e)).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
