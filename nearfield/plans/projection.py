"""Vectors in the plane, and an index as nodes and links to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import graph_index
from nearfield.plans.session import kept


def plane(x: DataFrame) -> DataFrame:
    """id, x, y: the two main axes of the centred vectors, scaled to the largest coordinate, signs by the largest loading. Fewer than
    two rows or dimensions: zeros."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    size = x.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if size.n < 2 or size.d < 2:
        return x.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    mean = x.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x")).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("m")).select(F.col("m.x").alias("mean"))
    centred = x.join(F.broadcast(mean), F.lit(True)).select("id", array_to_vector(F.zip_with("v", "mean", lambda a, b: a - b)).alias("c"))
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    at = model.transform(centred).select("id", vector_to_array("p").alias("p")).select("id", (F.get("p", F.lit(0)) * signs[0]).alias("x"), (F.get("p", F.lit(1)) * signs[1]).alias("y"))
    top = at.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y"))).alias("top"))
    return at.join(F.broadcast(top), F.lit(True)).select("id", F.coalesce(F.try_divide("x", "top"), F.lit(0.0)).alias("x"), F.coalesce(F.try_divide("y", "top"), F.lit(0.0)).alias("y"))


def projection(index: DataFrame, max_nodes: int = 1500, sources: int = 500, max_edges: tuple[int, int] = (1500, 500)) -> tuple[DataFrame, DataFrame]:
    """Of the max_nodes least ids: (id, x, y, level, degree, lid, density), and (layer, src, dst) of links with src < dst between them:
    on layer 0 from the `sources` least ids. max_edges: the most of each layer; this is a picture."""
    index = kept(index)  # read many times, by the axes too
    some = index.select("id").orderBy("id").limit(max_nodes)
    nodes = index.join(some, "id", "left_semi").join(plane(index.select("id", "v")), "id")
    nodes = nodes.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "level", F.size(F.get("links", F.lit(0))).alias("degree"), F.round("lid", 2).alias("lid"), F.round("density", 2).alias("density"))
    first = some.orderBy("id").limit(sources)
    edges = graph_index.edges(index).where("layer < 2 AND src < dst").select("layer", "src", "dst")
    for end in ("src", "dst"):
        edges = edges.join(some.withColumnRenamed("id", end), end, "left_semi")
    low = edges.where("layer = 0").join(first.withColumnRenamed("id", "src"), "src", "left_semi").orderBy("src", "dst").limit(max_edges[0])
    return nodes, low.unionByName(edges.where("layer = 1").orderBy("src", "dst").limit(max_edges[1])).select("layer", "src", "dst")
