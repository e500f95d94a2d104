"""What an application asks for, as methods that return plain dictionaries; put any web framework in front of it.

Studio holds one data set with a stock and an adaptive index; Library holds documents with the same two over their text vectors.
Both keep their tables in the shared folder.
"""

from __future__ import annotations

import json
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import graph_index as I
from nearfield.operators import knn, text
from nearfield.plans import harness
from nearfield.plans.projection import projection
from nearfield.sources import datasets, generators


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]


def _stats(index: DataFrame) -> dict:
    """Edges in all and by layer, links of a node on layer 0, live and dead nodes, bytes."""
    e = I.edges(index)
    by = {r.layer: r.n for r in e.groupBy("layer").agg(F.count("*").alias("n")).collect()}
    d = index.select(F.size(F.get("links", F.lit(0))).alias("d"), "deleted", F.size("v").alias("dim"))
    n = d.agg(F.count("*").alias("n"), F.sum(F.col("deleted").cast("int")).alias("dead"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.percentile("d", F.lit(0.5)).alias("mid"), F.max("dim").alias("dim")).first()
    total = sum(by.values())
    return {"total_edges": total, "edges_by_layer": by, "avg_edges_per_node": round(total / max(1, n.n), 2), "degree_min": n.lo, "degree_median": n.mid, "degree_max": n.hi, "live": n.n - (n.dead or 0), "deleted": n.dead or 0, "memory_bytes": 4 * total + 4 * n.n * (n.dim or 0)}


def _compared(stock: dict, adaptive: dict) -> dict:
    base = stock["total_edges"]
    return {"edge_savings_pct": round((base - adaptive["total_edges"]) / base * 100, 2) if base else 0.0}


def _searched(index: DataFrame, qid: int, q: list[float], k: int, ef: int, config: I.GraphConfig, **how) -> dict:
    one = index.sparkSession.createDataFrame([(qid, q)], "qid long, qv array<double>")
    hits = I.search(index, one, k, ef, config, **how).orderBy("rank").collect()
    steps = I.trace(index, qid, q, k, ef, config, how.get("patience", 0)).orderBy("shard", "step")
    return {"hits": [(h.id, h.dist) for h in hits], "dist_evals": max((h.n_evals for h in hits), default=0), "used_ef": max((h.used_ef for h in hits), default=0), "trace": _rows(steps)}


class Studio:
    def __init__(self, spark: SparkSession):
        self.spark, self.corpus, self.queries, self.name = spark, None, None, None
        self.indexes: dict[str, tuple[DataFrame, I.GraphConfig, float]] = {}
        self.results: list[dict] = []

    def status(self) -> dict:
        out = {"status": "ready", "dataset": self.name, "n_samples": self.corpus.count() if self.corpus else 0, "dim": (self.corpus.agg(F.max(F.size("v"))).first()[0] or 0) if self.corpus else 0}
        for kind in ("stock", "adaptive"):
            out |= {f"{kind}_built": kind in self.indexes, f"{kind}_stats": _stats(self.indexes[kind][0]) if kind in self.indexes else None}
        return out

    def generate(self, name: str = "multi_manifold", n_samples: int = 2000, dim: int = 32, n_queries: int = 50, seed: int = 42) -> dict:
        """A generated data set takes the place of the one before; its indexes go."""
        self.load(datasets.resolve(self.spark, name, n=n_samples, dim=dim, seed=seed), name, n_queries, seed)
        return {"name": name, "n_samples": n_samples, "dim": dim, "n_queries": n_queries}

    def load(self, corpus: DataFrame, name: str, n_queries: int = 50, seed: int = 42) -> None:
        self.corpus = harness.kept(corpus.select("id", "v"))
        self.queries = harness.kept(generators.queries(self.corpus, n_queries, generators.QUERY_NOISE, seed))
        self.name, self.indexes = name, {}

    def _loaded(self) -> None:
        if self.corpus is None:
            raise ValueError("no data set yet: generate() or load() one")

    def build(self, **config) -> dict:
        """Both indexes; config: fields of GraphConfig. Defaults: m_max 28, ef 40 to 200 around 100, sensitivity 0.5."""
        self._loaded()
        adaptive = replace(I.GraphConfig(m_max=28, ef_base=100, ef_min=35, ef_max=200, sensitivity=0.5), **config)
        for kind, c in (("stock", replace(adaptive, adaptive=False)), ("adaptive", adaptive)):
            began = time.perf_counter()
            index = harness.kept(I.build(self.corpus, c))
            self.indexes[kind] = index, c, time.perf_counter() - began
        stats = {kind: {"build_time_s": round(s, 4), "stats": _stats(i)} for kind, (i, _, s) in self.indexes.items()}
        base = self.indexes["stock"][2]
        speed = {"build_speedup_pct": round((base - self.indexes["adaptive"][2]) / base * 100, 2), "total_nodes": self.corpus.count()}
        return stats | {"comparison": _compared(stats["stock"]["stats"], stats["adaptive"]["stats"]) | speed}

    def graph(self, max_nodes: int = 1500) -> dict:
        """Nodes with their place in the plane and their signals, and links between them."""
        self._loaded()
        index, config, _ = self.indexes.get("adaptive") or self.indexes["stock"]
        nodes, edges = projection(index, max_nodes)
        links = _rows(edges)
        return {"nodes": _rows(nodes), "edges_l0": [e for e in links if e["layer"] == 0], "edges_l1": [e for e in links if e["layer"] == 1], "total_nodes": self.corpus.count()}

    def search(self, vector: list[float] | None = None, query: int = 0, k: int = 10, ef: int = 50) -> dict:
        """Exact neighbours, and what each index finds for a vector, or for a query by its place in the order of ids."""
        self._loaded()
        q = list(vector) if vector is not None else list(self.queries.orderBy("qid").offset(max(0, query)).limit(1).first().qv)
        one = self.spark.createDataFrame([(0, q)], "qid long, qv array<double>")
        truth = knn.nearest(self.corpus, one, k).orderBy("rank").collect()
        out = {"k": k, "ef_search": ef, "ground_truth": [{"id": t.id, "dist": round(t.dist, 4)} for t in truth]}
        for kind, (index, config, _) in self.indexes.items():
            got = _searched(index, 0, q, k, ef, config)
            hit = {i for i, _ in got["hits"]} & {t.id for t in truth}
            out[kind] = {"results": [{"id": i, "dist": round(d, 4)} for i, d in got["hits"]], "recall": round(len(hit) / k, 4) if k else 0.0, "dist_evals": got["dist_evals"], "trace": got["trace"]}
        return out

    def benchmark(self, ef: int = 50, k: int = 10) -> dict:
        """The suite of policies; the last results stay in `results`."""
        self._loaded()
        self.results = _rows(harness.run(self.corpus, self.queries, harness.SUITE, k, ef, times=True))
        return {"results": self.results, "dataset_name": self.name, "n_samples": self.corpus.count()}


class Library:
    """documents: id, title, category, content."""

    STOCK = I.GraphConfig(metric="cosine", adaptive=False, m_base=8)
    ADAPTIVE = I.GraphConfig(metric="cosine", m_base=8, m_min=4, m_max=16, ef_base=80)

    def __init__(self, documents: DataFrame, dim: int = 64):
        self.dim, self.spark = dim, documents.sparkSession
        self.documents = harness.kept(documents.select(F.col("id").cast("long").alias("id"), "title", "category", "content"))
        self.indexes = {k: harness.kept(I.build(self._vectors(self.documents), c)) for k, c in (("stock", self.STOCK), ("adaptive", self.ADAPTIVE))}

    def _vectors(self, documents: DataFrame) -> DataFrame:
        return text.embedded(documents.withColumn("t", F.concat_ws(" ", "title", "category", "content")), "id", "t", self.dim)

    def add(self, title: str, category: str, content: str) -> int:
        """The new document's id, one above the largest; it is linked into both indexes."""
        new = (self.documents.agg(F.max("id")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(new, title, category, content)], "id long, title string, category string, content string")
        self.documents = harness.kept(self.documents.unionByName(row))
        for kind, c in (("stock", self.STOCK), ("adaptive", self.ADAPTIVE)):
            self.indexes[kind] = harness.kept(I.insert(self.indexes[kind], self._vectors(row), c))
        return new

    def list(self) -> list[dict]:
        return _rows(self.documents.orderBy("id"))

    def search(self, question: str, k: int = 5, ef: int = 50) -> dict:
        """What both indexes find, as documents with similarity and distance, and how they compare."""
        asked = self.spark.createDataFrame([(0, question)], "qid long, t string")
        q = list(text.embedded(asked, "qid", "t", self.dim).first().v)
        out, stats = {"query": question}, {}
        for kind, c in (("stock", self.STOCK), ("adaptive", self.ADAPTIVE)):
            got = _searched(self.indexes[kind], 0, q, k, max(k, ef), c)
            docs = {d.id: d.asDict() for d in self.documents.where(F.col("id").isin([i for i, _ in got["hits"]])).collect()}
            stats[kind] = _stats(self.indexes[kind])
            hits = [docs[i] | {"similarity": round(max(0.0, 1 - d), 4), "distance": round(d, 4)} for i, d in got["hits"]]
            out[kind] = {"hits": hits, "dist_evals": got["dist_evals"], "used_ef": got["used_ef"], "total_edges": stats[kind]["total_edges"], "avg_edges_per_node": stats[kind]["avg_edges_per_node"]}
        out["comparison"] = _compared(stats["stock"], stats["adaptive"]) | {"dist_evals_diff": out["adaptive"]["dist_evals"] - out["stock"]["dist_evals"]}
        return out

