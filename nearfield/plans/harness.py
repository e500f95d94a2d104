"""Runs an index in several configurations and reports a row for each: size, recall, evaluations, and what is saved.

A configuration is a GraphConfig and how to search. The rows are ordinary DataFrames: write them with sources.datasets.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import graph_index as I
from nearfield.operators import knn
from nearfield.operators.knn import matrix
from nearfield.plans.session import checkpoint_folder


@dataclass(frozen=True)
class Trial:
    name: str
    config: I.GraphConfig = I.GraphConfig()
    how: dict = field(default_factory=dict)


_WIDE = I.GraphConfig(m_max=28, ef_base=150)
_PLAIN = I.GraphConfig(decay=1.0, hub_penalty=0.0)

#: The policies that are compared, the ablation's steps, and the values that are swept.
SUITE = [Trial("stock", replace(_WIDE, adaptive=False)), *(Trial(k, replace(_WIDE, kind=k)) for k in ("density_only", "lid_only")), Trial("continuous", replace(_WIDE, sensitivity=0.6)), Trial("quantile", replace(_WIDE, kind="quantile"))]
ABLATION = [
    Trial("1 stock", I.GraphConfig(adaptive=False)),
    Trial("2 degrees and beams", _PLAIN),
    Trial("3 layers", replace(_PLAIN, decay=0.75)),
    Trial("4 hubs", replace(_PLAIN, decay=0.75, hub_penalty=0.15)),
    Trial("5 early exit", I.GraphConfig(), {"patience": 6}),
    Trial("6 codes", I.GraphConfig(), {"patience": 6, "bits": 8, "pool": 30}),
]
HUB_PENALTIES, PATIENCES, SENSITIVITIES, CHURN = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3), (0, 3, 4, 5, 6, 8, 10), (0.2, 0.4, 0.6, 0.8, 1.0), (0, 10, 20, 30, 40, 50)


def sweep(values: tuple, of: str) -> list[Trial]:
    """Trials that differ in hub_penalty, sensitivity, or patience."""
    if of == "patience":
        return [Trial(f"patience={v}", I.GraphConfig(), {"patience": v}) for v in values]
    return [Trial(f"{of}={v:g}", replace(I.GraphConfig(), **{of: v})) for v in values]


def kept(df: DataFrame) -> DataFrame:
    """A copy in the shared folder, as an index is used several times."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Queries that a task holds; tasks for each core, where there are fewer shards.
ASKED, TASKS = 1 << 16, 4
TRIED = "trial int, nodes long, edges long, edges_l0 long, hits long, found long, evals long, used_ef int, seconds double"


def _tried(corpus: DataFrame, queries: DataFrame, truth: DataFrame, names: list[str], items: list, make, k: int, ef: int, recall: float, shard_size: int) -> DataFrame:
    """trial, nodes, edges, edges_l0, recall, evals (a query's in all shards), used_ef, build_s for each of names. A task builds a shard and
    searches it for all its trials, so that no index is stored, and returns a few numbers for each. A hit counts if it is in the truth: what is
    there and among the k best of its shard is among the k best of all. More than ASKED queries are several blocks, each with a
    task that builds the shard again. truth: g, qid, id. items are dealt to tasks; make(ids, x, hash of ids, items of a task) yields (shard, seconds,
    g, [(trial, how)])."""
    spark = corpus.sparkSession
    rows = I._valid(corpus)
    shards = max(1, -(-rows.count() // shard_size))
    units = min(len(items), -(-TASKS * spark.sparkContext.defaultParallelism // shards))
    queries = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>").alias("qv")).where("qv IS NOT NULL")
    asked = queries.select("qid").distinct().count()
    blocks, tasks = max(1, -(-asked // ASKED)), min(2000, 4 * shards * units)
    truth = kept(truth.select(F.col("g").cast("int"), F.col("qid").cast("long"), F.col("id").cast("long")).distinct())
    wanted = dict(truth.groupBy("g").count().collect())
    keys, every = ("shard", "unit", "block"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    xs = I._dealt(rows, shards).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(100)).cast("int")).withColumn("unit", every(units)).withColumn("block", every(blocks))
    qs = queries.join(truth.groupBy("qid").agg(F.collect_list("g").alias("gs"), F.collect_list("id").alias("true")), "qid", "left")
    qs = qs.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards)).withColumn("unit", every(units))

    def run(xt: pa.Table, qt: pa.Table) -> pa.Table:
        out = []
        if xt.num_rows:
            xt = xt.sort_by("id").combine_chunks()
            ids, first = xt["id"].to_numpy(), xt["block"][0].as_py() == 0
            q = matrix(qt["qv"].combine_chunks()) if qt.num_rows else np.zeros((0, 0))
            row = np.unique(qt["qid"].to_numpy(), return_inverse=True)[1]  # repeated queries count together
            of = row[np.repeat(np.arange(len(q)), [len(t or ()) for t in qt["true"].to_pylist()])] if len(q) else row
            flat = lambda c: qt[c].combine_chunks().flatten().to_numpy() if len(q) else np.zeros(0, np.int64)
            g, true = flat("gs"), flat("true")
            place = np.minimum(np.searchsorted(ids, true), len(ids) - 1)
            here = ids[place] == true
            for s, seconds, group, trials in make(ids, matrix(xt["v"].combine_chunks()), xt["h"].to_numpy(), items[xt["unit"][0].as_py() :: units]):
                links = [int((m >= 0).sum()) for m in s._links_of()]
                want = (of * len(ids) + place)[here & (g == group)]
                for (trial, _), ((at, hit, _), evals, used) in zip(trials, s.found_for(q, k, ef, [how for _, how in trials], recall), strict=True):
                    got = np.unique(row[at] * len(ids) + np.searchsorted(ids, hit)) if len(at) else at
                    size = (len(s.ids), sum(links), sum(links[:1])) if first else (0, 0, 0)
                    out.append((trial, *size, int(np.isin(got, want).sum()), len(at), int(evals.sum()), int(used[at].max()) if len(at) else None, seconds))
        cols = list(zip(*out, strict=True)) or [()] * 9
        kinds = (pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in TRIED.split(", ")])

    done = xs.repartition(tasks, *keys).groupBy(*keys).cogroup(qs.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, TRIED)
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("nodes", "edges", "edges_l0")]
    done = done.groupBy("trial").agg(*total, *(F.sum(c).alias(c) for c in ("hits", "found", "evals", "seconds")), F.max("used_ef").alias("used_ef"))
    named = spark.createDataFrame([(i, name, wanted.get(g, 0)) for i, (name, g) in enumerate(names)], "trial int, name string, want long")
    evals = F.when(F.col("found") > 0, F.round(F.col("evals") / F.lit(asked), 1))
    share = F.when(F.col("want") > 0, F.round(F.coalesce("hits", F.lit(0)) / F.col("want"), 6))
    size = [F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "edges", "edges_l0")]
    return kept(named.join(done, "trial", "left").select(F.col("name").alias("trial"), *size, share.alias("recall"), evals.alias("evals"), "used_ef", F.round("seconds", 3).alias("build_s")))


def _built(trials: list[Trial]):
    """For _tried: items are configurations; those of a task share their nearest neighbours."""
    configs = list(dict.fromkeys(t.config for t in trials))

    def make(ids, x, h, mine):
        near, widest = {}, max(I.Shard(ids, x, c).widest for c in mine)
        for c in mine:
            s = I.Shard(ids, x, c)
            if c.metric not in near:
                began = time.perf_counter()
                near[c.metric] = (s.neighbours(widest), time.perf_counter() - began)
            began = time.perf_counter()
            s.build(near[c.metric][0])
            yield s, near[c.metric][1] + time.perf_counter() - began, 0, [(i, t.how) for i, t in enumerate(trials) if t.config == c]

    return configs, make


def run(corpus: DataFrame, queries: DataFrame, trials: list[Trial], k: int = 10, ef: int = 50, shard_size: int = I.SHARD, times: bool = False, recall: float = 0.0) -> DataFrame:
    """A row for each trial, with edges and evaluations saved against the first one, in percent; times: also seconds to build, of all shards one after
    another, with the neighbours that trials share; recall: the least that beams are widened for."""
    truth = knn.nearest(corpus, queries, k).select(F.lit(0).alias("g"), "qid", "id")
    out = _tried(corpus, queries, truth, [(t.name, 0) for t in trials], *_built(trials), k, ef, recall, shard_size)
    out = out if times else out.drop("build_s")
    first = out.where(F.col("trial") == trials[0].name).select(F.col("edges").alias("e0"), F.col("evals").alias("v0"))
    saved = lambda c, base: F.when(F.col(base) > 0, F.round((F.col(base) - F.col(c)) / F.col(base) * 100, 2))
    return out.crossJoin(F.broadcast(first)).select(*out.columns, saved("edges", "e0").alias("edges_saved"), saved("evals", "v0").alias("evals_saved"))  # one row


def scaled(corpus: DataFrame, queries: DataFrame, sizes: list[int], trial: Trial = Trial("continuous"), k: int = 10, ef: int = 50, shard_size: int = I.SHARD) -> DataFrame:
    """A row for each size: the same trial on the rows of least id hash."""
    out = None
    for n in sizes:
        part = kept(corpus.orderBy(F.xxhash64("id"), "id").limit(n))
        truth = knn.nearest(part, queries, k).select(F.lit(0).alias("g"), "qid", "id")
        row = _tried(part, queries, truth, [(f"{n} rows", 0)], *_built([trial]), k, ef, 0.0, shard_size).drop("build_s")
        out = row if out is None else out.unionByName(row)
    return out


def churn(corpus: DataFrame, queries: DataFrame, percents: tuple = CHURN, trial: Trial = Trial("continuous"), k: int = 10, ef: int = 50, shard_size: int = I.SHARD) -> DataFrame:
    """A row for each share of deleted nodes and each state after it: marked only, healed, compacted; recall among the survivors. A row
    is deleted by its hash, so those that live from one share on to the next are measured once, and each share's truth is the best of its classes."""
    states, steps = ("marked", "healed", "compacted"), sorted(set(percents))
    h, near = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(100)), None
    for low, high in zip(steps, [*steps[1:], 100], strict=True):
        hits = knn.nearest(corpus.where((h >= low) & (h < high)), queries, k).select("qid", "id", "dist", F.lit(low).alias("low"))
        near = hits if near is None else near.unionByName(hits)
    near = kept(near)
    truth = None
    for p in steps:
        best = knn.top(near.where(F.col("low") >= p).select("qid", "id", "dist"), k).select(F.lit(p).alias("g"), "qid", "id")
        truth = best if truth is None else truth.unionByName(best)

    def make(ids, x, h, mine):
        began = time.perf_counter()
        index = I.Shard(ids, x, trial.config).build().table(0)
        seconds = time.perf_counter() - began
        for i, p in mine:
            for j, state in enumerate(states):
                if j < 2:
                    s = I.Shard.of(index, trial.config)
                    s.deleted = h < p
                s = s.heal() if state == "healed" else s.compact() if state == "compacted" else s
                yield s, seconds, p, [(i * len(states) + j, trial.how)]

    names = [(f"{p}% {state}", p) for p in percents for state in states]
    return _tried(corpus, queries, truth, names, list(enumerate(percents)), make, k, ef, 0.0, shard_size).drop("build_s")
