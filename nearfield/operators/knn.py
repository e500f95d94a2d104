"""Exact nearest neighbours, in matrix products of blocks.

Up to max_queries queries are one block, which is broadcast; each corpus row is met once and the corpus isn't shuffled. More
queries are dealt into blocks of at least MAX_QUERIES by a hash, the corpus too, and each pair of blocks is a cell of its own in a shuffle: nothing
of them goes through the driver, and a task holds one pair at a time. A cell or task keeps k hits for each query; a window
then takes the best k. Candidates from the products, all rows that rounding may put among the best k, are measured again
exactly. For L2 a block is centred first, so that vectors far from the origin are told apart. Ties: by id, in any number and
whatever the blocks are. Rows whose vector is null are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries of a block, corpus rows of a block: some megabytes each; queries in one product.
MAX_QUERIES, MAX_ROWS, CHUNK = 20_000, 20_000, 128
#: Pairs that are measured exactly at once, and pairs of a product, unless that are fewer than 16 queries'.
PAIRS, ROUGH = 1 << 16, 1 << 20


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row by row."""
    if metric == "l2":
        d = a - b
        d *= d
        return np.sqrt(d.sum(-1))
    na, nb = np.sqrt((a * a).sum(-1)), np.sqrt((b * b).sum(-1))
    low = (na < 1e-9) | (nb < 1e-9)
    return np.where(low, 1.0, np.maximum(0.0, 1 - (a * b).sum(-1) / np.where(low, 1.0, na * nb)))


def _rough(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        d = (-2 * q) @ x.T
        d += (q * q).sum(1)[:, None] + (x * x).sum(1)[None]
        return np.maximum(d, 0, out=d)

    def unit(m):
        n = np.sqrt((m * m).sum(1))[:, None]
        return np.where(n < 1e-9, 0.0, m / np.maximum(n, 1e-9))

    return 1 - unit(q) @ unit(x).T


def _margin(m: np.ndarray, metric: str) -> np.ndarray:
    """For each row, its share of the most that rounding moves a rough distance or an exact one; rows of q and x add up."""
    return 8 * (m.shape[1] + 8) * np.finfo(float).eps * ((m * m).sum(1) if metric == "l2" else np.ones(len(m)))


def _centred(q: np.ndarray, x: np.ndarray, metric: str):
    """q and x, for L2 moved by the mean of x, and for each row its share of the most that a rough distance is off."""
    if metric != "l2" or not len(x) or not len(q):
        return q, x, _margin(q, metric), _margin(x, metric)
    mean = x.mean(0)
    size = lambda m: np.sqrt((m * m).sum(1)).max()
    qc, xc = q - mean, x - mean
    lost = np.finfo(float).eps * (size(q) + size(x) + np.sqrt((mean * mean).sum()))  # by moving, in each vector's length
    return qc, xc, _margin(qc, metric) + 4 * lost * (size(qc) + size(xc) + lost), _margin(xc, metric)


def _least_copies(ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The places of the n least ids of each distinct vector, in order. Copies lie side by side, by a hash; vectors decide."""
    mult = np.random.RandomState(1).randint(0, 1 << 62, x.shape[1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    h = ((x + 0.0).view(np.uint64) * mult).sum(1, dtype=np.uint64)
    order = np.lexsort((ids, h))
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    same = np.flatnonzero(~new)
    new[same] = (x[order[same]] != x[order[same - 1]]).any(1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - start < n])


def block_hits(q_ids, q, ids, x, k: int, metric: str, exclude: str):
    """(query, id, distance) of the best k for each query; exclude: none, id (the query itself) or zero (distance up to 1e-9)."""
    out = []
    # Of equal vectors only the k least ids can be among the best k, or as many more as rows share the excluded id.
    spare = np.unique(ids, return_counts=True)[1].max(initial=0) if exclude == "id" else 0
    least = _least_copies(ids, x, k + spare)
    if len(least) < len(x):
        ids, x = ids[least], x[least]
    qc, xc, near, far = _centred(q, x, metric)
    step = max(16, min(CHUNK, ROUGH // max(1, len(x))))
    for s in range(0, len(q), step):
        part, own, mine = q[s : s + step], q_ids[s : s + step], near[s : s + step]
        d = _rough(qc[s : s + step], xc, metric)
        if exclude == "id":
            d[own[:, None] == ids[None]] = np.inf
        elif exclude == "zero":
            i, j = np.nonzero(d <= 1e-6 + mine[:, None] + far[None])
            gone = _measured(part, x, i, j, metric) <= 1e-9
            d[i[gone], j[gone]] = np.inf
        d[~np.isfinite(d)] = np.inf
        d += far[None]
        # k rows are at most this far, so the others that count, ties after rounding to 9 digits too, are not farther.
        most = np.maximum((np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(d), np.inf)) + mine, 0)
        most = (np.sqrt(most) + 2e-9) ** 2 if metric == "l2" else most + 2e-9
        i, j = np.nonzero((d - 2 * far[None] <= (most + mine)[:, None]) & np.isfinite(d))
        dist = np.round(_measured(part, x, i, j, metric), 9)
        order = np.lexsort((ids[j], dist, i))
        i, j, dist = i[order], j[order], dist[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = rank < k
        out.append((own[i[best]], ids[j[best]], dist[best]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _measured(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """exact() of the pairs i, j, some at a time, as ties may be many."""
    return np.concatenate([exact(q[i[s : s + PAIRS]], x[j[s : s + PAIRS]], metric) for s in range(0, len(i), PAIRS)] or [np.zeros(0)])


def _best(parts: list[tuple], k: int) -> tuple:
    """The k best hits of each query among those of several blocks."""
    got = tuple(np.concatenate([p[c] for p in parts]) for c in range(3))
    order = np.lexsort((got[1], got[2], got[0]))
    got = tuple(g[order] for g in got)
    keep = np.arange(len(order)) - np.searchsorted(got[0], got[0]) < k
    return tuple(g[keep] for g in got)


HITS = "qid long, id long, dist double"


def in_blocks(corpus: DataFrame, queries: DataFrame, find, merge, max_queries: int = MAX_QUERIES, max_rows: int = MAX_ROWS) -> DataFrame:
    """qid, id, dist of find(query ids, queries, ids, vectors) for each pair of blocks; merge: of what a task found in batches."""
    corpus = corpus.select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL")
    queries = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>").alias("qv")).where("qv IS NOT NULL")
    blocks = max(1, -(-queries.count() // max_queries))
    names = ["qid", "id", "dist"]
    if blocks == 1:
        rows = queries.collect()  # at most max_queries
        sent = corpus.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))

        def run(batches):
            q_ids, q = sent.value
            found = None
            for batch in batches:
                if batch.num_rows and len(q):
                    got = find(q_ids, q, batch.column(0).to_numpy(), matrix(batch.column(1)))
                    found = got if found is None else merge([found, got])
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

        return corpus.mapInArrow(run, HITS)

    def cell(xs: pa.Table, qs: pa.Table) -> pa.Table:
        if not xs.num_rows or not qs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        x, q = (matrix(t.column(1).combine_chunks()) for t in (xs, qs))
        got = find(qs.column(0).to_numpy(), q, xs.column(0).to_numpy(), x)
        return pa.table([pa.array(c) for c in got], names=names)

    # The corpus is copied for each block, so these are no smaller than a task bears, however few queries a broadcast may have.
    blocks = -(-queries.count() // max(max_queries, MAX_QUERIES))
    shares = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-corpus.count() // max_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    xs = corpus.withColumn("x", F.pmod(F.xxhash64("id", "v"), F.lit(shares)).cast("int")).withColumn("q", every(blocks))
    qs = queries.withColumn("q", F.pmod(F.xxhash64("qid", "qv"), F.lit(blocks)).cast("int")).withColumn("x", every(shares))
    return xs.groupBy("x", "q").cogroup(qs.groupBy("x", "q")).applyInArrow(cell, HITS)


def top(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude: str = "none", max_queries: int = MAX_QUERIES) -> DataFrame:
    """qid, id, dist, rank. corpus: id, v; queries: qid, qv, both with vectors of one length."""
    return top(in_blocks(corpus, queries, lambda qi, q, i, x: block_hits(qi, q, i, x, k, metric, exclude), lambda parts: _best(parts, k), max_queries), k)


def nearest_of_few(few: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude: str = "none", max_rows: int = MAX_ROWS) -> DataFrame:
    """qid, ids, dists: the k nearest of `few` (id, v), at most max_rows rows, for each row of queries (qid, qv). The few are
    broadcast, and the queries, of any number, aren't shuffled. Repeated query ids are each answered."""
    rows = few.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).where("v IS NOT NULL").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    sent = few.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))

    def run(batches):
        ids, x = sent.value
        for batch in batches:
            n, asked = batch.num_rows, batch.column(0).to_numpy()
            at, found, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if n and len(x):
                # By place, as an id may be asked several times; rows of the same id, if they are out, are passed over afterwards.
                most = k + (np.unique(ids, return_counts=True)[1].max() if exclude == "id" else 0)
                at, found, dist = block_hits(np.arange(n), matrix(batch.column(1)), ids, x, int(most), metric, "none" if exclude == "id" else exclude)
                if exclude == "id":
                    keep = found != asked[at]
                    at, found, dist = at[keep], found[keep], dist[keep]
                    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
                    at, found, dist = at[keep], found[keep], dist[keep]
            ends = pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(found)), pa.ListArray.from_arrays(ends, pa.array(dist))], names=["qid", "ids", "dists"])

    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qv").cast("array<double>").alias("qv")).where("qv IS NOT NULL")
    return asked.mapInArrow(run, "qid long, ids array<long>, dists array<double>")


def nearest_in_groups(corpus: DataFrame, k: int, metric: str = "l2", max_rows: int = MAX_ROWS) -> DataFrame:
    """qid, id, dist, rank: for each row of corpus (id, v, g) its nearest other rows of the same g. A group is dealt into blocks by its
    size, and each pair of them is a cell, so that neither many groups nor a large one make a task larger than two blocks."""
    rows = corpus.select("g", F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL AND g IS NOT NULL")
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / F.lit(max_rows)).cast("int").alias("n"))
    dealt = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("id", "v"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cell = lambda q, x: [F.col(c).alias(n) for c, n in (("g", "g"), (q, "q"), (x, "x"), ("id", "id"), ("v", "v"))]
    qs, xs = dealt.select(*cell("own", "other")), dealt.select(*cell("other", "own"))

    def run(asked: pa.Table, met: pa.Table) -> pa.Table:
        if not asked.num_rows or not met.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["qid", "id", "dist"])
        q, x = (matrix(t["v"].combine_chunks()) for t in (asked, met))
        return pa.table([pa.array(c) for c in block_hits(asked["id"].to_numpy(), q, met["id"].to_numpy(), x, k, metric, "id")], names=["qid", "id", "dist"])

    return top(qs.groupBy("g", "q", "x").cogroup(xs.groupBy("g", "q", "x")).applyInArrow(run, HITS), k)


def within(corpus: DataFrame, queries: DataFrame, radius: float, metric: str = "l2", max_queries: int = MAX_QUERIES) -> DataFrame:
    """qid, id, dist of all pairs with 1e-9 < dist <= radius: a range join in blocks."""

    def find(q_ids, q, ids, x):
        out = []
        qc, xc, near, far = _centred(q, x, metric)
        limit = (radius * radius if metric == "l2" else radius) + 1e-6
        for s in range(0, len(q), CHUNK):
            i, j = np.nonzero(_rough(qc[s : s + CHUNK], xc, metric) - far[None] <= limit + near[s : s + CHUNK, None])
            d = np.round(_measured(q[s : s + CHUNK], x, i, j, metric), 9)
            keep = (d > 1e-9) & (d <= radius)
            out.append((q_ids[s + i[keep]], ids[j[keep]], d[keep]))
        return _joined(out)

    return in_blocks(corpus, queries, find, _joined, max_queries)


def _joined(parts: list[tuple]) -> tuple:
    return tuple(np.concatenate([p[c] for p in parts]) for c in range(3))
