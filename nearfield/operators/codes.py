"""Neighbours over vectors stored as codes: a BINARY of one byte for each dimension (8 bits), or for two (4 bits, the even one low).

Codes are never turned back into vectors. A query makes a table of what each value of each byte adds to its distance, and a row's
distance is a sum of look-ups, so that a scan reads a quarter or an eighth of what floats take. With `full`, the rows that are nearest by
code are measured again exactly.

Up to max_queries queries are broadcast with their box; beyond it the queries are answered block after block of that size. Ties: by id.
Rows with null codes and queries with null vectors are left out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import TINY, cosine, l2
from nearfield.operators.knn import HITS, _best, matrix, top

#: Queries of a broadcast block, whose tables are made in each task; rows whose look-ups are summed at once, and queries whose
#: distances to them are held at once.
MAX_QUERIES, ROWS, ASKED = 2000, 4096, 64


@dataclass(frozen=True)
class Box:
    """Lows and scales by dimension, for codes of so many bits."""

    lows: np.ndarray
    scales: np.ndarray
    bits: int

    @classmethod
    def of(cls, trained: DataFrame, bits: int) -> Box:
        """From quantize.train's row."""
        row = trained.first()
        return cls(np.array(row.lows, float), np.array(row.scales, float), bits)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bytes of vectors."""
        c = np.clip(np.rint((x - self.lows) / self.scales), 0, (1 << self.bits) - 1).astype(np.uint8)
        if self.bits == 8:
            return c
        if c.shape[1] % 2:
            c = np.concatenate([c, np.zeros((len(c), 1), np.uint8)], 1)
        return c[:, 0::2] | c[:, 1::2] << 4

    def table(self, f) -> np.ndarray:
        """What each byte value adds: f(values of a dimension's codes [dimension, code]) summed over the dimensions of a byte."""
        top_ = 1 << self.bits
        own = f(self.lows[:, None] + self.scales[:, None] * np.arange(top_))
        if self.bits == 8:
            return own
        if len(own) % 2:
            own = np.concatenate([own, np.zeros((1, top_))])
        return (own[1::2, :, None] + own[0::2, None, :]).reshape(len(own) // 2, 256)


def encoded(df: DataFrame, box: Box) -> DataFrame:
    """id, code of df (id, v)."""
    sent = df.sparkSession.sparkContext.broadcast(box)

    def run(batches):
        for batch in batches:
            c = sent.value.codes(matrix(batch.column(1))) if batch.num_rows else np.zeros((0, 1), np.uint8)
            ends = pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.BinaryArray.from_buffers(pa.binary(), len(c), [None, ends.buffers()[1], pa.py_buffer(c.tobytes())])], names=["id", "code"])

    return df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL").mapInArrow(run, "id long, code binary")


def _bytes(column: pa.Array) -> np.ndarray:
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return data[ends[0] : ends[-1]].reshape(len(column), -1)


def _sums(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    flat = code + np.arange(code.shape[1]) * 256
    return table.ravel()[flat].sum(1)


def distances(code: np.ndarray, q: np.ndarray, box: Box, metric: str) -> np.ndarray:
    """[query, row]"""
    out = np.empty((len(q), len(code)))
    size = np.sqrt(_sums(code.astype(np.int64), box.table(lambda w: w * w))) if metric == "cosine" else None
    code = code.astype(np.int64)
    for k, v in enumerate(q):
        if metric == "l2":
            out[k] = np.sqrt(_sums(code, box.table(lambda w: (w - v[:, None]) ** 2)))  # noqa: B023
        else:
            own = np.sqrt(v @ v)
            low = (size < TINY) | (own < TINY)
            out[k] = np.where(low, 1.0, np.maximum(0.0, 1 - _sums(code, box.table(lambda w: w * v[:, None])) / np.where(low, 1.0, own * size)))  # noqa: B023
    return np.round(out, 9)


def nearest(coded: DataFrame, box: Box, queries: DataFrame, k: int, metric: str = "l2", full: DataFrame | None = None, pool: int | None = None, max_queries: int = MAX_QUERIES) -> DataFrame:
    """qid, id, dist, rank: the k nearest of coded (id, code) for each of queries (qid, qv), by code; with full (id, v) by exact
    distances of the `pool` nearest by code."""
    asked = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>").alias("qv")).where("qv IS NOT NULL")
    blocks = max(1, -(-asked.count() // max_queries))
    parts = [_block(coded, box, asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid", "qv"), F.lit(blocks)) == b), pool if full is not None and pool else k, metric) for b in range(blocks)]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    if full is None:
        return top(hits, k)
    chosen = top(hits, pool or k).select("qid", "id")
    exact = l2 if metric == "l2" else cosine
    again = chosen.join(full.select("id", "v"), "id").join(asked, "qid").select("qid", "id", F.round(exact(F.col("qv"), F.col("v").cast("array<double>")), 9).alias("dist"))
    return top(again, k)


def _nearest(qid: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple:
    """(qid, id, distance) of the k least of each row of d, ties by id."""
    most = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
    i, j = np.nonzero(d <= most[:, None])
    order = np.lexsort((ids[j], d[i, j], i))
    i, j = i[order], j[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return qid[i[best]], ids[j[best]], d[i[best], j[best]]


def block_hits(qid: np.ndarray, q: np.ndarray, box: Box, ids: np.ndarray, code: np.ndarray, k: int, metric: str) -> tuple:
    """The same of rows by their codes, for some queries at a time."""
    parts = [_nearest(qid[s : s + ASKED], ids, distances(code, q[s : s + ASKED], box, metric), k) for s in range(0, len(q), ASKED)]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _block(coded: DataFrame, box: Box, queries: DataFrame, k: int, metric: str) -> DataFrame:
    rows = queries.collect()  # about max_queries
    sent = coded.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), box))

    def run(batches):
        qid, q, own = sent.value
        found = None
        for batch in batches:
            code, ids = _bytes(batch.column(1)), batch.column(0).to_numpy()
            for s in range(0, len(ids) if len(q) else 0, ROWS):
                got = block_hits(qid, q, own, ids[s : s + ROWS], code[s : s + ROWS], k, metric)
                found = got if found is None else _best([found, got], k)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["qid", "id", "dist"])

    return coded.select(F.col("id").cast("long").alias("id"), "code").where("code IS NOT NULL").mapInArrow(run, HITS)
