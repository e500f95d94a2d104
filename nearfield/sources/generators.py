"""Synthetic vectors. Each row is a function of its number and the seed, so any partitioning gives the same rows. Queries are
rows of the same data, picked by a hash, with a little noise, or what the data's function says."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the multi-manifold data: the roll's height; the spiral's turns, growth and centre; the ball's radius and centre; the
#: cloud's deviation and centre; noise of roll, spiral and queries.
ROLL_HEIGHT, SPIRAL_TURNS, SPIRAL_GROWTH, SPIRAL_CENTRE, BALL_RADIUS, BALL_CENTRE, CLOUD_SD, CLOUD_CENTRE = 20.0, 5, 0.5, 50.0, 15.0, -40.0, 25.0, 80.0
ROLL_NOISE, SPIRAL_NOISE, ANGLE_NOISE, QUERY_NOISE = 0.05, 0.03, 0.02, 0.1
#: Of the SIFT-like data: the centres' scale, the range of a cluster's deviation, rows to a cluster, noise of queries.
SIFT_SCALE, SIFT_SD, SIFT_ROWS, SIFT_QUERY_NOISE = 20.0, (2.0, 15.0), 500, 0.02
#: Of the clusters: their number; deviation of centres, of even and odd clusters; and of the uniform kind, range of centres and deviations, deviation of queries.
CLUSTERS, CENTRE_SD, EVEN_SD, ODD_SD, UNIFORM_CENTRE, UNIFORM_SD, UNIFORM_QUERY_SD = 8, 15.0, 0.6, 5.0, 50.0, (0.5, 5.0), 2.0


def _state(seed: int, i: int) -> np.random.RandomState:
    return np.random.RandomState((seed * 1_000_003 + i) % (1 << 32))


def _rows(spark: SparkSession, n: int, seed: int, make) -> DataFrame:
    """id, v, region of n rows; make(random state, number) returns v, region."""

    def run(frames):
        for frame in frames:
            got = [make(_state(seed, int(i)), int(i)) for i in frame.id]
            yield pd.DataFrame({"id": frame.id, "v": [g[0] for g in got], "region": [g[1] for g in got]})

    return spark.range(n).mapInPandas(run, "id long, v array<double>, region int")


def queries(data: DataFrame, n: int, noise: float, seed: int = 42, unit: bool = False) -> DataFrame:
    """qid, qv: n rows of data (id, v), picked by a hash of the id, with noise; unit: scaled to length 1."""
    picked = data.select("id", "v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)

    def run(frames):
        for frame in frames:
            out = [np.asarray(v) + _state(seed + 1, int(i)).normal(0, noise, len(v)) for i, v in zip(frame.id, frame.v, strict=True)]
            yield pd.DataFrame({"qid": frame.id, "qv": [q / max(np.linalg.norm(q), 1e-9) if unit else q for q in out]})

    return picked.mapInPandas(run, "qid long, qv array<double>")


def multi_manifold(spark: SparkSession, n: int = 10_000, dim: int = 64, seed: int = 42) -> DataFrame:
    """id, v, region: a swiss roll (0), a spiral (1), an 8-dimensional ball (2), each of n // 4 rows, and a wide Gaussian (3)."""
    if dim < 13:
        raise ValueError("dim must be 13 or more")
    each = n // 4

    def make(r, i):
        v, region = np.zeros(dim), i % 4 if i < 4 * each else 3
        if region == 0:
            t = 1.5 * np.pi * (1 + 2 * r.rand())
            v[:3] = t * np.cos(t), ROLL_HEIGHT * r.rand(), t * np.sin(t)
            v += r.normal(0, ROLL_NOISE, dim)
        elif region == 1:
            t = 2 * np.pi * SPIRAL_TURNS * (i // 4) / max(1, each - 1) + r.normal(0, ANGLE_NOISE)
            v[3:5] = SPIRAL_CENTRE + SPIRAL_GROWTH * t * np.array([np.cos(t), np.sin(t)])
            v += r.normal(0, SPIRAL_NOISE, dim)
        elif region == 2:
            g = r.normal(size=8)
            v[5:13] = BALL_CENTRE + BALL_RADIUS * r.rand() ** (1 / 8) * g / (np.linalg.norm(g) + 1e-9)
        else:
            v = r.normal(CLOUD_CENTRE, CLOUD_SD, dim)
        return v, region

    return _rows(spark, n, seed, make)


def sift_like(spark: SparkSession, n: int = 10_000, dim: int = 128, seed: int = 42) -> DataFrame:
    """id, v, region: non-negative unit vectors around exponential centres, each with a deviation of its own; region is the centre."""
    r = np.random.RandomState(seed)
    k = max(5, n // SIFT_ROWS)
    centres, sds = r.exponential(SIFT_SCALE, (k, dim)), r.uniform(*SIFT_SD, k)

    def make(r, i):
        c = r.randint(k)
        v = np.abs(centres[c] + r.normal(0, sds[c], dim))
        return v / max(np.linalg.norm(v), 1e-9), c

    return _rows(spark, n, seed, make)


def multi_cluster(spark: SparkSession, n: int = 50_000, dim: int = 64, seed: int = 42, first: int = 0) -> DataFrame:
    """id, v, region: eight centres, the even ones dense and the odd ones wide; with another `first`, other rows of the same mixture,
    as queries."""
    centres = np.random.RandomState(seed).normal(0, CENTRE_SD, (CLUSTERS, dim))

    def make(r, i):
        c = r.randint(CLUSTERS)
        return centres[c] + r.normal(0, EVEN_SD if c % 2 == 0 else ODD_SD, dim), c

    return _rows(spark, n, seed, lambda r, i: make(_state(seed, i + first), i))


def uniform_clusters(spark: SparkSession, n: int = 50_000, dim: int = 64, seed: int = 42) -> DataFrame:
    """id, v, region: eight centres and deviations drawn evenly from their ranges, n / 8 rows each."""
    r = np.random.RandomState(seed)
    centres, sds = r.uniform(-UNIFORM_CENTRE, UNIFORM_CENTRE, (CLUSTERS, dim)), r.uniform(*UNIFORM_SD, CLUSTERS)
    return _rows(spark, n, seed, lambda r, i: (centres[i % CLUSTERS] + r.normal(0, sds[i % CLUSTERS], dim), i % CLUSTERS))


def uniform_queries(spark: SparkSession, n: int = 1000, dim: int = 64, seed: int = 42) -> DataFrame:
    """qid, qv: each around a centre of its own from the same range, so mostly far from the clusters."""
    rows = _rows(spark, n, seed + 1, lambda r, i: (r.normal(r.uniform(-UNIFORM_CENTRE, UNIFORM_CENTRE, dim), UNIFORM_QUERY_SD), 0))
    return rows.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
