"""Neighbours by codes in bytes, and their size on disk."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from nearfield.operators import codes, quantize

R = np.random.RandomState(4)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


def plain(x, q, lows, scales, bits, metric):
    w = lows + scales * np.clip(np.rint((x - lows) / scales), 0, (1 << bits) - 1)
    if metric == "l2":
        return np.round(np.sqrt(((w[None] - q[:, None]) ** 2).sum(2)), 9)
    return np.round(np.maximum(0, 1 - q @ w.T / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((w * w).sum(1))[None]), 9)


@pytest.mark.parametrize(("bits", "metric", "dim"), [(8, "l2", 6), (4, "l2", 7), (8, "cosine", 7), (4, "cosine", 1)])
def test_distances_by_tables_equal_decoded_ones(spark, bits, metric, dim):
    x, q = R.normal(size=(300, dim)), R.normal(size=(9, dim))
    x[5] = x[250]
    df = frame(spark, x)
    box = codes.Box.of(quantize.train(df, bits), bits)
    want = plain(x, q, box.lows, box.scales, bits, metric)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "qid long, qv array<double>")
    for most in (2000, 4):
        got = {}
        for r in codes.nearest(codes.encoded(df, box), box, asked, 8, metric, max_queries=most).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, r.dist))
        assert {i: [a for a, _ in v] for i, v in got.items()} == {i: np.lexsort((np.arange(300), d))[:8].tolist() for i, d in enumerate(want)}
        assert all(abs(d - want[i, a]) < 2e-9 for i, v in got.items() for a, d in v)


def test_a_second_look_is_exact_and_bytes_are_few(spark, tmp_path):
    x = R.normal(size=(4000, 32)).astype("float32").astype(float)
    df = frame(spark, x)
    df.select(F.col("v").cast("array<float>").alias("v")).coalesce(1).write.option("compression", "none").parquet(str(tmp_path / "float"))

    def size(name):
        return sum(pq.ParquetFile(f).metadata.row_group(g).column(c).total_uncompressed_size for f in (tmp_path / name).glob("*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups) for c in [pq.ParquetFile(f).metadata.num_columns - 1])

    truth = [np.argsort(((x - q) ** 2).sum(1), kind="stable")[:5].tolist() for q in x[:10]]
    asked = df.where("id < 10").selectExpr("id AS qid", "v AS qv")
    for bits, share in ((8, 4), (4, 8)):
        box = codes.Box.of(quantize.train(df, bits), bits)
        codes.encoded(df, box).coalesce(1).write.option("compression", "none").parquet(str(tmp_path / str(bits)))
        stored = spark.read.parquet(str(tmp_path / str(bits)))
        # Binary values have their length beside them, four bytes a row.
        assert size(str(bits)) <= size("float") / share * 1.35 + 4000 * 4
        got = {}
        for r in codes.nearest(stored, box, asked, 5, full=df, pool=60).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert sum(len(set(got[i]) & set(t)) for i, t in enumerate(truth)) >= 48
    assert codes.nearest(stored.limit(0), box, asked, 5).count() == 0 and codes.nearest(stored, box, asked.limit(0), 5).count() == 0


def test_a_block_of_queries_holds_few_distances_at_once():
    """Before, the distances of all 2,000 queries of a block to 4,096 rows were held and sorted, with three copies."""
    import tracemalloc

    q, x = R.normal(size=(1000, 4)), R.normal(size=(codes.ROWS, 4))
    x[7::2] = x[7]
    box = codes.Box(x.min(0), (x.max(0) - x.min(0)) / 255, 8)
    code = box.codes(x)
    tracemalloc.start()
    got = codes.block_hits(np.arange(1000), q, box, np.arange(len(x))[::-1], code, 5, "l2")
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    d = codes.distances(code, q, box, "l2")
    order = np.lexsort((np.broadcast_to(np.arange(len(x))[::-1], d.shape), d), axis=1)[:, :5]
    assert got[0].tolist() == np.repeat(np.arange(1000), 5).tolist() and got[1].tolist() == (len(x) - 1 - order).ravel().tolist()
    assert got[2].tolist() == np.take_along_axis(d, order, 1).ravel().tolist() and peak < 20
