"""Signals by a sample, and exponential updates over ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import knn, signals

R = np.random.RandomState(9)


def fold(values, alpha=0.05):
    n, mean, m2 = 0, 0.0, 0.0
    for v in values:
        n += 1
        d = v - mean
        if n > 10:
            mean += alpha * d
            m2 = (1 - alpha) * (m2 + alpha * d * d)
        else:
            mean += d / n
            m2 += d * (v - mean)
    return n, mean, max(1e-6, m2 if n > 10 else m2 / (n - 1) if n > 1 else 1.0) ** 0.5


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_updates_compose(offset):
    x = R.normal(size=700) + offset
    cuts = [0, 1, 2, 256, 300, 556, 700]
    u = None
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step = signals.Updates.of(x[a:b], 0.05)
        u = u.then(step) if u else step
    mean, m2 = offset + 3.0, 7.0
    got = u.on(mean, m2)
    for v in x:
        d = v - mean
        mean, m2 = mean + 0.05 * d, 0.95 * (m2 + 0.05 * d * d)
    assert np.allclose(got, (mean, m2), rtol=1e-6 if offset else 1e-9) and u.n == 700  # at 1e9 a double has seven digits behind the point


def test_one_key_of_a_million_rows_lies_in_several_ranges(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % n).alias("o"), (F.hash("id") % 1000 / 7.0 + 50).alias("x"))
    got = signals.running_ema(df, "k", "o", "x").collect()
    x = df.orderBy("o").select("x").toPandas().x.to_numpy()
    want = fold(x)
    assert len(got) == 1 and got[0].n == n and np.allclose((got[0]["mean"], got[0]["std"]), want[1:], rtol=1e-9)
    sizes = df.repartitionByRange("k", "o").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < n


def test_many_keys_short_ones_and_nulls(spark):
    data = [(None if k == 3 else f"k{k}", o, None if o % 5 == 4 else float(R.normal())) for k in range(40) for o in range(k)]
    df = spark.createDataFrame(data, "k string, o long, x double").repartition(7)
    got = {r.k: (r.n, r["mean"], r["std"]) for r in signals.running_ema(df, "k", "o", "x").collect()}
    want = {}
    for k, _, x in data:
        want.setdefault(k, []).append(x)
    want = {k: fold([x for x in v if x is not None]) for k, v in want.items() if any(x is not None for x in v)}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)
    assert signals.running_ema(df.limit(0), "k", "o", "x").count() == 0


def rows(spark, n, dim=6):
    x = R.normal(size=(n, dim))
    return x, spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, g int")


def test_a_sample_depends_on_no_partition_and_merges(spark):
    _, df = rows(spark, 400)
    ids = {r.id for r in signals.sample(df, 50).collect()}
    assert len(ids) == 50 and ids == {r.id for r in signals.sample(df.repartition(9), 50).collect()}
    halves = signals.sample(df.where("id < 200"), 50).unionByName(signals.sample(df.where("id >= 200"), 50))
    assert {r.id for r in signals.sample(halves, 50).collect()} == ids
    by = signals.sample(df, 20, "g")
    assert {r.g: r["count"] for r in by.groupBy("g").count().collect()} == {0: 20, 1: 20, 2: 20}
    assert "WindowGroupLimit" in by._jdf.queryExecution().executedPlan().toString()


def test_signals_by_a_sample_need_no_shuffle(spark):
    x, df = rows(spark, 300)
    few = signals.sample(df, 80)
    out = signals.by_sample(df, few, 10)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    kept = sorted(r.id for r in few.collect())
    for r in out.collect():
        others = [i for i in kept if i != r.qid]
        d = np.sort(np.sqrt(((x[others] - x[r.qid]) ** 2).sum(1)))[:10]
        assert abs(r.density - d.mean()) < 1e-7 and abs(r.lid - 9 / -np.log(d[:-1] / d[-1]).sum()) < 1e-5
    p = signals.sampled_profile(few, 10).first()
    own = out.where(F.col("qid").isin(kept)).toPandas()
    assert abs(p.density_mean - own.density.mean()) < 1e-9 and abs(p.lid_q75 - np.quantile(own.lid, 0.75)) < 1e-9


def test_few_rows_ties_and_repeated_ids(spark):
    few = spark.createDataFrame([(1, [0.0]), (1, [5.0]), (2, [0.0]), (3, None)], "id long, v array<double>")
    asked = spark.createDataFrame([(1, [0.0]), (1, [0.0]), (9, [0.0]), (9, None)], "qid long, qv array<double>")
    got = sorted((r.qid, r.ids, r.dists) for r in knn.nearest_of_few(few, asked, 2, exclude="id").collect())
    assert got == [(1, [2], [0.0]), (1, [2], [0.0]), (9, [1, 2], [0.0, 0.0])]
    none = signals.by_sample(asked.toDF("id", "v"), few.limit(0), 3).collect()
    assert {(r.density, r.lid) for r in none} == {(1.0, 2.0)} and len(none) == 3
    with pytest.raises(ValueError, match="more than 2"):
        knn.nearest_of_few(few, asked, 2, max_rows=2)
