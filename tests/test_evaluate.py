"""What is computed by ranges: no row is lost, whatever the number of partitions and the width of rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearfield.operators import edges, evaluate, signals


@pytest.fixture(params=[8, 200])
def partitions(spark, request):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", was)


def wide(spark, n, keys):
    """Rows of some hundred bytes, in no order, one key in `keys`."""
    return spark.range(n).select(((F.col("id") * 7919) % n).alias("seq"), (F.col("id") % keys).alias("key"), (F.hash("id") % 1000 / 7.0).alias("x"), *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256).alias(f"c{k}") for k in range(4)))


@pytest.mark.parametrize("keys", [1, 50])
def test_running_statistics_keep_every_row(spark, partitions, tmp_path, keys):
    df = wide(spark, 100_000, keys)
    signals.running(df, "key", "seq", "x").write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).select("key", "seq", "n", "mean", "std").toPandas().sort_values(["key", "seq"]).reset_index(drop=True)
    want = df.select("key", "seq", "x").toPandas().sort_values(["key", "seq"]).reset_index(drop=True)
    assert len(got) == 100_000 and (got.seq == want.seq).all()
    by = want.groupby("key").x
    assert (got.n == by.cumcount() + 1).all()
    assert np.allclose(got["mean"], by.expanding().mean().reset_index(drop=True), rtol=1e-9, atol=1e-7)
    assert np.allclose(got["std"], by.expanding().std().reset_index(drop=True).fillna(1.0), rtol=1e-6, atol=1e-4)


def test_numbers_of_survivors_have_no_gap(spark, partitions):
    nodes = spark.range(30_000).select((F.col("id") * 17 % 30_011).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    got = edges.compact_ids(nodes, nodes.where("id % 3 = 0")).toPandas().sort_values("id")
    assert (got.new_id.to_numpy() == np.arange(len(got))).all() and len(got) == nodes.where("id % 3 <> 0").count()


def test_ranks_and_percentiles(spark, partitions):
    df = wide(spark, 20_000, 3).withColumn("x", F.when(F.col("seq") % 11 == 0, None).otherwise(F.round("x", 1)))
    x = df.select("key", "seq", "x").toPandas()
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    linear, index = evaluate.percentiles_linear(df, "x", points).first(), evaluate.percentiles_by_index(df, "x", points).first()
    known = np.sort(x.x.dropna().to_numpy())
    for k, p in points.items():
        assert abs(linear[k] - np.quantile(known, p)) < 1e-9 and index[k] == known[min(int(p * len(known)), len(known) - 1)]
    ranks = evaluate.fractional_ranks(df, "x", "rank", "key").select("seq", "rank").toPandas().sort_values("seq")
    want = x.assign(rank=x.groupby("key").x.rank()).sort_values("seq")
    assert np.allclose(ranks["rank"], want["rank"], equal_nan=True)


def test_percentiles_of_few_values(spark):
    one = spark.createDataFrame([(3.0,), (None,)], "x double")
    assert tuple(evaluate.percentiles_linear(one, "x", {"a": 0.0, "b": 0.9}).first()) == (3.0, 3.0)
    none = one.where("x IS NULL")
    assert tuple(evaluate.percentiles_linear(none, "x", {"a": 0.5}).first()) == (None,)
    p = signals.profile(pd.DataFrame({"density": [1.0, 2.0, 4.0], "lid": [3.0, 3.0, 3.0]}).pipe(spark.createDataFrame)).first()
    assert (p.density_q25, p.density_q50, p.lid_std) == (1.5, 2.0, 1.0)
