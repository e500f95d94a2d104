import numpy as np
import pytest

from nearfield.operators import knn


def brute(q_ids, q, ids, x, k, metric, exclude):
    out = []
    for a, v in zip(q_ids, q, strict=True):
        dist = np.round(knn.exact(np.broadcast_to(v, x.shape), x, metric), 9)
        keep = ids != a if exclude == "id" else dist > 1e-9 if exclude == "zero" else np.ones(len(x), bool)
        order = np.lexsort((ids[keep], dist[keep]))[:k]
        out += zip([a] * len(order), ids[keep][order], dist[keep][order], strict=True)
    return out


@pytest.mark.parametrize("exclude", ["none", "id", "zero"])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_ties_in_any_number_go_by_id(metric, exclude):
    r = np.random.RandomState(3)
    ids, kinds = r.permutation(3000), r.normal(size=(4, 8))
    x = kinds[r.randint(0, 4, 3000)] * (r.choice([1.0, 3.0], 3000)[:, None] if metric == "cosine" else 1)
    q, q_ids = np.concatenate([kinds + 0.01, x[:5]]), np.concatenate([np.arange(5000, 5004), ids[:5]])
    assert list(zip(*knn.block_hits(q_ids, q, ids, x, 10, metric, exclude), strict=True)) == brute(q_ids, q, ids, x, 10, metric, exclude)


def test_copies_of_a_vector_in_many_batches(spark):
    x = spark.range(2000, 2500, 1, 3).selectExpr("id", "array(1.0D, 2.0D, 3.0D) AS v").unionByName(spark.range(1000).selectExpr("id", "array(id + 9.0D, 0.0D, 0.0D) AS v"))
    q = spark.createDataFrame([(1, [1.1, 2.0, 3.0])], "qid long, qv array<double>")
    for parts in (1, 7):
        assert sorted(h.id for h in knn.nearest(x.repartition(parts), q, 10).collect()) == list(range(2000, 2010))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vectors_far_from_the_origin(metric):
    r = np.random.RandomState(5)
    x = 1e6 + r.normal(size=(3000, 16)) * 1e-2
    q = 1e6 + r.normal(size=(50, 16)) * 1e-2
    ids, q_ids = np.arange(3000), np.arange(50)
    assert list(zip(*knn.block_hits(q_ids, q, ids, x, 10, metric, "none"), strict=True)) == brute(q_ids, q, ids, x, 10, metric, "none")
    if metric == "l2":
        qc, xc, near, far = knn._centred(q, x, metric)
        off = np.abs(knn._rough(qc, xc, metric) - knn.exact(q[:, None], x[None], metric) ** 2)
        assert (off <= near[:, None] + far[None]).all() and (near + far.max()).max() < 1e-6


@pytest.mark.parametrize("max_queries", [7, 40, 1000])
def test_pairs_of_blocks_equal_brute_force(spark, max_queries):
    r = np.random.RandomState(6)
    x = np.concatenate([r.normal(size=(300, 4)), np.tile(r.normal(size=(1, 4)), (5000, 1))])
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, v array<double>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 320, 8)] + [(777, None)], "qid long, qv array<double>")
    q_ids = np.arange(0, 320, 8)
    for exclude in ("none", "id"):
        got = sorted((h.qid, h["rank"], h.id, h.dist) for h in knn.nearest(corpus, queries, 10, exclude=exclude, max_queries=max_queries).collect())
        want = brute(q_ids, x[q_ids], np.arange(len(x)), x, 10, "l2", exclude)
        assert [(a, c, d) for a, _, c, d in got] == want
    pairs = {(h.qid, h.id) for h in knn.within(corpus, queries, 0.7, max_queries=max_queries).collect()}
    d = knn.exact(x[q_ids][:, None], x[None], "l2")
    assert pairs == {(int(q_ids[i]), int(j)) for i, j in zip(*np.nonzero((d > 1e-9) & (np.round(d, 9) <= 0.7)), strict=True)}


def test_many_queries_stay_off_the_driver(spark):
    x = spark.range(400).selectExpr("id", "array(id * 1.0D, 1.0D) AS v")
    plan = knn.nearest(x, x.selectExpr("id AS qid", "v AS qv"), 3, max_queries=50)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("max_rows", [30, 10_000])
def test_neighbours_within_groups(spark, max_rows):
    r = np.random.RandomState(8)
    x, g = r.normal(size=(250, 3)), np.array(["a"] * 170 + ["b"] * 79 + ["c"])
    rows = spark.createDataFrame([(i, v.tolist(), str(k)) for i, (v, k) in enumerate(zip(x, g, strict=True))] + [(900, None, "a"), (901, [0.0] * 3, None)], "id long, v array<double>, g string")
    got = sorted((h.qid, h["rank"], h.id, h.dist) for h in knn.nearest_in_groups(rows, 4, max_rows=max_rows).collect())
    want = []
    for k in "abc":
        ids = np.flatnonzero(g == k)
        want += brute(ids, x[ids], ids, x[ids], 4, "l2", "id")
    assert [(a, c, d) for a, _, c, d in got] == want


def test_the_corpus_is_not_copied_for_each_few_queries(spark, monkeypatch):
    x = np.random.RandomState(4).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    sent, grouped = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *by: (sent.append(self.count()), grouped(self, *by))[1])
    got = knn.nearest(df, df.selectExpr("id AS qid", "v AS qv"), 3, max_queries=20)
    assert sent[0] == 300 and got.count() == 900


def test_a_large_block_is_measured_a_million_pairs_at_a_time():
    """Before, products of 128 queries with all rows of a block were held, in several copies."""
    import tracemalloc

    rng = np.random.default_rng(45)
    x, q = rng.normal(size=(20000, 4)), rng.normal(size=(128, 4))
    tracemalloc.start()
    own, ids, dist = knn.block_hits(np.arange(128), q, np.arange(20000), x, 5, "l2", "none")
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    d = knn.exact(q[:, None], x[None], "l2")
    want = np.argsort(d, axis=1)[:, :5]
    assert ids.tolist() == want.ravel().tolist() and np.allclose(dist, np.take_along_axis(d, want, 1).ravel(), atol=1e-9) and peak < 35
