import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import edges, evaluate, graph_index, knn, signals
from nearfield.operators.graph_index import GraphConfig, Shard

R = np.random.RandomState(3)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def shard():
    x = R.normal(size=(600, 16))
    return x, Shard(np.arange(600), x, GraphConfig()).build()


def recall(s, x, ef=64, patience=0, dead=()):
    hit, evals = 0, 0
    live = np.array([i for i in range(len(x)) if i not in set(dead)])
    for q in x[:50] + 0.01:
        true = set(live[np.argsort(((x[live] - q) ** 2).sum(1))[:10]].tolist())
        got, e, _ = s.search(q, 10, ef, patience)
        hit, evals = hit + len(true & {i for _, i in got}), evals + e
    return hit / 500, evals


def test_recall_and_early_exit(shard):
    x, s = shard
    full, many = recall(s, x)
    early, few = recall(s, x, patience=6)
    assert full > 0.9 and early > 0.8 and few <= many


def test_stock_recall():
    x = R.normal(size=(400, 16))
    assert recall(Shard(np.arange(400), x, GraphConfig(adaptive=False)).build(), x)[0] > 0.9


def test_a_full_beam_is_exact(shard):
    x, s = shard
    assert recall(s, x, ef=600)[0] == 1.0


def test_dead_nodes_are_never_returned_and_the_entry_moves(shard):
    x, s = shard
    was = s.entry()
    s.deleted[:] = False
    s.deleted[[was, *range(0, 600, 3)]] = True
    try:
        assert s.entry() != was and not s.deleted[s.entry()]
        dead = np.flatnonzero(s.deleted).tolist()
        assert not {i for q in x[:30] for _, i in s.search(q, 10, 64)[0]} & set(dead)
        assert recall(s, x, dead=dead)[0] > 0.85
        s.deleted[:] = True
        assert s.search(x[0], 5, 10)[0] == []
    finally:
        s.deleted[:] = False


def test_degrees_keep_to_their_budget(shard):
    _, s = shard
    for layer, links in enumerate(s.links):
        over = [u for u, ws in links.items() if len(ws) > s._budget(u, layer)[1]]
        assert len(over) <= 5  # only nodes that an unreachable one was tied to


def test_table_round_trip(shard):
    x, s = shard
    again = Shard.of(s.table(0), s.c)
    assert again.links == [{u: ws for u, ws in layer.items()} for layer in s.links]


def test_inserted_nodes_are_found_and_linked():
    x = R.normal(size=(700, 16))
    s = Shard(np.arange(0, 500), x[:500], GraphConfig()).build()
    for lo in range(500, 700, 50):
        s = s.insert(np.arange(lo, lo + 50), x[lo : lo + 50])
    assert recall(s, x)[0] > 0.9 and (np.diff(s.ids) > 0).all() and len(s.ids) == 700
    assert all(s.search(x[i], 1, 32)[0][0][1] == i for i in range(500, 700, 7))
    for layer, links in enumerate(s.links):
        assert sum(len(ws) > s._budget(u, layer)[1] for u, ws in links.items()) <= 10
        assert all(s.level[u] >= layer and all(w in links and w != u for w in ws) for u, ws in links.items())
    assert Shard(np.zeros(0, int), np.zeros((0, 16)), GraphConfig()).build().insert(np.arange(3), x[:3]).search(x[1], 1, 5)[0][0][1] == 1


def test_healing_and_compaction():
    x = R.normal(size=(500, 16))
    for step in ("heal", "compact"):
        s = Shard(np.arange(500), x, GraphConfig()).build()
        dead = [s.entry(), *range(0, 500, 3)]
        s.deleted[dead] = True
        s = getattr(s, step)()
        live = set(range(500)) - set(dead)
        assert recall(s, x, dead=dead)[0] > 0.9
        for links in s.links:
            for u, ws in links.items():
                if not s.deleted[u]:
                    assert not s.deleted[ws].any()
        if step == "compact":
            assert set(s.ids.tolist()) == live
    s.deleted[:] = True
    assert s.compact().search(x[0], 3, 8)[0] == []


@pytest.mark.parametrize("bits, least", [(8, 0.9), (4, 0.85)])
def test_beams_over_codes_are_measured_again(bits, least):
    x = R.normal(size=(500, 16))
    s = Shard(np.arange(500), x, GraphConfig()).build()
    hit = 0
    for q in x[:40] + 0.01:
        true = set(np.argsort(((x - q) ** 2).sum(1))[:10].tolist())
        got, _, _ = s.search(q, 10, 64, bits=bits, pool=30)
        assert [d for d, _ in got] == sorted(d for d, _ in got) and all(abs(d - np.sqrt(((x[i] - q) ** 2).sum())) < 1e-9 for d, i in got)
        hit += len(true & {i for _, i in got})
    assert hit / 400 > least


@pytest.mark.parametrize("kind", ["score", "hardness"])
def test_beams_as_wide_as_the_entry_asks(shard, kind):
    x, s = shard
    used = {s.search(q, 10, 64, dynamic=kind)[2] for q in x[:60] + 0.5}
    assert used <= set(range(10, 129)) and (kind == "score" or len(used) > 1)
    with pytest.raises(ValueError):
        s.search(x[0], 3, 8, dynamic="no")


def test_changes_of_an_index(spark):
    x = R.normal(size=(300, 6))
    f = frame(spark, x)
    q = f.where("id % 9 = 0").selectExpr("id AS qid", "v AS qv")
    index = graph_index.build(f.where("id < 200"), shard_size=70)
    index = graph_index.insert(index, f.where("id >= 190"), shard_size=70)
    assert index.count() == 300 and index.select("shard").distinct().count() == 3
    index = graph_index.delete(index, f.where("id % 4 = 0").select("id"))
    for changed in (graph_index.heal(index), graph_index.compact(index)):
        one, many = (sorted(map(tuple, graph_index.search(changed, q, 5, 400, max_queries=n).select("qid", "id", "rank").collect())) for n in (1000, 10))
        true = sorted((h.qid, h.id, h["rank"]) for h in knn.nearest(f.where("id % 4 <> 0"), q, 5).collect())
        assert one == many == true
    assert graph_index.compact(index).count() == 225
    again = graph_index.insert(index, f.selectExpr("id + 1000 AS id", "v"), shard_size=70)
    assert again.where("deleted").count() == 0 and again.count() == 525 and again.select("shard").distinct().count() > 3


def test_selection_equals_the_rule_written_out():
    x = R.normal(size=(60, 4))
    degree = R.randint(0, 9, 60)
    for metric in ("l2", "cosine"):
        for m in (1, 5, 12):
            d = knn.exact(x[1:], x[:1], metric)
            order = np.argsort(d)[:30]
            (got,) = graph_index.select(order[None] + 1, d[order][None], x, np.array([m]), metric, degree, 0.15)
            taken, rest = [], []
            for c in (order + 1).tolist():
                near = [knn.exact(x[c], x[t], metric) * (1 + 0.15 * degree[t] / max(1, degree.mean())) < d[c - 1] for t in taken]
                (rest if any(near) or len(taken) >= m else taken).append(c)
            assert set(got.tolist()) == set(taken + rest[: m - len(taken)])


def test_empty_and_tiny(spark):
    empty = frame(spark, np.zeros((0, 4)))
    assert graph_index.build(empty).count() == 0
    one = frame(spark, np.ones((1, 4)))
    q = one.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    assert [r.id for r in graph_index.search(graph_index.build(one), q, 3, 10).collect()] == [0]
    assert knn.nearest(empty, q, 3).count() == 0 and knn.nearest(one, q.limit(0), 3).count() == 0


def test_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, None), (2, [1.0, 1.0])], "id long, v array<double>")
    assert sorted(r.id for r in graph_index.build(rows).collect()) == [0, 2]


def test_delete_heal_compact(spark):
    g = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (0, 2), (3, 1)], "src long, dst long")
    dead = spark.createDataFrame([(1,)], "id long")
    dist = spark.createDataFrame([(0, 3, 1.0), (0, 2, 0.5), (3, 2, 0.7)], "src long, dst long, dist double")
    got = {tuple(r) for r in edges.healed(g, dead, dist, 4).collect()}
    assert got == {(0, 2), (0, 3), (3, 2)}
    nodes = spark.range(100).select("id")
    ids = {r.id: r.new_id for r in edges.compact_ids(nodes, spark.createDataFrame([(3,), (50,)], "id long")).collect()}
    assert [ids[k] for k in sorted(ids)] == list(range(98))


def test_reachability_on_a_cycle_and_an_island(spark):
    g = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (7, 8)], "src long, dst long")
    assert edges.reachable(g, spark.createDataFrame([(0,)], "id long")).count() == 3


def test_lid_of_a_line_and_a_disk(spark):
    line = np.zeros((800, 3))
    line[:, 0] = R.rand(800)
    disk = np.zeros((800, 3))
    disk[:, :2] = R.rand(800, 2)
    for x, d in ((line, 1), (disk, 2)):
        f = frame(spark, x)
        near = knn.nearest(f, f.select(F.col("id").alias("qid"), F.col("v").alias("qv")), 20, exclude="id")
        assert abs(signals.neighbour_signals(near).agg(F.avg("lid")).first()[0] - d) < 0.5


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double")
    assert tuple(evaluate.spearman(df, "a", "b").first()) == (4, 0.0, 1.0)


def test_several_passes_equal_one(spark):
    f = frame(spark, R.normal(size=(120, 5)))
    q = f.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    assert sorted(knn.nearest(f, q, 4).collect()) == sorted(knn.nearest(f, q, 4, max_queries=17).collect())


def test_exponential_statistics_equal_a_fold(spark):
    rows = [(k, i, float(R.normal(5, 2))) for k, n in (("a", 700), ("b", 11), ("c", 10), ("d", 1)) for i in range(n)] + [("a", 9999, None), (None, 0, 3.0), (None, 1, 4.0)]
    got = {r.k: r for r in signals.running_ema(spark.createDataFrame(rows, "k string, o long, x double").repartition(5), "k", "o", "x").collect()}
    for key in ("a", "b", "c", "d", None):
        n, mean, m2 = 0, 0.0, 0.0
        for x in (x for k, _, x in rows if k == key and x is not None):
            n, d = n + 1, x - mean
            if n > 10:
                mean += 0.05 * d
                m2 = 0.95 * (m2 + 0.05 * d * d)
            else:
                mean += d / n
                m2 += d * (x - mean)
        std = max(1e-6, m2 if n > 10 else m2 / (n - 1) if n > 1 else 1.0) ** 0.5
        assert got[key].n == n and abs(got[key]["mean"] - mean) < 1e-9 and abs(got[key]["std"] - std) < 1e-9


def test_selection_is_a_fold_without_python(spark):
    x = R.normal(size=(60, 5))
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    cand = [(s, int(t), float(d[s, t])) for s in range(20) for t in np.argsort(d[s])[1:16]] + [(5, 999, 0.1)]
    df, v = spark.createDataFrame(cand, "src long, dst long, dist double"), frame(spark, x)
    degree = spark.createDataFrame([(i, i % 7) for i in range(60)], "id long, degree long")
    mean = np.mean([i % 7 for i in range(60)])
    for degrees, penalty in ((None, 0.0), (degree, 0.5)):
        got = {}
        for r in edges.selected(df, v, F.when(F.col("src") == 3, None).otherwise(F.col("src") % 6), degrees, penalty).collect():
            got.setdefault(r.src, set()).add(r.dst)
        want = {}
        for s in set(range(20)) - {3}:
            yes, no, m = [], [], s % 6
            for t in np.argsort(d[s])[1:16].tolist():
                ok = len(yes) < m and not any(d[t, y] * (1 + penalty * (y % 7) / mean) < d[s, t] for y in yes)
                (yes if ok else no).append(t)
            if m:
                want[s] = set((yes + no)[:m])
        assert got == want
    few = edges.selected(spark.read.schema("src long, dst long, dist double").parquet("/root/testdata/sf0.001/labels.parquet"), spark.read.schema("id long, v array<double>").parquet("/root/testdata/sf0.001/labels.parquet"), F.lit(4))
    assert "Python" not in few._jdf.queryExecution().executedPlan().toString() and "Arrow" not in few._jdf.queryExecution().executedPlan().toString()


def test_a_dead_hub_of_many_edges_is_dealt_out(spark):
    n, hub = 100_000, 500_000
    into = spark.range(n).selectExpr("id AS src", f"{hub}L AS dst")
    out = spark.range(8).selectExpr(f"{hub}L AS src", "id * 10 AS dst")
    g, dead = into.unionByName(out), spark.createDataFrame([(hub,)], "id long")
    pairs = edges.heal_pairs(g, dead, rows=1000)
    dist = pairs.selectExpr("src", "dst", "double(abs(src - dst)) AS dist")
    new = edges.healed(g, dead, dist, 8).toPandas().sort_values("src")
    src = np.arange(n)
    near = np.minimum(np.rint(src / 10 + 1e-9), 7).astype(int) * 10
    own = np.where((src % 10 == 0) & (src <= 70), np.where(src == 0, 10, src - 10), near)  # not to itself; of equals the lesser id
    tie = (src < 70) & (src % 10 == 5)
    own = np.where(tie, src - 5, own)
    assert (new.src.to_numpy() == src).all() and (new.dst.to_numpy() == own).all()
    assert pairs.count() == 8 * n - 8


def test_a_beam_as_wide_as_the_shard_takes_no_step_for_each_node(monkeypatch):
    x, q = R.normal(size=(400, 16)), R.normal(size=(20, 16))
    s = Shard(np.arange(400), x, GraphConfig(adaptive=False)).build()
    s.deleted[::9] = True
    steps = s.search_many(q, 10, 10**6, patience=10**9)  # the same beam, a step at a time
    calls, measure = [], graph_index.exact
    monkeypatch.setattr(graph_index, "exact", lambda *a: (calls.append(1), measure(*a))[1])
    assert s.search_many(q, 10, 10**6) == steps
    assert len(calls) < 100


def test_all_nodes_of_several_shards_are_reached(spark):
    from nearfield.plans import index_queries

    got = index_queries._selected(spark, "/root/testdata/sf0.001", GraphConfig(), 200).first()
    assert got.reached == got.nodes == 500
    index = graph_index.build(frame(spark, R.normal(size=(300, 8))), shard_size=100).persist()
    shards = {s: Shard.of(index.where(f"shard = {s}").toArrow().combine_chunks(), GraphConfig()) for s in range(3)}
    assert {r.shard: r.id for r in graph_index.entries(index).collect()} == {k: s.ids[s.entry()] for k, s in shards.items()}


def test_beams_widen_until_a_sample_of_queries_finds_the_wanted_share():
    x = R.normal(size=(3300, 64))
    x, q = x[:3000], x[3000:]  # of no node's own, so that no node's links are the answer
    s = Shard(np.arange(3000), x, GraphConfig()).build()
    true = [set(np.argsort(((x - v) ** 2).sum(1))[:10].tolist()) for v in q]
    share = lambda got: sum(len(t & {i for _, i in hits}) for t, (hits, _, _) in zip(true, got, strict=True)) / 3000
    for how, least in (({}, 0.95), ({"patience": 3}, 0.85), ({"bits": 8, "pool": 30}, 0.95), ({"dynamic": "score"}, 0.9)):
        assert share(s.search_many(q, 10, 16, **how)) < least - 0.05
        got = s.search_many(q, 10, 16, recall=least, **how)
        assert share(got) >= least - 0.05 and max(e for _, e, _ in got) < 3000
    assert s.search_many(q, 10, 16, recall=0.1) == s.search_many(q, 10, 16)


def test_small_shards_go_to_a_task_together(spark, monkeypatch):
    """Before, a hit was shuffled for each shard and each block of few queries, and the index was copied for each such block."""
    rng = np.random.default_rng(37)
    x = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "id long, v array<double>")
    index = graph_index.build(x, shard_size=50)
    q = x.where("id % 6 = 0").selectExpr("id AS qid", "v AS qv")
    sent, best = [], graph_index._best
    monkeypatch.setattr(graph_index, "_best", lambda hits, k: (sent.append(hits.count()), best(hits, k))[1])
    got = {(r.qid, r["rank"]): (r.id, r.dist, r.n_evals) for r in graph_index.search(index, q, 5, 30, max_queries=10).collect()}
    assert sent == [100 * 6]  # five hits and the cost, not that of twelve shards
    true = {(r.qid, r["rank"]): (r.id, r.dist) for r in knn.nearest(x, q, 5).collect()}
    assert {key: v[:2] for key, v in got.items()} == true and all(v[2] <= 600 for v in got.values())


def test_difficulty_asks_for_neighbours_of_queries_once(spark, monkeypatch):
    """Before, all rows were queries of an exact search of all rows, and the queries again of a second one."""
    from nearfield.plans import index_queries

    asked, nearest = [], knn.nearest
    monkeypatch.setattr(knn, "nearest", lambda x, q, *a, **how: (asked.append((x.count(), q.count())), nearest(x, q, *a, **how))[1])
    row = index_queries.difficulty_vs_recall(spark, "/root/testdata/sf0.001").first()
    assert asked == [(500, 25)] and row.n == 25 and row.in_range


def test_pictures_build_the_index_once(spark):
    """Before, the index was built anew for each of the axes' passes, for nodes and for links."""
    from nearfield.plans.projection import projection

    for part in projection(graph_index.build(frame(spark, np.random.default_rng(43).normal(size=(300, 8))))):
        assert part.count() > 0 and "FlatMapGroupsInArrow" not in part._jdf.queryExecution().executedPlan().toString()


def test_selection_holds_little_and_chooses_the_same():
    """Before, all distances between a node's candidates were measured, and a block of distances grew with the shard."""
    import tracemalloc

    rng = np.random.default_rng(41)
    x = rng.normal(size=(9000, 8))
    cand = np.argsort(rng.random((64, 1000)), axis=1)
    dist = graph_index.exact(x[cand], x[cand[:, :1]], "l2")
    order = np.argsort(dist, axis=1)
    cand, dist, degree = np.take_along_axis(cand, order, 1)[:, 1:], np.take_along_axis(dist, order, 1)[:, 1:], rng.integers(1, 40, 9000)
    want = []
    for c, d in zip(cand, dist, strict=True):
        taken = []
        for j in range(len(c)):
            if len(taken) < 12 and all(graph_index.exact(x[c[j]], x[c[t]], "l2") * (1 + 0.15 * degree[c[t]] / degree.mean()) >= d[j] for t in taken):
                taken.append(j)
        spare = [j for j in range(len(c)) if j not in taken]
        want.append(c[sorted(taken + spare[: 12 - len(taken)])].tolist())
    peak = []
    for run in (lambda: graph_index.select(cand, dist, x, np.full(64, 12), "l2", degree, 0.15), lambda: Shard(np.arange(9000), x, GraphConfig())._nearest(np.arange(256), np.arange(9000), 20)):
        tracemalloc.start()
        got = run()
        peak.append(tracemalloc.get_traced_memory()[1] / 2**20)
        tracemalloc.stop()
        if len(peak) == 1:
            assert [g.tolist() for g in got] == want
    assert max(peak) < 40


def test_beams_as_wide_as_the_shard_are_measured_in_products(monkeypatch):
    """No distance of a query is sorted with all others of the shard, and the hits are those of exact search."""
    x = np.random.RandomState(5).rand(400, 8)
    s = graph_index.Shard(np.arange(400), x, graph_index.GraphConfig(adaptive=False)).build()
    whole = graph_index.Shard._all_reached

    def all_reached(self, q, starts, layer, x):
        assert layer
        return whole(self, q, starts, layer, x)

    monkeypatch.setattr(graph_index.Shard, "_all_reached", all_reached)
    got = s.search_many(x[:20], 5, 1_000_000)
    want = np.argsort(((x[:20, None] - x[None]) ** 2).sum(2), axis=1)[:, :5]
    assert [[i for _, i in hits] for hits, _, _ in got] == want.tolist() and all(e >= 400 for _, e, _ in got)


def test_an_insert_builds_the_index_once(spark, monkeypatch):
    times = spark.sparkContext.accumulator(0)
    built = graph_index.build

    def counted(corpus, *how):
        index = built(corpus, *how)

        def count(batches):
            for b in batches:
                times.add(b.num_rows)
                yield b

        return index.mapInArrow(count, index.schema)

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 11), float(i)]) for i in range(80)], "id long, v array<double>")
    index = graph_index.insert(counted(rows.where("id % 4 <> 0")), rows)
    assert index.count() == 80 and times.value == 60


def test_trials_that_differ_in_patience_share_their_beams(monkeypatch):
    x = np.random.RandomState(7).normal(size=(1500, 16))
    s = Shard(np.arange(1500), x, GraphConfig()).build()
    s.deleted[::5] = True
    hows = [{"patience": p} for p in (0, 3, 5, 8)] + [{}]
    for recall in (0.0, 0.9):
        want = [s.found_many(x[:300], 5, 32, recall=recall, **how) for how in hows]
        got = s.found_for(x[:300], 5, 32, hows, recall)
        for (a, b, c), (d, e, f) in zip(got, want, strict=True):
            assert all(np.array_equal(u, v) for u, v in zip(a, d, strict=True)) and np.array_equal(b, e) and np.array_equal(c, f)
    calls, beams = [], Shard._beams
    monkeypatch.setattr(Shard, "_beams", lambda self, q, starts, ef, layer, *a, **b: (calls.append(len(q) if layer == 0 else 0), beams(self, q, starts, ef, layer, *a, **b))[1])
    s.found_for(x[:300], 5, 32, hows)
    assert sum(calls) == 300
