import json

import pytest

from nearfield.plans import harness
from nearfield.plans.service import Library, Studio

DOCS = [(1, "Red apples", "fruit", "apples grow on trees"), (2, "Blue whales", "animals", "whales swim in the sea"), (3, "Green pears", "fruit", "pears grow on trees too"), (4, "Grey wolves", "animals", "wolves hunt in packs")]


def test_studio(spark):
    s = Studio(spark)
    assert s.status()["n_samples"] == 0 and not s.status()["stock_built"]
    for call in (s.build, s.search, s.graph, s.benchmark):
        with pytest.raises(ValueError):
            call()
    s.generate(n_samples=300, dim=16, n_queries=10)
    built = s.build()
    assert built["comparison"]["total_nodes"] == 300 and built["stock"]["stats"]["live"] == 300
    status = s.status()
    assert status["stock_built"] and status["adaptive_built"] and status["dim"] == 16 and status["adaptive_stats"]["total_edges"] == built["adaptive"]["stats"]["total_edges"]
    got = s.search(query=3, k=5, ef=300)
    assert got["stock"]["recall"] == got["adaptive"]["recall"] == 1.0 and got["stock"]["results"] == got["ground_truth"] and got["adaptive"]["trace"][0]["action"] == "enter"
    assert s.search(vector=[80.0] * 16, k=3)["ground_truth"][0]["dist"] > 0
    graph = s.graph(100)
    assert len(graph["nodes"]) == 100 and graph["edges_l0"] and all(e["src"] < e["dst"] for e in graph["edges_l0"]) and graph["total_nodes"] == 300
    bench = s.benchmark(k=5, ef=64)
    assert [r["trial"] for r in bench["results"]] == [t.name for t in harness.SUITE] and all(r["recall"] > 0.8 for r in bench["results"])
    json.dumps([status, built, got, graph, bench])
    s.generate(n_samples=50, dim=16, n_queries=5)
    assert not s.status()["stock_built"]


def test_library(spark):
    library = Library(spark.createDataFrame(DOCS, "id long, title string, category string, content string"))
    got = library.search("apples trees fruit", k=2)
    assert got["stock"]["hits"][0]["id"] == got["adaptive"]["hits"][0]["id"] == 1 and len(got["stock"]["hits"]) == 2
    new = library.add("Purple plums", "fruit", "plums are sweet")
    assert new == 5 and [d["id"] for d in library.list()] == [1, 2, 3, 4, 5]
    got = library.search("sweet purple plums", k=3)
    assert got["adaptive"]["hits"][0]["id"] == got["stock"]["hits"][0]["id"] == 5 and got["adaptive"]["hits"][0]["similarity"] > 0.5
    json.dumps(got)


def test_churn_and_sizes(spark):
    from nearfield.sources import generators

    x = generators.multi_cluster(spark, 300, 8)
    q = generators.queries(x, 10, 0.1)
    rows = {r.trial: r for r in harness.churn(x, q, (0, 40), k=5, ef=64).collect()}
    assert rows["40% compacted"].nodes < 300 == rows["40% healed"].nodes and all(r.recall > 0.8 for r in rows.values())
    assert [r.nodes for r in harness.scaled(x, q, [50, 200], k=5).orderBy("nodes").collect()] == [50, 200]


def test_the_churn_query_takes_every_share_of_deleted_nodes(spark):
    from nearfield.plans.catalog import QUERIES, SQL

    want = {f"{p}% {state}" for p in harness.CHURN for state in ("marked", "healed", "compacted")}
    assert {r.trial for r in QUERIES["churn"](spark, "/root/testdata/sf0.001").select("trial").collect()} == want
    assert all(f"'{t}'" in SQL["churn"] for t in want)


def test_trials_share_neighbours_but_not_graphs(monkeypatch):
    import numpy as np

    from nearfield.operators.graph_index import Shard

    x, calls, near = np.random.RandomState(3).normal(size=(400, 8)), [], Shard.neighbours
    monkeypatch.setattr(Shard, "neighbours", lambda self, *k: (calls.append(1), near(self, *k))[1])
    trials = [*harness.SUITE, *harness.sweep(harness.HUB_PENALTIES, "hub_penalty"), *harness.sweep(harness.SENSITIVITIES, "sensitivity")]
    configs, make = harness._built(trials)
    got = [(s, t) for s, _, _, t in make(np.arange(400), x, None, configs)]
    assert len(calls) == 1 and sorted(i for _, ts in got for i, _ in ts) == list(range(len(trials)))
    for s, ts in got:
        assert s.links == Shard(np.arange(400), x, trials[ts[0][0]].config).build().links


def test_churn_measures_a_row_once_for_all_shares(spark, monkeypatch):
    from nearfield.operators import knn
    from nearfield.sources import generators

    x = generators.multi_cluster(spark, 200, 8)
    measured, nearest = [], knn.nearest
    monkeypatch.setattr(knn, "nearest", lambda corpus, *a, **b: (measured.append(corpus.count()), nearest(corpus, *a, **b))[1])
    rows = harness.churn(x, generators.queries(x, 10, 0.1), (0, 20, 40), k=5, ef=64, shard_size=100).collect()
    assert sum(measured) == 200 and len(rows) == 9 and all(r.recall > 0.8 for r in rows)
