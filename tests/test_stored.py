"""The stored index: exact search reads few parts, changes touch few files."""

import os

import numpy as np
import pytest

from nearfield.operators import stored

R = np.random.RandomState(2)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], "id long, v array<double>").repartition(3)


def clustered(n, dim=8, clusters=12):
    centres = np.random.RandomState(1).normal(size=(clusters, dim)) * 30
    return centres[np.arange(n) % clusters] + R.normal(size=(n, dim))


def best(x, ids, q, k):
    d = np.round(np.sqrt(((x - q) ** 2).sum(1)), 9)
    return [int(i) for i in np.asarray(ids)[np.lexsort((ids, d))[:k]]]


def shown(found):
    out = {}
    for r in sorted(found.hits.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.id)
    return out


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}


def asked(spark, q):
    return frame(spark, q).toDF("qid", "qv")


@pytest.fixture
def index(spark, tmp_path):
    x = clustered(1200)
    stored.build(frame(spark, x), str(tmp_path / "i"), max_rows=100, pivots=24)
    return x, str(tmp_path / "i")


def test_few_parts_are_read_for_exact_neighbours(spark, index):
    x, path = index
    q = x[[0, 12, 24]] + 0.1  # of one cluster
    found = stored.search(asked(spark, q), path, 10)
    assert shown(found) == {i: best(x, np.arange(1200), v, 10) for i, v in enumerate(q)}
    assert found.of == 1200 and found.read < 240
    q = x[:40] + 0.1
    found = stored.search(asked(spark, q), path, 10)
    assert shown(found) == {i: best(x, np.arange(1200), v, 10) for i, v in enumerate(q)} and found.measured.first().measured < 0.2 * 40 * 1200
    probed = stored.search(asked(spark, q), path, 10, probes=3)
    hit = sum(len(set(v) & set(best(x, np.arange(1200), q[i], 10))) for i, v in shown(probed).items())
    assert hit >= 0.95 * 400 and probed.measured.first().measured < 0.2 * 40 * 1200


def test_changes_touch_their_parts_only(spark, index):
    x, path = index
    before = files(path)
    new = x[[3, 15]] + 0.01
    stored.insert(frame(spark, np.concatenate([new, x[[27]] + 5]), [5000, 5001, 27]), path)
    assert {f: t for f, t in files(path).items() if f in before} == before
    dead = [i for i in range(1200) if i % 12 == 7]
    stored.delete(frame(spark, x[dead], dead), path)
    assert {f: t for f, t in files(path).items() if f in before} == before
    ids = np.array([i for i in range(1200) if i not in dead and i != 27] + [5000, 5001, 27])
    now = np.concatenate([x[[i for i in range(1200) if i not in dead and i != 27]], new, x[[27]] + 5])
    q = np.concatenate([x[[3, 7, 27]], x[[27]] + 5])
    want = {i: best(now, ids, v, 5) for i, v in enumerate(q)}
    assert shown(stored.search(asked(spark, q), path, 5)) == want
    assert stored.compact(spark, path, churn=0.99) > 0  # the cluster that is gone as a whole
    was = {m.c: (m.gens, m.n) for m in stored.lines(spark, path)}
    assert stored.compact(spark, path) == 0
    assert shown(stored.search(asked(spark, q), path, 5)) == want and was == {m.c: (m.gens, m.n) for m in stored.lines(spark, path)}
    assert {f: t for f, t in files(path).items() if f in before} == before  # old files stay for readers of an old version
    assert sum(m.n - m.dead for m in stored.lines(spark, path)) == len(ids)


def test_churn_triggers_compaction_of_the_worn_cells(spark, index):
    x, path = index
    dead = [i for i in range(1200) if i % 12 == 5 and i % 5 < 2]  # 40 % of a cluster
    stored.delete(frame(spark, x[dead], dead), path)
    assert stored.compact(spark, path, churn=0.6) == 0
    n = stored.compact(spark, path, churn=0.3, max_rows=100)
    assert 0 < n <= 4 and all(m.dead == 0 for m in stored.lines(spark, path) if m.gens and max(m.gens) > 0)
    left = np.array(sorted(set(range(1200)) - set(dead)))
    assert shown(stored.search(asked(spark, x[[5]]), path, 7)) == {0: best(x[left], left, x[5], 7)}


def test_growth_splits_a_cell_at_compaction(spark, tmp_path):
    path = str(tmp_path / "g")
    x = clustered(60, clusters=2)
    stored.build(frame(spark, x), path, max_rows=50, pivots=2)
    more = clustered(300, clusters=2)
    stored.insert(frame(spark, more, range(100, 400)), path)
    assert stored.compact(spark, path, max_rows=50) >= 1 and max(m.n for m in stored.lines(spark, path)) <= 100
    ids, now = np.r_[np.arange(60), np.arange(100, 400)], np.concatenate([x, more])
    assert shown(stored.search(asked(spark, more[:3]), path, 6)) == {i: best(now, ids, v, 6) for i, v in enumerate(more[:3])}


def test_no_rows_no_index_and_all_deleted(spark, tmp_path):
    path = str(tmp_path / "e")
    x = clustered(20)
    none = frame(spark, x).limit(0)
    stored.build(none, path)
    assert stored.version(spark, path) == -1 and stored.search(asked(spark, x), path, 3).hits.count() == 0
    stored.insert(frame(spark, x), path)
    with pytest.raises(ValueError):
        stored.build(frame(spark, x), path)
    stored.delete(frame(spark, x[:2], [90, 91]), path)
    assert stored.version(spark, path) == 0
    stored.delete(frame(spark, x), path)
    assert stored.search(asked(spark, x), path, 3).hits.count() == 0
    assert stored.compact(spark, path) > 0 and stored.search(asked(spark, x), path, 3).hits.count() == 0
    stored.insert(frame(spark, x[:4]), path)
    assert shown(stored.search(asked(spark, x[:1]), path, 2)) == {0: best(x[:4], np.arange(4), x[0], 2)}


def test_parts_that_a_wanted_recall_takes(spark, tmp_path):
    x = np.random.RandomState(8).normal(size=(2000, 32))  # of one place, so that neighbours lie in many parts
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    path = str(tmp_path / "index")
    stored.build(df, path)
    asked = df.where("id % 10 = 0").selectExpr("id AS qid", "v AS qv")
    true = {(int(i), int(j)) for i in range(0, 2000, 10) for j in np.argsort(((x - x[i]) ** 2).sum(1))[:5]}

    def share(**how):
        return len(true & {(r.qid, r.id) for r in stored.search(asked, path, 5, **how).hits.collect()}) / len(true)

    assert share(probes=4) < 0.7 and share(probes=4, recall=0.9) >= 0.85
