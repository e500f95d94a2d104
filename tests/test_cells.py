"""Joins by cells: equal to plain distances, fewer pairs than all on clustered rows, and odd tables."""

import numpy as np
import pytest

from nearfield.operators import cells, knn

R = np.random.RandomState(5)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


def queries(df):
    return df.selectExpr("id AS qid", "v AS qv")


def clustered(n, dim=8, clusters=12, far=30.0):
    centres = R.normal(size=(clusters, dim)) * far
    return centres[R.randint(0, clusters, n)] + R.normal(size=(n, dim))


def plain(x, q, k, exclude, ids=None, qids=None):
    ids, qids = np.arange(len(x)) if ids is None else ids, np.arange(len(q)) if qids is None else qids
    out = {}
    for i, v in zip(qids, q, strict=True):
        d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 9)
        keep = ids != i if exclude == "id" else d > 1e-9 if exclude == "zero" else np.ones(len(x), bool)
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[int(i)] = list(zip(ids[keep][order].tolist(), d[keep][order].tolist(), strict=True))
    return out


def shown(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append((r.id, r.dist))
    return out


@pytest.mark.parametrize("exclude", ["none", "id", "zero"])
@pytest.mark.parametrize(("max_rows", "pivots", "visits"), [(20_000, None, 200_000), (20, 30, 7)])
def test_nearest_equals_plain_distances(spark, exclude, max_rows, pivots, visits):
    x = np.concatenate([clustered(500), np.repeat(clustered(2), 40, 0)])
    df = frame(spark, x)
    got = cells.nearest(df, queries(df), 5, exclude, max_rows, pivots, visits)
    assert shown(got.hits) == plain(x, x, 5, exclude)


def test_fewer_than_half_the_pairs_of_clustered_rows(spark):
    x = clustered(3000)
    df = frame(spark, x)
    got = cells.nearest(df, queries(df), 10, "id", max_rows=500)
    assert got.hits.count() == 30_000 and got.measured.first().measured < 0.2 * 3000**2
    near = cells.within(df, queries(df), 1.5, max_rows=500)
    want = sum(int((np.sqrt(((x - v) ** 2).sum(1)) <= 1.5).sum()) - 1 for v in x)
    assert near.hits.count() == want > 1000 and near.measured.first().measured < 0.2 * 3000**2


def test_queries_that_are_not_in_the_corpus(spark):
    x, q = clustered(400) + 1e6, clustered(50) + 1e6
    df, qs = frame(spark, x), frame(spark, q, 1000)
    got = cells.nearest(df, queries(qs), 7, max_rows=30, pivots=10)
    want = plain(x, q, 7, "none", qids=np.arange(1000, 1050))
    assert {k: [i for i, _ in v] for k, v in shown(got.hits).items()} == {k: [i for i, _ in v] for k, v in want.items()}
    near = cells.within(df, queries(qs), 40.0, max_rows=30, pivots=10).hits
    assert {(r.qid, r.id) for r in near.collect()} == {(1000 + a, b) for a, v in enumerate(q) for b in np.flatnonzero(np.round(np.sqrt(((x - v) ** 2).sum(1)), 9) <= 40.0).tolist()}


def test_more_neighbours_than_rows_nulls_and_empty_tables(spark):
    df = frame(spark, [[1.0, 2.0], [1.0, 2.0], None, [3.0, 4.0]])
    got = cells.nearest(df, queries(df), 9, "id")
    assert {k: [i for i, _ in v] for k, v in shown(got.hits).items()} == {0: [1, 3], 1: [0, 3], 3: [0, 1]}
    none = df.where("id < 0")
    assert not cells.nearest(none, queries(df), 3).hits.count() and not cells.nearest(df, queries(none), 3).hits.count()
    assert cells.within(none, queries(df), 1.0).measured.first().measured == 0 and not cells.within(df, queries(none), 1.0).hits.count()
    assert cells.within(df, queries(df), 0.0).hits.count() == 0


def test_a_part_is_copied_for_its_visits_only(spark):
    df = frame(spark, clustered(300, clusters=1))
    rows, own = cells.dealt(df, 50, 4)
    assert int(own.rows.sum()) == 300 and max(own.rows) < 120
    got = cells.nearest(df, queries(df), 3, "id", 50, 4, visits=1000)
    assert got.measured.first().measured <= 300**2


def test_neighbours_by_cells_equal_those_of_one_scan(spark):
    df = frame(spark, clustered(200))
    assert shown(cells.neighbours(df, queries(df), 4, "id", few=10)) == shown(knn.nearest(df, queries(df), 4, exclude="id"))


def test_a_query_is_sent_to_a_group_once_where_no_bound_helps(spark, monkeypatch):
    x = R.normal(size=(1500, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    df, sent, meet = frame(spark, x), [], cells._meet
    monkeypatch.setattr(cells, "_meet", lambda rows, *more: (sent.append(rows.where("kind = 1").count()), meet(rows, *more))[1])
    assert shown(cells.nearest(df, queries(df), 5, "id", max_rows=500).hits) == plain(x, x, 5, "id")
    assert sum(sent) <= 8 * len(x)  # of about 75 parts


@pytest.mark.parametrize(("max_rows", "pivots", "visits"), [(20_000, None, 200_000), (60, 30, 200_000), (20, 30, 7)])
def test_a_range_join_of_a_table_with_itself_has_each_pair_both_ways(spark, monkeypatch, max_rows, pivots, visits):
    monkeypatch.setattr(cells, "FEW_VISITS", 50)
    monkeypatch.setattr(cells, "ONE_WAY", 3)
    monkeypatch.setattr(cells, "HITS_AT_ONCE", 100)
    x = np.concatenate([clustered(400), np.repeat(clustered(2), 40, 0), clustered(60) + 1e6, clustered(100, clusters=1)])
    ids = [i % 500 for i in range(len(x))]  # some stand twice
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in zip(ids, x, strict=True)] + [(9999, None)], "id long, v array<double>").repartition(3)
    got = cells.within_itself(df, 3.0, max_rows, pivots, visits)
    dist = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = sorted((ids[a], ids[b], dist[a, b]) for a, b in zip(*np.nonzero((dist > 1e-9) & (dist <= 3.0)), strict=True))
    assert len(want) > 1000 and sorted((r.qid, r.id, r.dist) for r in got.hits.collect()) == want
    both = cells.within(df, queries(df), 3.0, max_rows, pivots, visits)
    assert sorted((r.qid, r.id, r.dist) for r in both.hits.collect()) == want
    assert not cells.within_itself(df.where("id < 0"), 1.0).hits.count() and not cells.within_itself(df, 0.0).hits.count()


def around_places(n, places=10, dim=64):
    """Rows like those of the query range_join_clustered: about 1.4 apart, 70 from those of another place."""
    x = R.normal(size=(n, dim))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[np.arange(n), np.arange(n) % places] += 50
    return x


def test_groups_are_cut_between_clusters(spark):
    x = around_places(3000)
    rows, own = cells.dealt(frame(spark, x), 400)
    own, starts = cells.grouped(own, 400)
    place = (own.pivots + own.mean)[own.cell, :10].argmax(1)
    groups = np.searchsorted(starts, np.arange(len(place)), "right") - 1
    assert len(set(zip(place.tolist(), groups.tolist(), strict=True))) == len(starts) == 10
    assert np.add.reduceat(own.rows, starts).max() <= 400


def test_a_range_join_of_a_table_with_itself_sends_measures_and_writes_little(spark, monkeypatch, tmp_path):
    from nearfield.plans import catalog

    x = around_places(6000)
    x[np.arange(6000), np.arange(6000) % 10] -= 50
    spark.createDataFrame([(i, [float(a) for a in v], i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sent, meet, grouped = [], cells._meet, cells.grouped
    monkeypatch.setattr(cells, "grouped", lambda own, size: grouped(own, 500))
    monkeypatch.setattr(cells, "_meet", lambda rows, *more: (sent.append(rows.where("kind = 1").count()), meet(rows, *more))[1])
    catalog.range_join_clustered(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert sum(sent) < 2 * len(x)  # of 12 groups or more, of which two or three hold a place's rows
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert n > 100_000 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 8 * n
    itself = cells.within_itself(frame(spark, x), 1.3).measured.first().measured
    assert itself < 0.65 * cells.within(frame(spark, x), queries(frame(spark, x)), 1.3).measured.first().measured
