import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.vectors import checked
from nearfield.operators import graph_index, text
from nearfield.operators.policy import Policy
from nearfield.operators.text import TOKEN, seed_of, seeds_of
from nearfield.sources import datasets, generators, vecs
from nearfield.streaming import live


def test_trailing_partial_record_and_empty_file(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    data = b"".join(np.int32(4).tobytes() + r.tobytes() for r in x)
    (tmp_path / "a.fvecs").write_bytes(data + b"\4\0\0")
    (tmp_path / "b.fvecs").write_bytes(b"")
    got = vecs.read_fvecs(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.v for r in got] == x.tolist()
    assert vecs.read_fvecs(spark, str(tmp_path), 2).count() == 2


def test_a_file_is_read_in_ranges_that_end_at_records(spark, tmp_path):
    x = np.random.RandomState(0).normal(size=(1000, 7)).astype("<f4")
    path = str(tmp_path / "x.fvecs")
    (tmp_path / "x.fvecs").write_bytes(b"".join(np.int32(7).tobytes() + r.tobytes() for r in x) + b"\7\0\0\0abc")
    for split in (1, 31, 1000, 32_000, 1 << 20):
        df = vecs.read_fvecs(spark, path, split=max(split, 200))
        got = sorted((r.pos, r.v) for r in df.collect())
        assert [p for p, _ in got] == list(range(1000)) and np.array([v for _, v in got], "<f4").tobytes() == x.tobytes()
    assert vecs.read_fvecs(spark, path, split=1000).rdd.getNumPartitions() == 33
    few = vecs.read_fvecs(spark, path, 100, split=1000)
    assert few.count() == 100 and few.rdd.getNumPartitions() == 4
    assert vecs.read_fvecs(spark, path, 5000).count() == 1000 and vecs.read_fvecs(spark, path, 0).count() == 0
    (tmp_path / "bad").write_bytes(np.array([2, 1, 1, 3, 1, 1], "<i4").tobytes())
    with pytest.raises(Exception, match="different lengths"):
        vecs.read_ivecs(spark, str(tmp_path / "bad")).collect()


def test_a_rewrite_leaves_no_old_files_and_a_failure_leaves_what_was(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda n: spark.range(n).selectExpr("id", "array(float(id), float(2 * id)) AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        vecs.write_fvecs(rows(100), path)
        assert len(list((tmp_path / "out").glob("part-*"))) > 1
        got = vecs.read_fvecs(spark, path)
        assert sorted(r.v[0] for r in got.collect()) == list(range(100))
        with pytest.raises(Exception, match="there are files"):
            vecs.write_fvecs(rows(3), path)
        with pytest.raises(Exception):
            vecs.write_fvecs(rows(100).selectExpr("id", "if(id = 70, array(1F), v) AS v"), path, overwrite=True)
        assert vecs.read_fvecs(spark, path).count() == 100 and not list((tmp_path / "out").glob("_*"))
        vecs.write_fvecs(rows(3).selectExpr("id", "if(id = 1, null, v) AS v"), path, overwrite=True)
        assert sorted(r.v[0] for r in vecs.read_fvecs(spark, path).collect()) == [0.0, 2.0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    vecs.write_ivecs(rows(0).selectExpr("id AS qid", "array(1) AS v"), str(tmp_path / "none"))
    assert vecs.read_ivecs(spark, str(tmp_path / "none")).count() == 0


def test_generators_do_not_depend_on_partitions(spark):
    a = generators.multi_manifold(spark, 50, 16).collect()
    assert sorted(a) == sorted(generators.multi_manifold(spark, 50, 16).repartition(7).collect())
    with pytest.raises(ValueError):
        generators.multi_manifold(spark, 5, 4)


def test_wrong_dimension_is_an_error(spark):
    with pytest.raises(Exception, match="needs 3 values"):
        spark.createDataFrame([([1.0],)], "v array<double>").select(checked(F.col("v"), 3)).collect()


def test_unknown_policy_and_metric():
    with pytest.raises(ValueError):
        Policy("budget")
    with pytest.raises(ValueError):
        graph_index.GraphConfig(metric="dot")


def test_equal_prefixes_share_a_seed():
    assert seed_of("abcdefgh") == seed_of("abcdefzz") != seed_of("abcdez") and TOKEN


def test_embeddings_equal_sums_written_out(spark):
    texts = ["one two two", "", None, "Ünï one-two a_b 9", "abcdefgh abcdefzz x"] + [f"w{i} w{i % 7}" for i in range(450)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(2)
    for r in text.embedded(rows, "id", "text", 16).collect():
        v = np.zeros(16)
        for w in re.findall(TOKEN, (texts[r.id] or "").lower()):
            v += np.random.RandomState(seed_of(w)).normal(size=16)
        assert np.allclose(r.v, v / np.linalg.norm(v) if v.any() else v, atol=1e-12)


def test_running_stats_stream(spark, tmp_path):
    rows = [("a", i, float(i * i % 7)) for i in range(30)] + [("b", 0, 5.0)]
    spark.createDataFrame(rows, "name string, seq long, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, seq long, x double").parquet(str(tmp_path / "in"))
    q = live.running_stats(stream).writeStream.outputMode("update").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.name: r for r in spark.sql("SELECT * FROM running").collect()}
    x = np.array([r[2] for r in rows[:30]])
    assert got["a"].n == 30 and abs(got["a"]["mean"] - x.mean()) < 1e-9 and abs(got["a"]["std"] - x.std(ddof=1)) < 1e-9 and got["b"]["std"] == 1.0


def test_index_follows_a_stream(spark, tmp_path):
    r = np.random.RandomState(1)
    rows = [(i, r.normal(size=4).tolist(), "insert") for i in range(40)] + [(3, None, "delete")]
    spark.createDataFrame(rows, "id long, v array<double>, op string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v array<double>, op string").parquet(str(tmp_path / "in"))
    q = live.follow(stream, str(tmp_path / "index"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    index = spark.read.schema(graph_index.SCHEMA).parquet(str(tmp_path / "index/v0"))
    assert index.count() == 40 and [x.id for x in index.where("deleted").collect()] == [3]
    more = graph_index.insert(index, spark.createDataFrame([(100, [0.0] * 4), (5, [0.0] * 4)], "id long, v array<double>"))
    assert more.count() == 41


def test_data_sets_by_name(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>")
    datasets.write_text_vectors(rows.withColumnRenamed("id", "word"), str(tmp_path / "words.txt"))
    rows.write.parquet(str(tmp_path / "table.parquet"))
    vecs.write_fvecs(rows, str(tmp_path / "file.fvecs"))
    for name in ("words", "table", "file"):
        assert sorted(r.v for r in datasets.resolve(spark, name, str(tmp_path)).collect()) == [[float(i), 1.0] for i in range(5)]
    assert datasets.resolve(spark, "multi_cluster", n=20, dim=3).count() == 20
    for wrong in (("nothing", str(tmp_path)), ("nothing", None)):
        with pytest.raises(ValueError):
            datasets.resolve(spark, *wrong)
    with pytest.raises(Exception, match="needs 3 values"):
        datasets.read_text_vectors(spark, str(tmp_path / "words.txt"), 3).collect()
    got = datasets.checksums(spark, str(tmp_path / "file.fvecs")).collect()
    assert sum(r["size"] for r in got) == 5 * 12 and all(len(r.md5) == 32 for r in got)


def test_a_stream_in_event_order_equals_the_batch(spark, tmp_path):
    rng = np.random.RandomState(6)
    rows = [(f"n{i % 3}", 1_700_000_000.0 + i, i, float(rng.normal(i % 11, 2))) for i in range(600)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 50))  # up to 50 seconds late
    folder = tmp_path / "in"
    for k in range(6):
        part = arrival[k * 100 : (k + 1) * 100]
        spark.createDataFrame(part, "name string, at double, seq long, x double").selectExpr("name", "timestamp_millis(bigint(at * 1000)) AS ts", "seq", "x").coalesce(1).write.parquet(str(folder / f"p{k}"))
    end = [("end", 1_700_009_000.0, 0, 0.0)]
    spark.createDataFrame(end, "name string, at double, seq long, x double").selectExpr("name", "timestamp_millis(bigint(at * 1000)) AS ts", "seq", "x").coalesce(1).write.parquet(str(folder / "p9"))
    stream = spark.readStream.schema("name string, ts timestamp, seq long, x double").option("maxFilesPerTrigger", 1).parquet(str(folder / "p*"))
    with pytest.raises(ValueError, match="RocksDB"):
        live.running_stats_in_order(stream, "60 seconds")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    try:
        out = live.running_stats_in_order(stream, "60 seconds", 0.05)
        query = out.writeStream.outputMode("update").format("memory").queryName("in_order").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for r in spark.table("in_order").collect():
        if r.n > got.get(r.name, (0,))[0]:
            got[r.name] = (r.n, r["mean"], r["std"])
    for name in ("n0", "n1", "n2"):
        n, mean, m2 = 0, 0.0, 0.0
        for x in (r[3] for r in rows if r[0] == name):
            n, mean, m2 = live._after(n, mean, m2, x, 0.05)
        assert got[name][0] == n == 200 and np.allclose(got[name][1:], (mean, m2**0.5), rtol=1e-12)


def test_a_stored_index_follows_a_stream(spark, tmp_path):
    from nearfield.operators import stored

    x = np.random.RandomState(3).normal(size=(120, 4))
    batches = [[(i, x[i].tolist(), "insert") for i in range(100)], [(i, x[i].tolist(), "insert") for i in range(100, 120)] + [(5, (x[5] + 9).tolist(), "insert")], [(i, None, "delete") for i in range(0, 120, 2)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, v array<double>, op string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        stream = spark.readStream.schema("id long, v array<double>, op string").parquet(str(tmp_path / "in" / "b*"))
        query = live.follow_stored(stream, str(tmp_path / "index"), str(tmp_path / "check"))
        query.processAllAvailable()
        query.stop()
    left = [i for i in range(1, 120, 2)]
    now = x.copy()
    now[5] += 9
    asked = spark.createDataFrame([(0, x[5].tolist()), (1, now[5].tolist())], "qid long, qv array<double>")
    got = {}
    for r in stored.search(asked, str(tmp_path / "index"), 4).hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    want = {q: [left[j] for j in np.argsort(((now[left] - v) ** 2).sum(1))[:4]] for q, v in ((0, x[5]), (1, now[5]))}
    assert got == want
    by = {}
    for m in stored.lines(spark, str(tmp_path / "index")):
        n, dead = by.get(m.c, (0, 0))
        by[m.c] = n + m.n, dead + m.dead
    assert all(dead < stored.CHURN * max(1, n) for n, dead in by.values())  # half the rows went, so cells were written anew


def test_seeds_are_made_once_for_each_start(monkeypatch):
    """Before, the seed of each token was made anew at each of its places."""
    from collections import Counter

    tokens = ["abcdefgh", "der", "abcdefzz", "", "der", "abcdez"] * 50
    want, made = Counter(map(seed_of, tokens)), []
    monkeypatch.setattr(text, "seed_of", lambda t: (made.append(t), seed_of(t))[1])
    known = {}
    assert seeds_of(tokens, known) == want and seeds_of(tokens, known) == want and sorted(made) == ["", "abcdef", "abcdez", "der"]
    monkeypatch.setattr(text, "MEMO", 2)
    assert seeds_of(tokens, {}) == want
