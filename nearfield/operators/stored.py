"""Vectors stored by cells: a search reads the parts that its queries can need, and a change writes those that it touches.

Under a folder, rows/gen=G/c=C/s=S has the rows that change G put into part S of cell C, dead/gen=G/c=C/s=S names rows that it
deleted, by their own gen and id, and manifest/v=G has a line for each part: its gens, rows, dead ones, least and largest
distance to the pivot. The latest manifest that is complete is the index; what a broken change left is named by none and written
over by the next. One writer at a time.

A search is the exact one of cells.py: parts are chosen when queries are planned, so that others aren't even listed. `probes` visits at
most so many parts a query instead, those with the nearest ends. An insert replaces rows of its ids. A part that has lost a share of
its rows, or has grown to twice the size, is dealt anew with its cell by compact().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import cells
from nearfield.operators.cells import MAX_ROWS, Cells
from nearfield.plans.session import kept

LINE = "c int, s int, pivot array<double>, gens array<int>, dead_gens array<int>, n long, dead long, near double, far double"
#: The share of a cell's rows that are dead when it is written anew; queries by which it is seen how many parts a recall takes.
CHURN, SAMPLE = 0.3, 128


@dataclass(frozen=True)
class Found:
    """hits: qid, id, dist, rank; read: rows of the parts that were read; of: rows of the index; measured: one row."""

    hits: DataFrame
    read: int
    of: int
    measured: DataFrame


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, path: str) -> int:
    """The latest change; -1 where there is no index."""
    fs, at = _fs(spark, f"{path}/manifest")
    if not fs.exists(at):
        return -1
    done = [int(f.getPath().getName()[2:]) for f in fs.listStatus(at) if _fs(spark, f"{f.getPath().toString()}/_SUCCESS")[0].exists(_fs(spark, f"{f.getPath().toString()}/_SUCCESS")[1])]
    return max(done, default=-1)


def lines(spark: SparkSession, path: str) -> list:
    """The manifest: a line for each part."""
    v = version(spark, path)
    return spark.read.schema(LINE).parquet(f"{path}/manifest/v={v}").collect() if v >= 0 else []


def _parts(spark, path: str, kind: str, entries: list[tuple[int, int, int]], schema: str) -> DataFrame:
    """Rows of entries (gen, c, s), with these as columns."""
    if not entries:
        return spark.createDataFrame([], f"{schema}, gen int, c int, s int")
    folders = [f"{path}/{kind}/gen={g}/c={c}/s={s}" for g, c, s in entries]
    return spark.read.schema(f"{schema}, gen int, c int, s int").option("basePath", f"{path}/{kind}").parquet(*folders)


def live(spark: SparkSession, path: str, some: list, columns: str = "id long, v array<double>, d double") -> DataFrame:
    """Rows of the parts of manifest lines `some` that are not deleted, with gen, c, s."""
    rows = _parts(spark, path, "rows", [(g, m.c, m.s) for m in some for g in m.gens], columns)
    dead = _parts(spark, path, "dead", [(g, m.c, m.s) for m in some for g in m.dead_gens], "of int, id long")
    dead = dead.select(F.col("of").alias("gen"), "c", "s", "id").distinct()
    return rows.join(dead, ["gen", "c", "s", "id"], "left_anti") if any(m.dead_gens for m in some) else rows


def _cells(manifest: list) -> Cells | None:
    if not manifest:
        return None
    pivot = {m.c: m.pivot for m in manifest}
    at = {c: k for k, c in enumerate(sorted(pivot))}
    pivots = np.array([pivot[c] for c in sorted(pivot)])
    mean = pivots.mean(0)
    col = lambda name, t: np.array([getattr(m, name) for m in manifest], t)
    if list(at) != list(range(len(at))):
        raise ValueError("cells of a manifest are numbered from 0")
    shares = {c: 1 + max(m.s for m in manifest if m.c == c) for c in at}
    return Cells(mean, pivots - mean, col("c", np.int64), col("s", np.int64), col("n", np.int64) - col("dead", np.int64), col("near", float), col("far", float), shares)


def _write(rows: DataFrame, path: str, gen: int, old: list, pivots: np.ndarray) -> None:
    """rows (id, v, c, s, d) as change gen, beside the parts of the manifest lines `old`."""
    spark, folder = rows.sparkSession, f"{path}/rows/gen={gen}"
    rows.repartition("c", "s").sortWithinPartitions("c", "s", "d").select("id", "v", "d", "c", "s").write.mode("overwrite").partitionBy("c", "s").parquet(folder)
    added = spark.read.schema("id long, v array<double>, d double, c int, s int").parquet(folder).groupBy("c", "s").agg(F.count("*").alias("n"), F.min("d").alias("near"), F.max("d").alias("far")).collect()
    known = {(m.c, m.s): m for m in old}
    out = []
    for a in added:
        m = known.pop((a.c, a.s), None)
        pivot = m.pivot if m else pivots[a.c].tolist()
        near, far = (min(a.near, m.near), max(a.far, m.far)) if m else (a.near, a.far)
        out.append((a.c, a.s, pivot, [*m.gens, gen] if m else [gen], m.dead_gens if m else [], a.n + (m.n if m else 0), m.dead if m else 0, near, far))
    _manifest(spark, path, gen, [*out, *map(tuple, known.values())])


def _manifest(spark, path: str, gen: int, out: list[tuple]) -> None:
    spark.createDataFrame(out, LINE).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={gen}")


def build(x: DataFrame, path: str, max_rows: int = MAX_ROWS, pivots: int | None = None) -> None:
    """An index of x (id, v) in a folder that has none. Repeated ids are a mistake of the caller's."""
    if version(x.sparkSession, path) >= 0:
        raise ValueError(f"there is an index in {path}")
    rows, own = cells.dealt(x, max_rows, pivots)
    if own is not None:
        _write(rows, path, 0, [], own.pivots + own.mean)


def _assigned(x: DataFrame, own: Cells) -> DataFrame:
    """(id, v, c, s, d) of x (id, v): where rows go in an index that exists."""
    sent = x.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        cells_ = sent.value
        for batch in batches:
            c, d = cells_.nearest(cells._moved(batch.column(1), cells_.mean))
            s = batch.column(2).to_numpy() % np.array([cells_.parts[k] for k in range(len(cells_.pivots))])[c]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c, pa.int32()), pa.array(s, pa.int32()), pa.array(d)], names=["id", "v", "c", "s", "d"])

    rows = cells._table(x, "id", "v").withColumn("h", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 31)))
    return rows.mapInArrow(run, "id long, v array<double>, c int, s int, d double")


def insert(x: DataFrame, path: str) -> None:
    """Rows x (id, v) come in; rows that have an id of x go, those of x that stand repeatedly count once. Files of parts that none
    of both touches stay as they are."""
    spark = x.sparkSession
    x = kept(x.where("v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")))
    if version(spark, path) < 0:
        return build(x, path)
    delete(x.select("id"), path)
    manifest = lines(spark, path)
    own = _cells(manifest)
    _write(_assigned(x, own), path, version(spark, path) + 1, manifest, own.pivots + own.mean)


def delete(ids: DataFrame, path: str) -> None:
    """Rows of these ids are named dead in the parts that have them; no other file is written."""
    spark, gen = ids.sparkSession, version(ids.sparkSession, path) + 1
    manifest = lines(spark, path)
    if not manifest:
        return
    hit = live(spark, path, manifest, "id long").join(ids.select("id").distinct(), "id", "left_semi").select(F.col("gen").alias("of"), "id", "c", "s")
    folder = f"{path}/dead/gen={gen}"
    hit.repartition("c", "s").write.mode("overwrite").partitionBy("c", "s").parquet(folder)
    fs, at = _fs(spark, folder)
    if not any(f.isDirectory() for f in fs.listStatus(at)):
        return
    gone = {(r.c, r.s): r.n for r in spark.read.schema("of int, id long, c int, s int").parquet(folder).groupBy("c", "s").agg(F.count("*").alias("n")).collect()}
    out = []
    for m in manifest:
        n = gone.get((m.c, m.s), 0)
        out.append((m.c, m.s, m.pivot, m.gens, [*m.dead_gens, gen] if n else m.dead_gens, m.n, m.dead + n, m.near, m.far))
    _manifest(spark, path, gen, out)


def compact(spark: SparkSession, path: str, churn: float = CHURN, max_rows: int = MAX_ROWS) -> int:
    """Writes the cells anew that have a share of dead rows of at least `churn`, or a part of over twice max_rows; returns their number."""
    manifest, gen = lines(spark, path), version(spark, path) + 1
    by: dict[int, list] = {}
    for m in manifest:
        by.setdefault(m.c, []).append(m)
    worn = {c for c, ms in by.items() if sum(m.dead for m in ms) >= churn * max(1, sum(m.n for m in ms)) or any(m.n - m.dead > 2 * max_rows for m in ms)}
    if not worn:
        return 0
    some = [m for m in manifest if m.c in worn]
    shares = {c: max(1, -(-sum(m.n - m.dead for m in by[c]) // max_rows)) for c in worn}
    share = F.element_at(F.create_map(*(F.lit(v) for kv in shares.items() for v in kv)), F.col("c"))
    rows = live(spark, path, some).select("id", "v", "c", F.pmod(F.xxhash64("id", "v"), share).cast("int").alias("s"), "d")
    own = _cells(manifest)
    # A cell that has lost all its rows keeps a line, so that its number and pivot stay.
    empty = [(c, 0, by[c][0].pivot, [], [], 0, 0, 0.0, 0.0) for c in worn if not sum(m.n - m.dead for m in by[c])]
    others = [m for m in manifest if m.c not in worn]
    if len(empty) < len(worn):
        _write(rows, path, gen, others, own.pivots + own.mean)
        _manifest(spark, path, gen, [*(tuple(m) for m in lines(spark, path)), *empty]) if empty else None
    else:
        _manifest(spark, path, gen, [*map(tuple, others), *empty])
    return len(worn)


def search(queries: DataFrame, path: str, k: int, probes: int | None = None, recall: float = 0.0) -> Found:
    """The k nearest of the index for each of queries (qid, qv). probes with a recall: at least so many parts a query, and as many more
    as have that share of the nearest of SAMPLE queries, whose exact search isn't counted in `measured`."""
    spark = queries.sparkSession
    manifest = lines(spark, path)
    at = {(m.c, m.s): m for m in manifest if m.n > m.dead}
    own, read = _cells(manifest), set()
    if own is None or not at:
        none = cells.search(lambda parts: None, None, queries, k)
        return Found(none.hits.withColumn("rank", F.lit(0)), 0, 0, none.measured)

    def rows_of(parts) -> DataFrame:
        some = [at[p] for p in parts if p in at]
        read.update((m.c, m.s) for m in some)
        return live(spark, path, some).select("id", "v", "c", "s", "d")

    joined = cells.search(rows_of, own, queries, k) if probes is None else _probed(rows_of, own, queries, k, _enough(rows_of, own, queries, k, probes, recall) if recall else probes)
    return Found(joined.hits, sum(at[p].n for p in read), sum(m.n for m in manifest), joined.measured)


def _nearest_parts(own: Cells, x: np.ndarray) -> np.ndarray:
    """The parts for each moved vector, those of the nearest pivots first and those without a row last."""
    lo = own.distances(x)[0][:, own.cell]
    lo[:, own.rows <= 0] = np.inf
    return np.argsort(lo, axis=1, kind="stable")


def _enough(rows_of, own: Cells, queries: DataFrame, k: int, probes: int, recall: float) -> int:
    """`probes`, or the least number of nearest parts that have a share `recall` of the k nearest of SAMPLE queries, if that is more."""
    some = kept(queries.where("qv IS NOT NULL").orderBy(F.xxhash64("qid"), "qid").limit(SAMPLE))
    met: set = set()

    def noted(parts) -> DataFrame:
        met.update(parts)
        return rows_of(parts)

    hits = kept(cells.search(noted, own, some, k).hits)
    at = hits.join(rows_of(met).select("id", "c", "s"), "id").select("qid", "c", "s").collect()  # k for each of SAMPLE queries
    if not at:
        return probes
    own, _ = cells.grouped(own, 0)
    places = cells._places(own)
    rank = {r.qid: np.argsort(_nearest_parts(own, np.array([r.qv], float) - own.mean)[0]) for r in some.collect()}
    ranks = sorted(int(rank[r.qid][places[r.c, r.s]]) for r in at)
    return max(probes, ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))] + 1)


def _probed(rows_of, own: Cells, queries: DataFrame, k: int, probes: int):
    spark = queries.sparkSession
    own, _ = cells.grouped(own, 0)
    sent = spark.sparkContext.broadcast(own)

    def near(batches):
        cells_ = sent.value
        for batch in batches:
            x = cells._moved(batch.column(1), cells_.mean)
            for s in range(0, len(x), cells_.at_once()):
                best = _nearest_parts(cells_, x[s : s + cells_.at_once()])[:, :probes]
                i, j = np.repeat(np.arange(s, s + len(best)), best.shape[1]), best.ravel().astype(np.int32)
                for a in range(0, len(i), cells.AT_ONCE):
                    at, to = pa.array(i[a : a + cells.AT_ONCE]), j[a : a + cells.AT_ONCE]
                    n = len(to)
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(n, np.int32)), pa.array(to), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.zeros(n)), pa.array(np.full(n, np.inf))], names=cells._NAMES)

    asked = kept(cells._table(queries, "qid", "qv").mapInArrow(near, cells._TO_GROUP))
    visited = [r.p for r in asked.select("p").distinct().collect()]  # a row for each part
    at = [(int(own.cell[p]), int(own.part[p]), p) for p in visited]
    rows = rows_of({(c, s) for c, s, _ in at}).join(F.broadcast(spark.createDataFrame(at, "c int, s int, k int")), ["c", "s"])
    rows = rows.select("k", F.lit(0).alias("kind"), F.col("k").alias("p"), "id", "v", "d", F.lit(0.0).alias("t"))
    out = cells._result(kept(cells._meet(rows.unionByName(asked), len(own.cell), sent, cells._second, k, "none")))
    return cells.Joined(cells.top(out.hits, k), out.measured)
