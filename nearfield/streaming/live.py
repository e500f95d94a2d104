"""Streams: running statistics for each signal, and inserts and deletes that follow a stream of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from nearfield.operators import graph_index, stored
from nearfield.operators.signals import WARM


def _after(n: int, mean: float, m2: float, x: float, alpha: float | None) -> tuple[int, float, float]:
    n, d = n + 1, x - mean
    if alpha and n > WARM:
        return n, mean + alpha * d, (1 - alpha) * (m2 + alpha * d * d)
    mean += d / n
    return n, mean, m2 + d * (x - mean)


def _shown(name, n: int, mean: float, m2: float, alpha: float | None) -> pd.DataFrame:
    var = m2 if alpha and n > WARM else m2 / (n - 1) if n > 1 else 1.0
    return pd.DataFrame({"name": [name], "n": [n], "mean": [mean], "std": [math.sqrt(max(1e-6, var))]})


def running_stats(stream: DataFrame, alpha: float | None = None) -> DataFrame:
    """name, n, mean, std after each batch, from rows (name, seq, x); alpha: exponential updates after ten values. Within a batch rows
    count in the order of seq; a row that comes in a later batch counts then, whatever its seq is, which changes nothing but
    exponential updates. A batch's rows of one name are taken in parts, each put in order for itself."""

    def update(key, frames: Iterator[pd.DataFrame], state):
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for x in (x for frame in frames for x in frame.sort_values("seq").x):
            n, mean, m2 = _after(n, mean, m2, x, alpha)
        state.update((n, mean, m2))
        yield _shown(key[0], n, mean, m2, alpha)

    return stream.groupBy("name").applyInPandasWithState(update, "name string, n long, mean double, std double", "n long, mean double, m2 double", "update", "NoTimeout")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Holds a name's rows until the watermark has passed them, then takes them in the order of (ts, seq)."""

    def __init__(self, alpha: float | None):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, seq long, x double")
        self.sums = handle.getValueState("sums", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            at = frame.ts.astype("datetime64[us]").astype("int64")
            self.held.appendList(list(zip(at.tolist(), frame.seq.tolist(), frame.x.tolist(), strict=True)))
            for ms in (at // 1000 + 1).unique().tolist():  # a timer of a time that is set already is one timer
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = list(self.held.get())
        now = sorted(r for r in held if r[0] < done)
        if not now:
            return
        later = [r for r in held if r[0] >= done]
        self.held.put(later) if later else self.held.clear()
        n, mean, m2 = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0)
        for _, _, x in now:
            n, mean, m2 = _after(n, mean, m2, x, self.alpha)
        self.sums.update((n, mean, m2))
        yield _shown(key[0], n, mean, m2, self.alpha)

    def close(self) -> None:
        pass


def running_stats_in_order(stream: DataFrame, delay: str, alpha: float | None = None) -> DataFrame:
    """name, n, mean, std from rows (name, ts, seq, x), which count in the order of (ts, seq) whatever their arrival: each is held until
    the watermark, `delay` behind the latest ts, has passed it. Rows that come later than that are dropped by Spark. What a name
    holds is its rows of the last `delay`. The session's state store has to be RocksDB's."""
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")
    rows = stream.select("name", "ts", "seq", "x").withWatermark("ts", delay)
    return rows.groupBy("name").transformWithStateInPandas(_InOrder(alpha), "name string, n long, mean double, std double", "update", "EventTime")


def follow_stored(stream: DataFrame, path: str, checkpoint: str, churn: float = stored.CHURN):
    """A started query: each batch of rows (id, v, op), op insert or delete, changes the stored index under path, of which only the
    parts that it touches are written; cells that have lost a share `churn` of their rows are written anew. A batch that runs again
    replaces its own rows."""

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        stored.insert(batch.where("op = 'insert'").select("id", "v"), path)
        stored.delete(batch.where("op = 'delete'").select("id"), path)
        batch.unpersist()
        stored.compact(batch.sparkSession, path, churn)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def follow(stream: DataFrame, path: str, checkpoint: str, config: graph_index.GraphConfig = graph_index.GraphConfig(), keep: int = 2):
    """A started query: each batch of rows (id, v, op), op insert or delete, makes a new version of the index under path, from the one
    before; the `keep` last versions stay. A batch that runs again makes the same version again."""

    def apply(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        old = spark.read.schema(graph_index.SCHEMA).parquet(f"{path}/v{version - 1}") if version else spark.createDataFrame([], graph_index.SCHEMA)
        index = graph_index.insert(old, batch.where("op = 'insert'").select("id", "v"), config)
        graph_index.delete(index, batch.where("op = 'delete'").select("id")).write.mode("overwrite").parquet(f"{path}/v{version}")
        batch.unpersist()
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{version - keep}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
