"""Local geometry from neighbour distances, and running statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from nearfield.operators import evaluate, knn
from nearfield.plans.session import kept

TINY = 1e-9


def lid_of(dists: Column, k: int | None = None) -> Column:
    """Maximum-likelihood intrinsic dimension of an array of distances: 2 below three positive ones; within 1 and 1000."""
    d = F.array_sort(F.filter(dists, lambda x: x > TINY))
    d = F.slice(d, 1, k) if k else d
    n = F.size(d)
    logs = F.aggregate(F.slice(d, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, x: s + F.ln(F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), x / F.element_at(d, -1)))))
    return F.when(n < 3, 2.0).when(F.abs(logs) < TINY, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), -(n - 1) / logs)))


def neighbour_signals(near: DataFrame, k: int | None = None) -> DataFrame:
    """qid, density (mean distance; 1 without neighbours), lid. near: qid, dist."""
    return near.groupBy("qid").agg(F.coalesce(F.avg("dist"), F.lit(1.0)).alias("density"), F.collect_list("dist").alias("d")).select("qid", "density", lid_of(F.col("d"), k).alias("lid"))


def variance(df: DataFrame, by: str) -> DataFrame:
    """by, variance: the mean squared distance to the group's centroid, a sum over dimensions; df has v."""
    return df.select(by, F.posexplode("v").alias("dim", "x")).groupBy(by, "dim").agg(F.var_pop("x").alias("s")).groupBy(by).agg(F.sum("s").alias("variance"))


#: Rows of a sample.
SAMPLE = 500


def sample(x: DataFrame, size: int = SAMPLE, by: str | None = None) -> DataFrame:
    """The `size` rows of x (id, ...) that come first by a hash of the id, of each group if `by` is given: a sample without
    replacement that depends on no order or partition. Samples merge by taking the first rows of both, which is how tasks and
    shuffles make it: none passes on more than `size` rows of a group."""
    order = [F.md5(F.concat(F.col("id").cast("string"), F.lit(":sample"))), F.col("id")]
    if by is None:
        return x.orderBy(*order).limit(size)
    return x.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= size).drop("__r")


def by_sample(x: DataFrame, few: DataFrame, k: int, use: int | None = None, metric: str = "l2") -> DataFrame:
    """qid, density, lid of each row of x (id, v) from its k nearest others in `few`, a sample, which is broadcast: no shuffle."""
    near = knn.nearest_of_few(few, x.select(F.col("id").alias("qid"), F.col("v").alias("qv")), k, metric, "id")
    mean = F.aggregate("dists", F.lit(0.0), lambda s, d: s + d) / F.size("dists")
    return near.select("qid", F.when(F.size("dists") > 0, mean).otherwise(1.0).alias("density"), lid_of(F.col("dists"), use).alias("lid"))


def sampled_profile(few: DataFrame, k: int, use: int | None = None, metric: str = "l2") -> DataFrame:
    """The profile of a sample's rows among themselves: one row, to be computed once and adopted for all that comes later."""
    return _profiled(by_sample(few, few, k, use, metric), lambda s, c, points: s.agg(*(F.percentile(c, F.lit(p)).alias(o) for o, p in points.items())))


def profile(signals: DataFrame) -> DataFrame:
    """One row: mean, population deviation (up to 1e-6 counts as 1) and quartiles of density and lid of any number of rows, quartiles by ranges."""
    return _profiled(kept(signals.select("density", "lid")), evaluate.percentiles_linear)


def _profiled(signals: DataFrame, percentiles) -> DataFrame:
    aggs, parts = [], []
    for c in ("density", "lid"):
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(sd <= 1e-6, 1.0).otherwise(sd).alias(f"{c}_std")]
        parts.append(percentiles(signals, c, {f"{c}_q{k}": k / 100 for k in (25, 50, 75)}))
    out = signals.agg(*aggs)
    for one in parts:
        out = out.crossJoin(one)  # one row each
    return out


def running(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with n, mean and std of the values so far in each key's order; std of one value is 1, and at least 0.001. By running sums
    over ranges of (key, order), so that a key of any size is shared out; about the mean of all, so that squares don't cancel."""
    centre = df.agg(F.avg(value).alias("__c"))
    x = F.col(value) - F.coalesce("__c", F.lit(0.0))
    rows = df.crossJoin(F.broadcast(centre)).withColumns({"__x": F.coalesce(x, F.lit(0.0)), "__xx": F.coalesce(x * x, F.lit(0.0)), "__one": F.col(value).isNotNull().cast("long")})  # centre is one row
    sums = evaluate.running(rows, [key], [order], {"__n": "__one", "__s": "__x", "__ss": "__xx"})
    upto = lambda before, own: F.coalesce(before, F.lit(0)) + F.col(own)
    sums = sums.withColumns({"n": upto("__n", "__one"), "__s": upto("__s", "__x"), "__ss": upto("__ss", "__xx")})
    n = F.col("n")
    var = F.when(n > 1, F.greatest(F.lit(0.0), F.col("__ss") - F.col("__s") * F.col("__s") / n) / (n - 1)).otherwise(1.0)
    return sums.select(*df.columns, "n", F.when(n > 0, F.coalesce("__c", F.lit(0.0)) + F.col("__s") / n).alias("mean"), F.sqrt(F.greatest(var, F.lit(1e-6))).alias("std"))


#: Values before exponential updates begin, and values whose updates are one array operation.
WARM, AT_ONCE = 10, 256


class Updates:
    """What exponential updates by one value after another do to mean and m2, as a map of both; maps of ranges that follow each
    other compose, so that a key's values may lie in any number of ranges.

    mean becomes shift + keep * (mean - shift) + add, and m2 becomes keep * m2 + q0 + q1 * (mean - shift) + q2 * (mean - shift)^2.
    """

    def __init__(self, n: int, keep: float, shift: float, add: float, q0: float, q1: float, q2: float):
        self.n, self.keep, self.shift, self.add, self.q0, self.q1, self.q2 = n, keep, shift, add, q0, q1, q2

    @classmethod
    def of(cls, x: np.ndarray, alpha: float) -> Updates:
        """x: up to AT_ONCE values; the shift is the first, so that squares don't cancel."""
        n, b, shift = len(x), 1 - alpha, float(x[0])
        powers = b ** np.arange(n + 1)
        x = x - shift
        back = np.subtract.outer(np.arange(n), np.arange(n))
        local = alpha * (np.where(back >= 0, powers[np.maximum(back, 0)], 0.0) @ x)  # the mean after each value, from 0
        e = x - np.r_[0.0, local[:-1]]
        w = b * alpha * powers[:n][::-1]
        return cls(n, float(powers[n]), shift, float(local[-1]), float(w @ (e * e)), float(-2 * (w @ (e * powers[:n]))), float(w @ powers[:n] ** 2))

    def then(self, o: Updates) -> Updates:
        t = self.add + self.shift - o.shift
        return Updates(
            self.n + o.n, self.keep * o.keep, self.shift, o.shift - self.shift + o.keep * t + o.add,
            o.keep * self.q0 + o.q0 + o.q1 * t + o.q2 * t * t, o.keep * self.q1 + o.q1 * self.keep + 2 * o.q2 * self.keep * t, o.keep * self.q2 + o.q2 * self.keep**2,
        )

    def on(self, mean: float, m2: float) -> tuple[float, float]:
        u = mean - self.shift
        return self.shift + self.keep * u + self.add, self.keep * m2 + self.q0 + self.q1 * u + self.q2 * u * u

    def row(self) -> tuple:
        return self.n, self.keep, self.shift, self.add, self.q0, self.q1, self.q2


class _Range:
    """Of a key's values in one range: the first ones as they are, and the updates by the rest."""

    def __init__(self):
        self.first, self.rest = [], None

    def add(self, x: np.ndarray, alpha: float) -> None:
        k = max(0, WARM - len(self.first))
        self.first += x[:k].tolist()
        for s in range(k, len(x), AT_ONCE):
            u = Updates.of(x[s : s + AT_ONCE], alpha)
            self.rest = self.rest.then(u) if self.rest else u


def _folded(ranges: list, alpha: float) -> tuple[int, float, float]:
    """n, mean and std after the values of ranges in order: Welford's update for the first ten, then exponential ones."""
    n, mean, m2 = 0, 0.0, 0.0
    for first, rest in ranges:
        for v in first:
            n += 1
            d = v - mean
            if n > WARM:
                mean += alpha * d
                m2 = (1 - alpha) * (m2 + alpha * d * d)
            else:
                mean += d / n
                m2 += d * (v - mean)
        if rest:
            u = Updates(*rest)
            n, (mean, m2) = n + u.n, u.on(mean, m2)
    var = m2 if n > WARM else m2 / (n - 1) if n > 1 else 1.0
    return n, mean, max(1e-6, var) ** 0.5


def running_ema(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.05) -> DataFrame:
    """key, n, mean, std: after ten values by Welford's update, exponential updates. Null values are left out. Rows are dealt into ranges
    of (key, order), whatever the size of a key; a range gives a row for each of its keys, and a key's rows are applied in order."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    kind = to_arrow_type(df.schema[key].dataType)
    names = ["keep", "shift", "add", "q0", "q1", "q2"]
    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("p", T.IntegerType()), T.StructField("first", T.ArrayType(T.DoubleType())), T.StructField("m", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)])

    def ranges(batches):
        now, held, p = None, None, TaskContext.get().partitionId()

        def out(done):
            rest = [r.rest.row() if r.rest else (None,) * 7 for _, r in done]
            cols = [pa.array([k for k, _ in done], kind), pa.array([p] * len(done), pa.int32()), pa.array([r.first for _, r in done], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array([r[c] for r in rest], pa.float64() if c else pa.int64()) for c in range(7))], names=["k", "p", "first", "m", *names])

        for batch in batches:
            keys, x, done = batch.column(0).to_pylist(), batch.column(2).to_numpy(), []
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                if held is None or keys[a] != now:
                    if held is not None:
                        done.append((now, held))
                    now, held = keys[a], _Range()
                held.add(x[a:b], alpha)
            if done:
                yield out(done)
        if held is not None:
            yield out([(now, held)])

    parts = rows.repartitionByRange("k", "o").sortWithinPartitions("k", "o").mapInArrow(ranges, schema)
    by = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "first", "m", *names))).alias("r"))  # as many as there are ranges, at most
    result = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n", T.IntegerType()), T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())])

    def fold(batches):
        for batch in batches:
            got = [_folded([(r["first"], None if r["m"] is None else [r["m"], *(r[c] for c in names)]) for r in rs], alpha) for rs in batch.column(1).to_pylist()]
            cols = list(zip(*got, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64()), strict=True))], names=[key, "n", "mean", "std"])

    return by.mapInArrow(fold, result)
