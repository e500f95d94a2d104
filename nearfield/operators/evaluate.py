"""Quality of results, statistics of runs, ranks and correlation, profiles of clusters.

What needs an order over all rows is computed by ranges: running() sums within each range of a distribution by value and adds
what lies in the ranges before, of which only a row each is sorted in one task. Which range a row is in is stored with it, in a
checkpoint, before anything is summed: a second exchange of the same rows may sample other bounds or merge other partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.vectors import l2
from nearfield.plans.session import kept


def hits_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, hits, want for each query of truth; both have qid, id without repeats."""
    want = truth.groupBy("qid").agg(F.count("*").alias("want"))
    hit = found.select("qid", "id").join(truth.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    return want.join(hit, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), "want")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    return hits_of(found, truth).agg((F.sum("hits") / F.sum("want")).alias("recall"))


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df with __p, the number of a row's range in `order`: rows of a lower number come before, or are equal in order."""
    return kept(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, str], total=F.sum) -> DataFrame:
    """df with, for each {out: value}, total (F.sum or F.max) of value over the rows of the same `by` that come before in `order`;
    null for the first. Rows of one `by` and equal order count in some order among themselves. A large `by` lies in many ranges."""
    ranged = in_ranges(df, [*by, *order])
    within = Window.partitionBy(*by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*by, "__p").agg(*(total(v).alias(f"__t_{out}") for out, v in values.items()))  # a row for each range, and one more for each `by`
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, F.col("__p").alias("__q"), *(total(f"__t_{out}").over(earlier).alias(f"__before_{out}") for out in values))
    same = F.col("__p") == F.col("__q")
    for k, c in enumerate(by):
        ranges = ranges.withColumnRenamed(c, f"__by{k}")
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    both = ranged.withColumns({f"__in_{out}": total(v).over(within) for out, v in values.items()}).join(ranges, same)

    def add(a, b):
        return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if total is F.sum else F.greatest(a, b)

    return both.select(*df.columns, *(add(F.col(f"__in_{out}"), F.col(f"__before_{out}")).alias(out) for out in values))


def _places(df: DataFrame, value: str) -> DataFrame:
    """value, up (values up to this one), n (all): a row for each distinct value that isn't null."""
    n = df.agg(F.count(value).alias("n"))
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    up = F.coalesce("__up", F.lit(0)) + F.col("c")
    return running(c, [], [value], {"__up": "c"}).withColumn("up", up).crossJoin(F.broadcast(n))  # n is one row


def percentiles_by_index(df: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """The values at the places floor(p * n) of the sorted column, from counts of distinct values."""
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
    return _places(df, value).agg(*(F.min(F.when(F.col("up") > at(p), F.col(value))).alias(k) for k, p in points.items()))


def percentiles_linear(df: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """Between the values at the places around p * (n - 1) of the sorted column, in proportion; from counts of distinct values by
    ranges, so that no task holds the column. Null for a column without values."""
    return _between(_places(df, value), value, points)


def group_percentiles(df: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """by and, for each group, values between the places around p * (n - 1), in proportion; a large group lies in many ranges."""
    c = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    n = c.groupBy(F.col(by).alias("__by")).agg(F.sum("c").alias("n"))
    rows = running(c, [by], [value], {"__up": "c"}).withColumn("up", F.coalesce("__up", F.lit(0)) + F.col("c")).join(n, F.col(by).eqNullSafe(F.col("__by")))
    return _between(rows.groupBy(by), value, points)


def _between(rows, value: str, points: dict[str, float]) -> DataFrame:
    at = lambda p: F.lit(p) * (F.col("n") - 1)
    value_at = lambda place: F.min(F.when(F.col("up") > place, F.col(value)))
    parts = {k: (value_at(F.floor(at(p))), value_at(F.ceil(at(p))), F.max(at(p) - F.floor(at(p)))) for k, p in points.items()}
    return rows.agg(*((lo + (hi - lo) * share).alias(k) for k, (lo, hi, share) in parts.items()))


def fractional_ranks(df: DataFrame, value: str, out: str, by: str | None = None) -> DataFrame:
    """Equal values share the mean of their ranks; from counts of distinct values, joined back. Null values have no rank."""
    keys = [by] if by else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    ranks = running(counts, keys, [value], {"__lower": "__c"})
    ranks = ranks.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, value])), (F.coalesce("__lower", F.lit(0)) + (F.col("__c") + 1) / 2).alias(out))
    same = F.col(value) == F.col(f"__k{len(keys)}")
    if by:
        same = same & F.col(by).eqNullSafe(F.col("__k0"))
    return df.join(ranks, same, "left").select(*df.columns, out)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho, p (normal approximation, 1e-15 at least); rho 0 and p 1 for fewer than three rows or a constant column."""
    r = fractional_ranks(fractional_ranks(df, x, "rx"), y, "ry")
    got = r.agg(F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    rho = F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))).otherwise(0.0)

    @F.pandas_udf("double")
    def tail(z):  # one row
        return z.map(lambda v: max(1e-15, math.erfc(abs(v) / math.sqrt(2))))

    z = F.col("rho") * F.sqrt(F.greatest(F.col("n") - 1, F.lit(0)))
    return got.select("n", rho.alias("rho")).select("n", "rho", tail(z.cast("double")).alias("p"))


def trial_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def centroids(df: DataFrame, by: str) -> DataFrame:
    """by, centroid; df has v."""
    dims = df.select(by, F.posexplode("v").alias("dim", "x")).groupBy(by, "dim").agg(F.avg("x").alias("x"))
    return dims.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c")).select(by, F.col("c.x").alias("centroid"))


def centroid_distances(df: DataFrame, by: str) -> DataFrame:
    """a, b, dist for each pair of clusters; the clusters are few."""
    c = centroids(df, by)
    a, b = c.select(F.col(by).alias("a"), F.col("centroid").alias("ca")), c.select(F.col(by).alias("b"), F.col("centroid").alias("cb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", l2(F.col("ca"), F.col("cb")).alias("dist"))


def pareto_front(df: DataFrame, cost: str, gain: str) -> DataFrame:
    """The rows that no other row equals or beats in both and beats in one; by a running maximum over rising cost."""
    steps = running(df.groupBy(cost).agg(F.max(gain).alias("__g")), [], [cost], {"__upto": "__g"}, F.max)
    keep = steps.where(F.col("__upto").isNull() | (F.col("__g") > F.col("__upto"))).select(F.col(cost).alias("__c"), "__g")
    return df.join(keep, (F.col(cost) == F.col("__c")) & (F.col(gain) == F.col("__g")), "left_semi")
