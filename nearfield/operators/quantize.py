"""Scalar quantisation to 8 or 4 bits for each dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import cosine, l2


def train(df: DataFrame, bits: int = 8) -> DataFrame:
    """One row: lows, scales, arrays by dimension; a range of up to 1e-7 has scale 1. df has v."""
    steps = float((1 << bits) - 1)
    by_dim = df.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    scale = F.when(F.col("hi") - F.col("lo") <= 1e-7, 1.0).otherwise((F.col("hi") - F.col("lo")) / steps)
    rows = by_dim.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", scale.alias("scale")))).alias("b"))
    return rows.select(F.col("b.lo").alias("lows"), F.col("b.scale").alias("scales"))


def encode(v: Column, lows: Column, scales: Column, bits: int = 8) -> Column:
    top = (1 << bits) - 1
    by = F.arrays_zip(v.alias("v"), lows.alias("l"), scales.alias("s"))
    return F.transform(by, lambda x: F.greatest(F.lit(0), F.least(F.lit(top), F.rint((x["v"] - x["l"]) / x["s"]).cast("int"))))


def pack4(codes: Column) -> Column:
    """Two codes a byte, the even dimension low."""
    n = F.size(codes)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), lambda i: F.get(codes, 2 * i).bitwiseOR(F.coalesce(F.get(codes, 2 * i + 1), F.lit(0)) * 16))


def unpack4(packed: Column, dim: Column) -> Column:
    return F.slice(F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(15), F.shiftright(b, 4)))), F.lit(1), dim)


def decode(codes: Column, lows: Column, scales: Column) -> Column:
    by = F.arrays_zip(codes.alias("c"), lows.alias("l"), scales.alias("s"))
    return F.transform(by, lambda x: x["l"] + x["c"] * x["s"])


def asymmetric(query: Column, codes: Column, lows: Column, scales: Column, metric: str = "l2") -> Column:
    return (l2 if metric == "l2" else cosine)(query, decode(codes, lows, scales))
