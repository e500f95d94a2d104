"""Named data sets, vectors written out as text, and results as JSON or CSV.

resolve() finds a data set by name: a generator, or files of a folder by their endings. It raises where nothing fits; it never
puts other data in the place of what was asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.sources import generators, vecs

GENERATORS = {"multi_manifold": generators.multi_manifold, "sift_like": generators.sift_like, "multi_cluster": generators.multi_cluster, "uniform_clusters": generators.uniform_clusters}


def read_text_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """word, v of lines of a word and its values, all between single spaces. With dim, lines of another number of values are an error;
    without, any number of them is taken. Empty lines are left out."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where("value <> ''").select(F.get(parts, F.lit(0)).alias("word"), F.slice(parts, F.lit(2), F.size(parts)).cast("array<double>").alias("v"))
    if dim is None:
        return rows
    wrong = F.raise_error(F.concat(F.lit(f"a vector needs {dim} values: "), F.col("word")))
    return rows.select("word", F.when(F.size("v") == dim, F.col("v")).otherwise(wrong).alias("v"))


def write_text_vectors(df: DataFrame, path: str, word: str = "word", v: str = "v") -> None:
    df.select(F.concat_ws(" ", F.col(word).cast("string"), F.array_join(F.transform(v, lambda x: x.cast("string")), " ")).alias("value")).write.text(path)


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """A table of results as JSON lines, or as CSV with a header."""
    if kind == "json":
        df.write.json(path)
    elif kind == "csv":
        df.write.csv(path, header=True)
    else:
        raise ValueError(f"no results as {kind}")


def read_results(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(schema).json(path) if kind == "json" else spark.read.schema(schema).csv(path, header=True)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, size, md5 of each file under path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), F.md5("content").alias("md5"))


def resolve(spark: SparkSession, name: str, folder: str | None = None, **how) -> DataFrame:
    """id, v of the data set: name.parquet (with columns id or vec_id, and v or embedding), name.fvecs or name.txt under folder, or the
    generator of that name with the parameters `how`."""
    if folder is not None:
        fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        has = lambda end: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}{end}"))
        if has(".parquet"):
            rows = spark.read.parquet(f"{folder}/{name}.parquet")
            pick = lambda *names: next(F.col(n) for n in names if n in rows.columns)
            return rows.select(pick("id", "vec_id").cast("long").alias("id"), pick("v", "embedding").cast("array<double>").alias("v"))
        if has(".fvecs"):
            return vecs.read_fvecs(spark, f"{folder}/{name}.fvecs").select(F.col("pos").alias("id"), F.col("v").cast("array<double>").alias("v"))
        if has(".txt"):
            return read_text_vectors(spark, f"{folder}/{name}.txt").select(F.xxhash64("word").alias("id"), "v")
    elif name in GENERATORS:
        return GENERATORS[name](spark, **how).select("id", "v")
    raise ValueError(f"no data set {name}" + (f" in {folder}" if folder else f"; there are {', '.join(GENERATORS)}"))
