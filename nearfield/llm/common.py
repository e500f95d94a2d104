"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of one Arrow batch, so that a few very long texts don't make a large one, and of rows that a Parquet scan holds at once.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 1000, 4 << 20, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at_most(spark: SparkSession, key: str, most: int) -> None:
    now = str(spark.conf.get(key)).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def bounded_scans(spark: SparkSession) -> None:
    """Bounds what a scan holds at once, unless the session already asks for less: thousands of whole texts are many megabytes in one
    array, which makes a JVM's heap grow."""
    _at_most(spark, "spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once, too."""
    bounded_scans(spark)
    _at_most(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    _at_most(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in spark.checkpoint.dir; a temporary one only where all is one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "nearfield-checkpoints"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that is no longer needed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Shuffle partitions that one task of few() takes, one after another; or bytes of text, where their sum is known.
TOGETHER, FEW_BYTES = 8, 16 << 20


def few(df: DataFrame, size: int | None = None) -> DataFrame:
    """df, the result of a shuffle, in fewer partitions, for what is written: two for each core at least. A small table in as many
    files as there are shuffle partitions costs more for the files than for the rows; memory is that of one shuffle partition still."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) // TOGETHER if size is None else -(-size // FEW_BYTES)
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, parts))


def checkpointed(df: DataFrame, shuffled: bool = True, size: int | None = None) -> DataFrame:
    """df with its lineage cut by a copy in the shared checkpoint folder; shuffled: it is the result of a shuffle, of about that size."""
    shared_folder(df.sparkSession)
    return (few(df, size) if shuffled else df).checkpoint(eager=True)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns, so that no other column's name can clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def per_text(df: DataFrame, schema: str, make: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """A row (doc_id, *f(text)) for each row of df (doc_id, text). make() runs once in each task and returns f."""
    bounded_batches(df.sparkSession)
    out = T._parse_datatype_string(schema)
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            rows = [f(t) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[] for _ in arrow.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.types[0]), *(pa.array(c, t) for c, t in zip(cols, arrow.types[1:], strict=True))], schema=arrow)

    return df.mapInArrow(run, out)


def change_text(df: DataFrame, text_col: str, make: Callable[[], Callable[[str | None], str | None]], size_col: str | None = None) -> DataFrame:
    """df, whatever its columns are, with each text replaced; size_col, if df has it, gets the length of those that changed."""
    bounded_batches(df.sparkSession)
    k = df.columns.index(text_col)
    n = df.columns.index(size_col) if size_col in df.columns else None

    def run(batches):
        f = None
        for batch in batches:
            f = f or make()
            old = batch.column(k).to_pylist()
            new = [f(t) for t in old]
            if n is not None:
                sizes = [s if a == b else len(b) for a, b, s in zip(old, new, batch.column(n).to_pylist(), strict=True)]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(sizes, batch.schema.field(n).type))
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    return df.mapInArrow(run, df.schema)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}[type(t)]


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
