"""Sessions and folders."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import doubles


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in spark.checkpoint.dir; a temporary one only where all is one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "nearfield-checkpoints"))
    return sc.getCheckpointDir()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v (doubles), label."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("v"), "label")


def kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a copy in the checkpoint folder, for what several plans read."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer needed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
