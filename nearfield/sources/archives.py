"""Files that come packed: members of tar and zip archives as rows, and checksums of what arrived."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _unpacked(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, z.read(m)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
    except tarfile.ReadError as e:
        raise ValueError(f"{name} is no tar or zip archive") from e


def packed(files: list[tuple[str, bytes]], kind: str) -> bytes:
    """An archive of a few files (name, content): zip, or tar, tar.gz, tar.bz2."""
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files:
                z.writestr(name, data)
    else:
        with tarfile.open(fileobj=out, mode=f"w:{kind.removeprefix('tar').lstrip('.')}") as t:
            for name, data in files:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def unpacked(files: DataFrame) -> DataFrame:
    """file, member, content of each file in the archives (file, content). An archive is read in one task; folders and links are left out."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for member, content in _unpacked(name, data):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([content], pa.binary())], names=["file", "member", "content"])

    return files.select("file", "content").mapInArrow(run, "file string, member string, content binary")


def members(spark: SparkSession, path: str) -> DataFrame:
    """unpacked() of the archives under path."""
    return unpacked(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def checked(files: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """files (file, content) whose md5 is the one wanted for the file's last name; an error for another one. Names that aren't in
    `wanted` pass unchecked."""
    name, md5 = F.element_at(F.split("file", "/"), -1), F.md5("content")
    want = F.try_element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), name) if wanted else F.lit(None).cast("string")
    wrong = F.raise_error(F.concat(name, F.lit(" has md5 "), md5))
    return files.withColumn("content", F.when(want.isNull() | (want == md5), F.col("content")).otherwise(wrong))
