"""fvecs and ivecs files as a data source: records of a little-endian count and as many 4-byte values.

A file is read in byte ranges, each by a task of its own: a range has the records that begin in it, as all records of a file are of one
size, which the file's first bytes tell. A limit is carried to the ranges, and what lies behind it isn't read. A partial
last record is ignored, an empty file gives no rows; a record of another length is an error. Rows: file, pos, v.

A write goes to a folder beside the files, task by task; when all tasks are through, the commit moves the files in, and an overwrite takes
out those that were there. An abort removes the folder, so a failed write leaves what was. A folder that has files is an error
unless it is to be overwritten. Files are named in the order of the ranges of `order`.

path: of a file system that pyarrow knows (file, hdfs, s3, gs), shared by all machines.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: For each kind: values in a file, in Arrow, and in SQL.
KINDS = {"fvecs": ("<f4", pa.float32(), "float"), "ivecs": ("<i4", pa.int32(), "int")}
#: Bytes of a range, and of what a task holds at once.
SPLIT, AT_ONCE = 64 << 20, 4 << 20


def _at(path: str) -> tuple[pa_fs.FileSystem, str]:
    return pa_fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _files(fs: pa_fs.FileSystem, path: str) -> list[pa_fs.FileInfo]:
    """Those that are not hidden, in order of name."""
    info = fs.get_file_info(path)
    if info.type == pa_fs.FileType.File:
        return [info]
    found = fs.get_file_info(pa_fs.FileSelector(path, allow_not_found=True))
    return sorted((f for f in found if f.type == pa_fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Vecs(DataSource):
    """Options: path, kind (fvecs or ivecs), split (bytes of a range), limit (records of each file)."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return f"file string, pos long, v array<{KINDS[self.options['kind']][2]}>"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options, overwrite)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], KINDS[options["kind"]]
        self.split, self.limit = int(options.get("split", SPLIT)), int(options["limit"]) if options.get("limit") else None

    def partitions(self) -> list[Range]:
        fs, path = _at(self.path)
        most = self._most(fs, path) if self.limit is not None else None
        ends = {f.path: f.size if most is None else min(f.size, most) for f in _files(fs, path)}
        return [Range(f, s, min(s + self.split, end)) for f, end in ends.items() for s in range(0, end, self.split)]

    def _most(self, fs: pa_fs.FileSystem, path: str) -> int | None:
        """Bytes of a file that the limit leaves, if all files' records are as long as the first one's; longer ones are cut by tasks."""
        sizes = [self._size(fs, f.path) for f in _files(fs, path) if f.size >= 4]
        return max(sizes, default=0) * self.limit

    def _size(self, fs: pa_fs.FileSystem, path: str) -> int:
        with fs.open_input_file(path) as f:
            dim = int(np.frombuffer(f.read(4), "<i4")[0])
        if dim <= 0:
            raise ValueError(f"{path}: a vector of {dim} values")
        return 4 + 4 * dim

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        """part: None where there are none."""
        if part is None:
            return
        fs, _ = _at(self.path)
        with fs.open_input_file(part.path) as f:
            whole = f.size()
            if whole < 4:
                return
            size = self._size(fs, part.path)
            last = whole // size if self.limit is None else min(whole // size, self.limit)
            pos, end = -(-part.start // size), min(-(-part.end // size), last)
            while pos < end:
                n = min(end - pos, max(1, AT_ONCE // size))
                f.seek(pos * size)
                rows = np.frombuffer(f.read(n * size), "<i4").reshape(n, size // 4)
                if (rows[:, 0] != size // 4 - 1).any():
                    raise ValueError(f"{part.path}: vectors of different lengths")
                values = np.ascontiguousarray(rows[:, 1:]).view(self.kind[0])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (size // 4 - 1), pa.int32()), pa.array(values.ravel(), self.kind[1]))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(pos, pos + n)), lists], names=["file", "pos", "v"])
                pos += n


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], KINDS[options["kind"]], overwrite
        fs, path = _at(self.path)
        if not overwrite and _files(fs, path):
            raise ValueError(f"there are files in {self.path}")
        self.staged = f"{path}/_writing-{uuid.uuid4()}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = _at(self.path)
        part, name, out = TaskContext.get().partitionId(), None, None
        for batch in iterator:
            v = batch.column(batch.schema.get_field_index("v"))
            if v.null_count or not batch.num_rows:
                v = v.drop_null()
            if not len(v):
                continue
            if out is None:
                fs.create_dir(self.staged)
                name = f"{self.staged}/{part}-{uuid.uuid4()}"
                out = fs.open_output_stream(name)
            dims = np.diff(v.offsets.to_numpy())
            values = v.flatten().to_numpy(zero_copy_only=False).astype(self.kind[0])
            if (dims == dims[0]).all():
                rows = np.empty((len(v), dims[0] + 1), "<i4")
                rows[:, 0], rows[:, 1:] = dims[0], values.reshape(len(v), -1).view("<i4")
                out.write(rows.tobytes())
            else:
                raise ValueError("vectors of different lengths")
        if out is not None:
            out.close()
        return Written(part, name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _at(self.path)
        fs.create_dir(path)
        for f in _files(fs, path):  # none, unless it is to be overwritten
            fs.delete_file(f.path)
        done = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.part)
        for k, m in enumerate(done):
            fs.move(m.file, f"{path}/part-{k:05d}")
        self._clear(fs)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(_at(self.path)[0])

    def _clear(self, fs: pa_fs.FileSystem) -> None:
        if fs.get_file_info(self.staged).type == pa_fs.FileType.Directory:
            fs.delete_dir(self.staged)


def _read(spark: SparkSession, path: str, kind: str, limit: int | None, split: int) -> DataFrame:
    spark.dataSource.register(Vecs)
    how = spark.read.format("vecs").option("path", path).option("kind", kind).option("split", split)
    return (how if limit is None else how.option("limit", limit)).load()


def read_fvecs(spark: SparkSession, path: str, limit: int | None = None, split: int = SPLIT) -> DataFrame:
    return _read(spark, path, "fvecs", limit, split)


def read_ivecs(spark: SparkSession, path: str, limit: int | None = None, split: int = SPLIT) -> DataFrame:
    return _read(spark, path, "ivecs", limit, split)


def _write(df: DataFrame, path: str, order: str, v: str, kind: str, overwrite: bool) -> None:
    df.sparkSession.dataSource.register(Vecs)
    ranged = df.select(F.col(order).alias("o"), F.col(v).cast(f"array<{KINDS[kind][2]}>").alias("v")).where("v IS NOT NULL").repartitionByRange("o").sortWithinPartitions("o").select("v")
    ranged.write.format("vecs").option("path", path).option("kind", kind).mode("overwrite" if overwrite else "append").save()


def write_fvecs(df: DataFrame, path: str, order: str = "id", v: str = "v", overwrite: bool = False) -> None:
    _write(df, path, order, v, "fvecs", overwrite)


def write_ivecs(df: DataFrame, path: str, order: str = "qid", v: str = "v", overwrite: bool = False) -> None:
    _write(df, path, order, v, "ivecs", overwrite)
