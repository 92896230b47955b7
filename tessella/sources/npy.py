"""Vectors in `.npy` files: a Spark data source that reads ranges of rows of a matrix, and a writer of keyed rows."""

from __future__ import annotations

import ast
import io
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of rows that one partition reads, about.
PARTITION_BYTES = 32 << 20
SCHEMA = "row_index long, key long, embedding array<float>"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI; `file:/x` as Spark writes it is one of this machine or of a folder that all share."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _npy_files(path: str) -> list[str]:
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [inner]
    found = system.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".npy") and not f.base_name.startswith(("_", ".")))


@dataclass
class Header:
    """Where the rows of a file begin, how many there are and what a row is."""

    offset: int
    rows: int
    kind: np.dtype


def read_header(system: fs.FileSystem, path: str) -> Header:
    with system.open_input_file(path) as f:
        start = f.read(12)
        if start[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no .npy file")
        wide = start[6] > 1
        size = int.from_bytes(start[8:12] if wide else start[8:10], "little")
        at = 12 if wide else 10
        f.seek(at)
        fields = ast.literal_eval(f.read(size).decode("latin1"))
    if fields["fortran_order"]:
        raise ValueError(f"{path} is stored by columns")
    shape = fields["shape"]
    kind = np.dtype([tuple(x) for x in fields["descr"]] if isinstance(fields["descr"], list) else fields["descr"])
    if kind.names is None:
        if len(shape) != 2:
            raise ValueError(f"{path} holds no matrix")
        kind = np.dtype((kind, shape[1:]))
    return Header(at + size, shape[0], kind)


class _Rows(InputPartition):
    def __init__(self, path: str, header: Header, first: int, last: int, before: int):
        self.path, self.header, self.first, self.last, self.before = path, header, first, last, before


class NpyReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self):
        out, before = [], 0
        system, _ = _open(self.path)
        for path in _npy_files(self.path):
            header = read_header(system, path)
            step = max(1, self.partition_bytes // max(1, header.kind.itemsize))
            out += [_Rows(path, header, at, min(at + step, header.rows), before) for at in range(0, header.rows, step)]
            before += header.rows
        return out or [_Rows("", Header(0, 0, np.dtype((np.float32, (0,)))), 0, 0, 0)]

    def read(self, partition: _Rows):
        if partition.first >= partition.last:
            return
        system, _ = _open(self.path)
        header, n = partition.header, partition.last - partition.first
        with system.open_input_file(partition.path) as f:
            f.seek(header.offset + partition.first * header.kind.itemsize)
            data = f.read(n * header.kind.itemsize)
        index = partition.before + np.arange(partition.first, partition.last)
        if header.kind.names:
            rows = np.frombuffer(data, header.kind)
            keys, values = pa.array(rows["key"].astype(np.int64)), rows["embedding"]
        else:
            base, shape = header.kind.subdtype
            keys, values = pa.nulls(n, pa.int64()), np.frombuffer(data, base).reshape(n, *shape)
        flat = pa.array(values.astype(np.float32).ravel())
        offsets = pa.array(np.arange(0, n * values.shape[1] + 1, max(values.shape[1], 1), dtype=np.int32)[: n + 1])
        yield pa.RecordBatch.from_arrays([pa.array(index), keys, pa.ListArray.from_arrays(offsets, flat)], names=["row_index", "key", "embedding"])


@dataclass
class _Written(WriterCommitMessage):
    path: str


class NpyWriter(DataSourceArrowWriter):
    """A file for each task, under a name of its own; files of failed tasks are left out of sight and removed when the job ends."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        keys, values, widths = [], [], set()
        for batch in iterator:
            column = batch.column("embedding")
            if column.null_count:
                raise ValueError("a row without a vector can't be stored in a matrix")
            widths.update(pc.list_value_length(column).unique().to_pylist())
            if len(widths) > 1:
                raise ValueError("vectors of several widths can't be stored in a matrix")
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            values.append(column.flatten().to_numpy(zero_copy_only=False))
        n, width = sum(map(len, keys)), max(widths, default=0)
        rows = np.empty(n, np.dtype([("key", "<i8"), ("embedding", "<f4", (width,))]))
        if n:  # a task may have no rows
            rows["key"], rows["embedding"] = np.concatenate(keys), np.concatenate(values).reshape(n, width)
        data = io.BytesIO()
        np.save(data, rows)
        system, inner = _open(self.path)
        system.create_dir(inner, recursive=True)
        path = f"{inner}/_part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.npy"
        if len(rows):
            with system.open_output_stream(path) as f:
                f.write(data.getbuffer())
        return _Written(path if len(rows) else "")

    def commit(self, messages):
        system, inner = _open(self.path)
        done = {m.path for m in messages if m is not None and m.path}
        if self.overwrite:
            for f in _npy_files(self.path):
                system.delete_file(f)
        for path in sorted(done):
            system.move(path, path.replace("/_part-", "/part-"))
        self._tidy(system, inner)

    def abort(self, messages):
        system, inner = _open(self.path)
        self._tidy(system, inner)

    @staticmethod
    def _tidy(system, inner):
        for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if f.base_name.startswith("_part-"):
                system.delete_file(f.path)


class NpySource(DataSource):
    """`spark.read.format("npy").load(path)`: (row_index, key, embedding) of a matrix or of keyed rows, of one file or of a folder's in order of name.

    A plain matrix has null keys and its place as row_index. Partitions are ranges of bytes; a file is never read whole by one task.
    """

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return NpyReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite):
        return NpyWriter(self.options["path"], overwrite)


def read_npy(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("partitionBytes", partition_bytes).load(path)


def write_npy(rows: DataFrame, path: str, key: str, embedding: str = "embedding") -> None:
    """Vectors of one width and their whole keys as keyed rows, a file for each partition; what stood below `path` goes."""
    spark = rows.sparkSession
    spark.dataSource.register(NpySource)
    rows.selectExpr(f"CAST(`{key}` AS BIGINT) AS key", f"CAST(`{embedding}` AS ARRAY<FLOAT>) AS embedding").write.format("npy").mode("overwrite").save(path)
