"""Arrays on disk: a data source for NPZ files, read in ranges of rows, and a sink for models.

``spark.dataSource.register(ArrayFiles)`` makes ``format("npz")`` known. A file's arrays that are
asked for become columns, a row for each entry of their first dimension; further dimensions are
one flat array. Other arrays of the file are not touched. Paths are any that Arrow's file systems
know (local, hdfs, object stores), opened in the tasks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

#: Rows of a split.
ROWS = 4096


def _opened(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[str]:
    """The NPZ files at a path, a file or a folder, by name."""
    from pyarrow import fs

    system, at = _opened(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path.removesuffix("/")
    return sorted(prefix + f.path.removeprefix(at.removesuffix("/")) for f in found if f.type == fs.FileType.File and f.path.endswith(".npz"))


def _header(member) -> tuple[tuple[int, ...], bool, object]:
    """(shape, whether columns come first, type) of an array whose stream is at its beginning."""
    from numpy.lib import format as npy

    version = npy.read_magic(member)
    return (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(member)


def _zip(path: str) -> zipfile.ZipFile:
    system, at = _opened(path)
    return zipfile.ZipFile(system.open_input_file(at))


def _headers(path: str, names: list[str] | None = None) -> dict[str, tuple]:
    """By array: its header; of ``names`` alone if given."""
    with _zip(path) as held:
        found = {}
        for name in held.namelist():
            if name.endswith(".npy") and (names is None or name[:-4] in names):
                with held.open(name) as member:
                    found[name[:-4]] = _header(member)
        return found


def _type(shape: tuple[int, ...], kind) -> DataType:
    one: DataType = {"f": DoubleType(), "i": LongType(), "u": LongType(), "b": BooleanType()}.get(kind.kind, StringType())
    return one if len(shape) == 1 else ArrayType(one)


@dataclass
class Span(InputPartition):
    path: str
    first: int
    past: int


class ArrayFiles(DataSource):
    """Options: path; arrays (comma-separated names, all that share the first one's length if not
    given); rows (of a split)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no NPZ files at {self.options['path']}")
        names = [x.strip() for x in self.options["arrays"].split(",")] if "arrays" in self.options else None
        headers = _headers(files[0], names)
        if names is None:
            length = next((h[0][0] for h in headers.values() if h[0]), None)
            names = [n for n, h in headers.items() if h[0] and h[0][0] == length]
        missing = [n for n in names if n not in headers or not headers[n][0]]
        if missing:
            raise ValueError(f"no such arrays: {missing}")
        return StructType([StructField("file", StringType()), StructField("row", LongType()), *(StructField(n, _type(headers[n][0], headers[n][2])) for n in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.options["path"], schema, int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArrayWriter(self.options["path"], schema, overwrite)


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int):
        self.path, self.schema_, self.rows = path, schema, rows
        self.names = [f.name for f in schema.fields if f.name not in ("file", "row")]

    def partitions(self) -> list[InputPartition]:
        spans = []
        for path in _files(self.path):
            headers = _headers(path, self.names)
            n = {headers[x][0][0] for x in self.names}
            if len(n) > 1:
                raise ValueError(f"arrays of several lengths in {path}")
            total = n.pop() if n else 0
            spans += [Span(path, k, min(total, k + self.rows)) for k in range(0, total, self.rows)]
        return spans

    def read(self, partition: Span) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        columns = {"file": pa.array([partition.path] * (partition.past - partition.first)), "row": pa.array(range(partition.first, partition.past), pa.int64())}
        with _zip(partition.path) as held:
            for name in self.names:
                columns[name] = pa.array(_rows(held, name, partition.first, partition.past), to_arrow_type(self.schema_[name].dataType))
        yield pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in self.schema_.fields})


def _rows(held: zipfile.ZipFile, name: str, first: int, past: int) -> list:
    """Rows of an array, from its stream: what comes before is passed over, and what follows is not
    read. Stored files are sought in; of compressed ones only the bytes before are unpacked."""
    import numpy as np

    with held.open(f"{name}.npy") as member:
        shape, by_columns, kind = _header(member)
        if by_columns and len(shape) > 1 or kind.hasobject:
            with held.open(f"{name}.npy") as again:
                whole = np.lib.format.read_array(again, allow_pickle=False)
            block = whole[first:past]
        else:
            width = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
            member.seek(member.tell() + first * width)
            block = np.frombuffer(member.read((past - first) * width), kind).reshape(past - first, *shape[1:])
    return block.tolist() if block.ndim == 1 else block.reshape(len(block), -1).tolist()


@dataclass
class Wrote(WriterCommitMessage):
    path: str | None


class ArrayWriter(DataSourceWriter):
    """Rows (name, shape, values) as the arrays of one NPZ file a task; a file appears when its task
    ends, under a name of its own, and goes again if the job fails."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        if [f.name for f in schema.fields] != ["name", "shape", "values"]:
            raise ValueError("rows must be (name, shape, values)")
        self.path, self.overwrite = path, overwrite
        if not overwrite and self._held():
            raise ValueError(f"{path} has files already")

    def _held(self) -> list[str]:
        from pyarrow import fs

        system, at = _opened(self.path)
        return _files(self.path) if system.get_file_info(at).type != fs.FileType.NotFound else []

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import numpy as np
        from pyspark import TaskContext

        arrays = {r["name"]: np.asarray(r["values"], float).reshape(r["shape"]) for r in iterator}
        if not arrays:
            return Wrote(None)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.npz"
        packed = io.BytesIO()
        np.savez_compressed(packed, **arrays)
        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{name}") as out:
            out.write(packed.getvalue())
        return Wrote(name)

    def commit(self, messages: list) -> None:
        kept = {m.path for m in messages if m is not None and m.path}
        if self.overwrite:
            self._drop([f for f in self._held() if f.rsplit("/", 1)[1] not in kept])

    def abort(self, messages: list) -> None:
        self._drop([f"{self.path}/{m.path}" for m in messages if m is not None and m.path])

    def _drop(self, paths: list[str]) -> None:
        for path in paths:
            system, at = _opened(path)
            system.delete_file(at)


def read_arrays(spark, path: str, arrays: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """(file, row, one column an array) of the NPZ files at ``path``."""
    spark.dataSource.register(ArrayFiles)
    reader = spark.read.format("npz").option("path", path).option("rows", rows)
    return (reader.option("arrays", ",".join(arrays)) if arrays else reader).load()


def write_arrays(arrays: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (name, shape, values), such as a model's weights, as NPZ files."""
    arrays.sparkSession.dataSource.register(ArrayFiles)
    arrays.select("name", "shape", "values").write.format("npz").option("path", path).mode("overwrite" if overwrite else "append").save()
