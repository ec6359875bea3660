"""Files of arrays (.npy and .npz) as a Python data source, and their writer.

The driver lists names and reads headers; each task reads the rows of its own part of one
array, in blocks. Nothing is ever unpickled: arrays of objects are an error. Paths may be
of any file system that pyarrow knows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, name string, at long, shape array<int>, vec array<double>"
#: Rows of a part, and of a block that is held at once.
PART, BLOCK = 1 << 16, 1024


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def array_files(path: str) -> list[str]:
    """All .npy and .npz files at or below a path."""
    fs, at = _opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(x.path for x in found if x.type == pafs.FileType.File and x.path.endswith((".npy", ".npz")))


@dataclass
class Head:
    """What an array's header says, and where its numbers begin."""

    shape: tuple[int, ...]
    fortran: bool
    kind: np.dtype
    offset: int

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def row_shape(self) -> tuple[int, ...]:
        return self.shape[1:]


def read_head(stream, file: str) -> Head:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(stream)
    if kind.hasobject:
        raise ValueError(f"{file} holds objects, which are never unpickled")
    if kind.kind not in "biuf":
        raise ValueError(f"{file} holds {kind}, not numbers")
    return Head(shape, fortran, kind, stream.tell())


def _members(fs: pafs.FileSystem, path: str) -> list[str | None]:
    if path.endswith(".npy"):
        return [None]
    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        return [n for n in z.namelist() if n.endswith(".npy")]


def _stream(fs: pafs.FileSystem, path: str, member: str | None):
    f = fs.open_input_file(path)
    return f if member is None else zipfile.ZipFile(f).open(member)


@dataclass
class Part(InputPartition):
    path: str
    member: str | None
    start: int
    stop: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.wanted = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with a name chooses members before anything is read; all else stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                self.wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            yield f

    def partitions(self) -> list[Part]:
        fs, _ = _opened(self.options["path"])
        rows, out = int(self.options.get("rows", PART)), []
        for path in array_files(self.options["path"]):
            for member in _members(fs, path):
                if self.wanted and (member or "").removesuffix(".npy") not in self.wanted:
                    continue
                with _stream(fs, path, member) as s:
                    head = read_head(s, path)
                # columns first: one part, as rows are not together
                step = rows if not head.fortran else max(1, head.rows)
                out += [Part(path, member, a, min(a + step, head.rows)) for a in range(0, head.rows, step)]
        return out or [Part("", None, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.start == part.stop:
            return
        fs, _ = _opened(self.options["path"])
        name = part.member.removesuffix(".npy") if part.member else None
        with _stream(fs, part.path, part.member) as s:
            head = read_head(s, part.path)
            width = int(np.prod(head.row_shape, dtype=np.int64))
            size = width * head.kind.itemsize
            if head.fortran:
                whole = np.frombuffer(s.read(), head.kind).reshape(head.shape, order="F").reshape(head.rows, width)
            else:
                s.seek(head.offset + part.start * size)
            for a in range(part.start, part.stop, BLOCK):
                b = min(a + BLOCK, part.stop)
                if head.fortran:
                    x = whole[a:b]
                else:
                    raw = s.read((b - a) * size)
                    if len(raw) < (b - a) * size:
                        raise ValueError(f"{part.path} ends within its array")
                    x = np.frombuffer(raw, head.kind).reshape(b - a, width)
                flat = np.ascontiguousarray(x, np.float64).ravel()
                vec = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * width), pa.array(flat))
                shape = pa.array([list(head.row_shape)] * (b - a), pa.list_(pa.int32()))
                yield pa.record_batch({"file": pa.array([part.path] * (b - a)), "name": pa.array([name] * (b - a), pa.string()), "at": np.arange(a, b), "shape": shape, "vec": vec})


class ArrayFiles(DataSource):
    """`path`: a file or folder; `rows`: rows of a part."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(dict(self.options))


def array_rows(spark: SparkSession, path: str, rows: int = PART) -> DataFrame:
    """(file, name, at, shape, vec): a row for each entry of the first axis of all arrays.

    `name` is the array's in an .npz file, and null in an .npy file; `vec` has the entry's
    numbers as doubles, in the order of its `shape`. A number alone is one row.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayFiles)
    return spark.read.format("array_files").option("path", path).option("rows", rows).load()


def write_arrays(rows: DataFrame, path: str) -> DataFrame:
    """Writes (file, name, at, vec) as one file a `file` below the path; (file, n) of what was written.

    Files with a null name are .npy, others .npz with their names. The rows of a file are one
    group, as its arrays are; its vectors have one width a name. A file is written under
    another name first and then renamed, so a task that is tried again leaves whole files.
    """

    def save(table: pa.Table) -> pa.Table:
        table = table.sort_by([("name", "ascending"), ("at", "ascending")])
        file, names, vec = table.column("file")[0].as_py(), table.column("name").to_pylist(), table.column("vec").to_pylist()
        groups: dict[str | None, list] = {}
        for n, v in zip(names, vec, strict=True):
            groups.setdefault(n, []).append(v)
        buffer = io.BytesIO()
        if None in groups:
            np.save(buffer, np.array(groups[None], np.float64), allow_pickle=False)
        else:
            np.savez(buffer, **{n: np.array(v, np.float64) for n, v in groups.items()})
        fs, at = _opened(path)
        fs.create_dir(at, recursive=True)
        final = f"{at}/{file}{'.npy' if None in groups else '.npz'}"
        with fs.open_output_stream(f"{final}.part") as out:
            out.write(buffer.getvalue())
        fs.move(f"{final}.part", final)
        return pa.table({"file": [final], "n": pa.array([len(vec)], pa.int64())})

    x = rows.select(F.col("file").cast("string"), F.col("name").cast("string"), F.col("at").cast("long"), F.col("vec").cast("array<double>"))
    return x.groupBy("file").applyInArrow(save, "file string, n long")
