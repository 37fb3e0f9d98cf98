"""Meshes in binary PLY files as a data source that reads byte ranges: a large mesh is many tasks.

Vertices are records of one size, and so are faces where all are triangles, which the file's size tells. The driver reads
headers only; each task reads its range through the file system of the path (local disks, HDFS, S3, GCS). Files of text, or with
other faces than triangles, are one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from poseframe.sources.readers import PLY_TYPES, _header, parse_ply

#: Bytes of a task's range.
RANGE = 32 << 20
#: Headers are looked for in so many bytes.
HEAD = 1 << 16
#: Records that one batch holds.
BATCH = 1 << 16
SCHEMAS = {
    "vertex": "file string, vid bigint, x double, y double, z double",
    "face": "file string, fid bigint, i0 int, i1 int, i2 int",
}


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.Directory:
        return system, sorted((f for f in system.get_file_info(fs.FileSelector(place)) if f.is_file and f.path.lower().endswith(".ply")), key=lambda f: f.path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return system, [info]


def _layout(head: bytes, size: int) -> dict[str, tuple[int, int, np.dtype]] | None:
    """For vertex and face where their first record lies, how many there are and their type; None where records differ in size."""
    body, form, parts = _header(head)
    if form not in ("binary_little_endian", "binary_big_endian"):
        return None
    order, at, out = ">" if "big" in form else "<", len(head) - len(body), {}
    for i, (name, n, props) in enumerate(parts):
        lists = [p for p in props if p[0] == "list"]
        fields = []
        for p in props:
            if p[0] != "list":
                fields.append((p[-1], order + PLY_TYPES[p[0]]))
            elif name == "face" and len(lists) == 1 and p[-1].startswith("vert"):
                fields += [("_count", order + PLY_TYPES[p[1]]), *[(f"i{k}", order + PLY_TYPES[p[2]]) for k in range(3)]]
            else:
                return None
        kind = np.dtype(fields)
        if lists and (i + 1 < len(parts) or at + n * kind.itemsize != size):
            return None  # some face isn't a triangle, or it can't be told
        out[name] = (at, n, kind)
        at += n * kind.itemsize
    return out


class _Range(InputPartition):
    def __init__(self, file: str, first: int | None, last: int):
        self.file, self.first, self.last = file, first, last


class PlyReader(DataSourceReader):
    def __init__(self, path: str, element: str, size: int):
        self.path, self.element, self.size = path, element, size

    def partitions(self) -> list[_Range]:
        system, files = _files(self.path)
        out = []
        for f in files:
            with system.open_input_file(f.path) as stream:
                layout = _layout(stream.read(HEAD), f.size)
            if layout is None:
                out.append(_Range(f.path, None, 0))
            elif self.element in layout:
                _, n, kind = layout[self.element]
                step = max(1, self.size // kind.itemsize)
                out += [_Range(f.path, k, min(n, k + step)) for k in range(0, n, step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = _files(self.path)
        key, columns = ("vid", ["x", "y", "z"]) if self.element == "vertex" else ("fid", ["i0", "i1", "i2"])
        number = pa.float64() if key == "vid" else pa.int32()

        def batch(first: int, values: dict[str, np.ndarray]) -> pa.RecordBatch:
            n = len(values[columns[0]])
            cols = [pa.array([partition.file] * n, pa.string()), pa.array(np.arange(first, first + n), pa.int64()), *[pa.array(np.ascontiguousarray(values[c]).astype(number.to_pandas_dtype())) for c in columns]]
            return pa.RecordBatch.from_arrays(cols, ["file", key, *columns])

        with system.open_input_file(partition.file) as stream:
            if partition.first is None:
                table = parse_ply(stream.read()).get(self.element)
                if table is not None and len(table):
                    yield batch(0, {c: table[c].to_numpy() for c in columns})
                return
            at, _, kind = _layout(stream.read(HEAD), stream.size())[self.element]
            for k in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - k)
                stream.seek(at + k * kind.itemsize)
                rows = np.frombuffer(stream.read(n * kind.itemsize), kind)
                yield batch(k, {c: rows[c] for c in columns})


class PlySource(DataSource):
    """spark.read.format("ply").option("element", "vertex" or "face").load(path): a file, or the .ply files of a folder.

    Rows are those of readers.read_ply(). bytes: the size of a task's range.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("element", "vertex")]

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options["path"], self.options.get("element", "vertex"), int(self.options.get("bytes", RANGE)))
