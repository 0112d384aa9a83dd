"""PNG pictures as a data source: ``spark.read.format("pictures")`` and its writers.

Only what the schema asks for is read. Without planes among its columns a picture's header is read and
nothing is decoded. Filters on the path choose files before tasks are planned; filters on what the header
says choose pictures before they are decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sinks.pictures import STAGED, PictureStreamWriter, PictureWriter
from .png import SIGNATURE, decode_png, opened

FORMAT = "pictures"
SCHEMA = (
    "path string, bytes bigint, height int, width int, depth int, colour int, tag string, "
    "r array<int>, g array<int>, b array<int>"
)
_PLANES = ("r", "g", "b")
_HEADER = ("height", "width", "depth", "colour")
#: A task reads files of about this many bytes, and no more files than that; a batch holds a few pictures.
TASK_BYTES = 64_000_000
TASK_FILES = 1_000
AT_ONCE = 8


@dataclass
class Files(ds.InputPartition):
    """Paths and sizes of the files of one task."""

    paths: list[str]
    sizes: list[int]


def read_header(stream) -> dict[str, object]:
    """Height, width, depth, colour type and PQ tag (hexadecimal or null) from the chunks before the data."""
    if stream.read(8) != SIGNATURE:
        raise ValueError("not a PNG file")
    found: dict[str, object] = {"tag": None}
    while len(head := stream.read(8)) == 8:
        length, name = struct.unpack(">I4s", head)
        if name in (b"IDAT", b"IEND"):
            break
        body = stream.read(length + 4)[:length]
        if name == b"IHDR":
            found["width"], found["height"], found["depth"], found["colour"] = struct.unpack_from(">IIBB", body)
        elif name == b"cICP":
            found["tag"] = body.hex()
    return found


_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda value, wanted: value == wanted,
    ds.In: lambda value, wanted: value in wanted,
    ds.GreaterThan: lambda value, wanted: value > wanted,
    ds.GreaterThanOrEqual: lambda value, wanted: value >= wanted,
    ds.LessThan: lambda value, wanted: value < wanted,
    ds.LessThanOrEqual: lambda value, wanted: value <= wanted,
    ds.StringStartsWith: lambda value, wanted: value.startswith(wanted),
    ds.StringEndsWith: lambda value, wanted: value.endswith(wanted),
    ds.StringContains: lambda value, wanted: wanted in value,
    ds.IsNotNull: lambda value, wanted: True,
}


class PictureReader(ds.DataSourceReader):
    def __init__(self, folder: str, schema: StructType, task_bytes: int, task_files: int):
        self.folder, self.schema = folder.rstrip("/"), schema
        self.task_bytes, self.task_files = task_bytes, task_files
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Filters on the path and the header are taken over; others are left to Spark."""
        for one in filters:
            known = type(one) in _TESTS and len(one.attribute) == 1 and one.attribute[0] in ("path", *_HEADER)
            if known:
                self.tests.append((one.attribute[0], type(one), getattr(one, "value", None)))
            else:
                yield one

    def _passes(self, values: dict[str, object]) -> bool:
        return all(_TESTS[kind](values[name], wanted) for name, kind, wanted in self.tests if name in values)

    def partitions(self) -> list[Files]:
        """Files by path, as many to a task as its bytes allow."""
        from pyarrow import fs

        system, root = opened(self.folder)
        tasks, room = [Files([], [])], self.task_bytes
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        for info in sorted(found, key=lambda info: info.path):
            below = info.path.removeprefix(root).lstrip("/")
            path = f"{self.folder}/{below}"
            if not info.is_file or not below.lower().endswith(".png") or below.startswith(STAGED) or not self._passes({"path": path}):
                continue
            if tasks[-1].paths and (info.size > room or len(tasks[-1].paths) >= self.task_files):
                tasks.append(Files([], []))
                room = self.task_bytes
            tasks[-1].paths.append(path)
            tasks[-1].sizes.append(info.size)
            room -= info.size
        return tasks

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = set(self.schema.names)
        planes, header = bool(names & set(_PLANES)), bool(names & {*_HEADER, "tag"}) or bool(self.tests)
        kinds = to_arrow_schema(self.schema)
        rows: list[dict] = []
        for path, size in zip(partition.paths, partition.sizes, strict=True):
            row: dict[str, object] = {"path": path, "bytes": size}
            system, name = opened(path)
            if header or planes:
                with system.open_input_stream(name, buffer_size=4096) as stream:
                    row |= read_header(stream)
                if not self._passes(row):
                    continue
            if planes:
                with system.open_input_stream(name) as stream:
                    picture, _ = decode_png(stream.read())
                row |= {c: plane.ravel() for c, plane in zip(_PLANES, picture, strict=True)}
            rows.append(row)
            if len(rows) >= (AT_ONCE if planes else self.task_files):
                yield _batch(rows, kinds)
                rows = []
        if rows:
            yield _batch(rows, kinds)


def _batch(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[f.name] for row in rows], f.type) for f in kinds], schema=kinds)


class Pictures(ds.DataSource):
    """Options: ``path``, when reading ``taskBytes`` and ``taskFiles``, when writing ``depth`` (16 or 8) and
    ``tagPq`` (with 16 bits). The schema may name any of SCHEMA's columns. Written are ``name`` (below
    the folder), ``height``, ``width`` and the signals ``r g b`` in [0, 1]; a picture of a name that
    exists replaces it, and mode ``overwrite`` removes all others."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PictureReader:
        number = lambda key, default: int(self.options.get(key, default))
        known = dict(column.split() for column in SCHEMA.split(", "))
        wrong = [f.name for f in schema if known.get(f.name) != f.dataType.simpleString()]
        if wrong:
            raise ValueError(f"pictures have no such columns: {wrong}")
        return PictureReader(self.options["path"], schema, number("taskBytes", TASK_BYTES), number("taskFiles", TASK_FILES))

    def _writing(self) -> dict:
        depth = int(self.options.get("depth", 16))
        return {"depth": depth, "tag_pq": depth == 16 and self.options.get("tagPq", "true").lower() == "true"}

    def writer(self, schema: StructType, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options["path"], schema, **self._writing(), overwrite=overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> PictureStreamWriter:
        return PictureStreamWriter(self.options["path"], schema, **self._writing())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pictures)
