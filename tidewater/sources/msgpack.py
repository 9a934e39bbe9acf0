"""Modules in MessagePack: a data source that decodes one object after another from each file."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from tidewater.sources import ir
from tidewater.spark import ship

#: Objects nested deeper than this are an error.
DEPTH = 64
#: Format by first byte: numbers as struct codes; lengths of strings, bytes, arrays, maps and extensions as the code of their length.
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_TEXT, _BYTES = {0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}, {0xC4: ">B", 0xC5: ">H", 0xC6: ">I"}
_ARRAYS, _MAPS, _EXTENSIONS = {0xDC: ">H", 0xDD: ">I"}, {0xDE: ">H", 0xDF: ">I"}, {0xC7: ">B", 0xC8: ">H", 0xC9: ">I"}


def objects(stream) -> Iterator[object]:  # noqa: ANN001
    """The objects of a binary stream, one at a time; a stream that ends within one raises ValueError."""

    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) < n:
            raise ValueError(f"truncated MessagePack: {n} bytes wanted, {len(got)} left")
        return got

    def number(code: str):  # noqa: ANN202
        return struct.unpack(code, take(struct.calcsize(code)))[0]

    def value(b: int, depth: int) -> object:
        if depth > DEPTH:
            raise ValueError(f"MessagePack nested deeper than {DEPTH}")
        if b <= 0x7F:
            return b
        if b >= 0xE0:
            return b - 256
        if 0xA0 <= b <= 0xBF or b in _TEXT:
            return take(number(_TEXT[b]) if b in _TEXT else b & 31).decode()
        if 0x90 <= b <= 0x9F or b in _ARRAYS:
            return [value(take(1)[0], depth + 1) for _ in range(number(_ARRAYS[b]) if b in _ARRAYS else b & 15)]
        if 0x80 <= b <= 0x8F or b in _MAPS:
            pairs = ((value(take(1)[0], depth + 1), value(take(1)[0], depth + 1)) for _ in range(number(_MAPS[b]) if b in _MAPS else b & 15))
            return dict(pairs)
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b in _NUMBERS:
            return number(_NUMBERS[b])
        if b in _BYTES:
            return take(number(_BYTES[b]))
        if b in _EXTENSIONS or 0xD4 <= b <= 0xD8:
            return take((number(_EXTENSIONS[b]) if b in _EXTENSIONS else 1 << (b - 0xD4)) + 1)[1:]
        raise ValueError(f"no MessagePack format begins with {b:#x}")

    while first := stream.read(1):
        yield value(first[0], 0)


def shaped(value: object, kind: DataType) -> object:
    """A decoded object as a schema's value: maps by name, arrays of a struct's fields by place; what is absent is null."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        named = value if isinstance(value, dict) else dict(zip(kind.names, value, strict=False))
        return tuple(shaped(named.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return [shaped(v, kind.elementType) for v in value]
    if isinstance(kind, StringType):
        return value.decode() if isinstance(value, bytes) else str(value)
    return value


@dataclass
class File(InputPartition):
    path: str


class MessagePackSource(DataSource):
    """``spark.read.format("msgpack").schema(...).load(path)``: a file, or a folder of files; each file is a task, read as a stream."""

    @classmethod
    def name(cls) -> str:
        return "msgpack"

    def schema(self) -> str:
        return ir.MODULE_JSON

    def reader(self, schema: StructType) -> MessagePackReader:
        return MessagePackReader(self.options["path"], schema)


class MessagePackReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.kind = path if "://" in path else f"file://{path}", schema

    def partitions(self) -> list[File]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [File(path)]
        files = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [File(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: File | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is not None:
            system, _ = fs.FileSystem.from_uri(self.path)
            with system.open_input_stream(partition.path, buffer_size=1 << 20) as stream:
                for found in objects(stream):
                    yield shaped(found, self.kind)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``ir.read_json`` from modules in MessagePack."""
    ship(spark)
    spark.dataSource.register(MessagePackSource)
    return ir.tables(spark.read.format("msgpack").load(path))
