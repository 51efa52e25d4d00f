"""Exports of one file that other programs open: CSV, text, ZIP.

Tasks write their parts beside the target, and where each entry is; the commit puts
them together in the order of partitions under another name and then renames it. Until
then the old file is there, and after a failed task it stays. It is for exports that a
person opens; tables go to Parquet.
"""

from __future__ import annotations

import csv
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "one_file"
MARK = "﻿"
#: Bytes copied at once.
PIECE = 1 << 20
#: ZIP: 1980-01-01, so that equal entries give equal files; UTF-8 names; deflated.
_DATE, _UTF8, _DEFLATED = (1 << 5) | 1, 0x800, 8
_MOST = 0xFFFFFFFF


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    size: int
    crc: int
    rows: int


class _Out:
    """A stream that knows its length and CRC-32."""

    def __init__(self, stream) -> None:  # noqa: ANN001
        self.stream, self.size, self.crc = stream, 0, 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)


def _local(name: bytes, crc: int, packed: int, size: int) -> bytes:
    return struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, _UTF8, _DEFLATED, 0, _DATE, crc, packed, size, len(name), 0) + name


def _central(name: bytes, crc: int, packed: int, size: int, at: int) -> bytes:
    far = struct.pack("<HHQ", 1, 8, at) if at >= _MOST else b""
    return struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45 if far else 20, 45 if far else 20, _UTF8, _DEFLATED, 0, _DATE, crc, packed, size, len(name), len(far), 0, 0, 0, 0, min(at, _MOST)) + name + far


def _ending(count: int, size: int, at: int) -> bytes:
    out = b""
    if count >= 0xFFFF or size >= _MOST or at >= _MOST:
        out = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, at) + struct.pack("<4sIQI", b"PK\6\7", 0, at + size, 1)
    return out + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, _MOST), min(at, _MOST), 0)


class OneFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.target, self.kind, self.names = options["path"], options.get("kind", "csv"), names
        self.bom, self.between = options.get("bom", "true").lower() == "true", options.get("between", "\n")
        if self.kind not in ("csv", "text", "zip"):
            raise ValueError(f"kind is csv, text or zip, not {self.kind}")
        if self.kind == "zip" and self.names != ["name", "content"] or self.kind == "text" and len(self.names) != 1:
            raise ValueError("a ZIP takes the columns name and content, a text one column")
        self.parts = f"{self.target.rstrip('/')}.parts-{uuid.uuid4().hex[:12]}"

    def _where(self, uri: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        where, folder = self._where(self.parts)
        where.create_dir(folder, recursive=True)
        path, rows = f"{folder}/{number:06d}-{attempt}", 0
        with where.open_output_stream(path) as stream, where.open_output_stream(path + ".index") as index:
            out = _Out(stream)
            for batch in iterator:
                rows += batch.num_rows
                columns = [c.to_pylist() for c in batch.columns]
                if self.kind == "csv":
                    lines = io.StringIO()
                    csv.writer(lines).writerows(["" if v is None else v for v in r] for r in zip(*columns))
                    out.write(lines.getvalue().encode())
                elif self.kind == "text":
                    out.write("".join((v or "") + self.between for v in columns[0]).encode())
                else:
                    for name, content in zip(*columns):
                        data = content.encode() if isinstance(content, str) else bytes(content or b"")
                        press = zlib.compressobj(6, zlib.DEFLATED, -15)
                        packed = press.compress(data) + press.flush()
                        entry = [str(name), zlib.crc32(data), len(packed), len(data), out.size]
                        index.write((json.dumps(entry) + "\n").encode())
                        out.write(_local(entry[0].encode(), *entry[1:4]) + packed)
        return Part(number, path, out.size, out.crc, rows)

    def _copied(self, where: fs.FileSystem, part: Part, out: _Out) -> None:
        crc = 0
        with where.open_input_stream(part.path) as f:
            while data := f.read(PIECE):
                crc = zlib.crc32(data, crc)
                out.write(data)
        if crc != part.crc:
            raise OSError(f"{part.path} is not what its task wrote")

    def commit(self, messages: list[Part | None]) -> None:
        where, folder = self._where(self.parts)
        _, target = self._where(self.target)
        parts, whole = sorted((m for m in messages if m is not None), key=lambda m: m.partition), folder + ".whole"
        try:
            with where.open_output_stream(whole) as stream:
                out = _Out(stream)
                if self.kind == "csv":
                    head = io.StringIO()
                    csv.writer(head).writerow(self.names)
                    out.write(((MARK if self.bom else "") + head.getvalue()).encode())
                starts = []
                for part in parts:
                    starts.append(out.size)
                    self._copied(where, part, out)
                if self.kind == "zip":
                    at, count = out.size, 0
                    for part, start in zip(parts, starts):
                        with where.open_input_stream(part.path + ".index") as f:
                            for line in io.TextIOWrapper(f, "utf-8"):
                                name, *numbers, place = json.loads(line)
                                out.write(_central(name.encode(), *numbers, start + place))
                                count += 1
                    out.write(_ending(count, out.size - at, at))
            if not isinstance(where, fs.LocalFileSystem) and where.get_file_info(target).type != fs.FileType.NotFound:
                where.delete_file(target)  # not every store renames onto a file
            where.move(whole, target)
        finally:
            self._cleared(where, folder, whole)

    def abort(self, messages: list[Part | None]) -> None:
        where, folder = self._where(self.parts)
        self._cleared(where, folder, folder + ".whole")

    def _cleared(self, where: fs.FileSystem, folder: str, whole: str) -> None:
        if where.get_file_info(folder).type == fs.FileType.Directory:
            where.delete_dir(folder)
        if where.get_file_info(whole).type == fs.FileType.File:
            where.delete_file(whole)


class OneFile(DataSource):
    """Options: ``path``; ``kind`` csv (a header, CR LF, nulls empty), text (one column, each value with ``between`` after it) or zip (``name``, ``content``); ``bom`` of a CSV (true)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> OneFileWriter:  # noqa: ANN001
        return OneFileWriter(dict(self.options), schema.names)


def write(df: DataFrame, path: str, kind: str = "csv", **options: object) -> None:
    """Writes ``df`` as one file at ``path``, which all tasks and the driver must see, in place of what is there. Rows are in the order of partitions, as after ``orderBy``; columns of other types are cast to strings."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(OneFile)
    plain = df.select(*[df[f"`{c}`"] if k in ("string", "binary") else df[f"`{c}`"].cast("string").alias(c) for c, k in df.dtypes])
    plain.write.format(FORMAT).options(kind=kind, **options).mode("overwrite").save(path)
