"""TFRecord files of examples with bytes and integer features: a data source that reads and writes them.

    spark.dataSource.register(TfRecordSource)
    spark.read.format("tfrecord").schema("input_uri string, page_no long").load("/data/*.tfrecord.gz")
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, LongType, StructType


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)  # Castagnoli's polynomial, reversed
        out.append(n)
    return out


_CRC = _table()


def masked_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ _CRC[(c ^ b) & 255]
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def read_frames(source: bytes | BinaryIO) -> Iterator[bytes]:
    """Records of a file's bytes or of a stream; of a stream one record is held at a time."""
    read = (io.BytesIO(source) if isinstance(source, bytes | bytearray) else source).read
    while head := read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
            raise ValueError("a record's length is damaged")
        (n,) = struct.unpack("<Q", head[:8])
        data = read(n + 4)
        if len(data) < n + 4:
            raise ValueError("the last record is cut short")
        yield data[:n]


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", masked_crc(head)) + data + struct.pack("<I", masked_crc(data))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _to_varint(v: int) -> bytes:
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
        elif key & 7 == 2:
            n, at = _varint(data, at)
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"a field of wire type {key & 7} is not among those of examples")


def _part(number: int, data: bytes) -> bytes:
    return _to_varint(number << 3 | 2) + _to_varint(len(data)) + data


def decode_example(data: bytes) -> dict[str, bytes | int]:
    """Features of one value each, bytes or an integer."""
    out: dict[str, bytes | int] = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            pair = dict(_fields(entry))
            for kind, values in _fields(pair[2]):
                for _, v in _fields(values):
                    if kind == 1:
                        out[pair[1].decode()] = v
                    elif kind == 3:
                        n = _varint(v, 0)[0] if isinstance(v, bytes) else v
                        out[pair[1].decode()] = n - (1 << 64) if n >= 1 << 63 else n
                    else:
                        raise ValueError("only bytes and integers are read")
    return out


def encode_example(props: dict) -> bytes:
    out = b""
    for k, v in props.items():
        if v is None:
            continue
        if isinstance(v, bool | int):
            feature = _part(3, _part(1, _to_varint(int(v))))
        elif isinstance(v, str | bytes | bytearray):
            feature = _part(1, _part(1, v.encode() if isinstance(v, str) else bytes(v)))
        else:
            raise TypeError(f"{k}: neither text, bytes nor an integer")
        out += _part(1, _part(1, k.encode()) + _part(2, feature))
    return _part(1, out)


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    import fnmatch

    store, root = fs.FileSystem.from_uri(path if ":" in path else os.path.abspath(path))
    if any(c in root for c in "*?["):
        folder, _, pattern = root.rpartition("/")
        found = store.get_file_info(fs.FileSelector(folder))
        return store, sorted(f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern))
    info = store.get_file_info(root)
    if info.is_file:
        return store, [root]
    return store, sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", ".")))


def records(store: fs.FileSystem, path: str) -> Iterator[dict[str, bytes | int]]:
    """A file's records, packed or plain, as they are read: nothing but the current one is held."""
    with store.open_input_stream(path, compression=None) as f:
        packed = f.read(2) == b"\x1f\x8b"
    with store.open_input_stream(path, compression="gzip" if packed else None) as f:
        for r in read_frames(io.BufferedReader(f, 1 << 20)):
            yield decode_example(r)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in _files(self.path)[1]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path if ":" in self.path else "/")
        for r in records(store, partition.value):
            row = []
            for f in self.schema.fields:
                v = r.get(f.name)
                row.append(v if v is None or isinstance(v, int) or isinstance(f.dataType, BinaryType) else v.decode())
            yield tuple(row)


@dataclass
class _Written(WriterCommitMessage):
    root: str
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path = schema.names, options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path if ":" in self.path else os.path.abspath(self.path))
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.tfrecord.gz"
        with store.open_output_stream(f"{root}/.{name}", compression="gzip") as f:
            for r in rows:
                f.write(frame(encode_example(dict(zip(self.names, r, strict=True)))))
        return _Written(root, name)

    def commit(self, messages: list) -> None:
        """Files of tasks that count get their names; those of attempts that were lost stay hidden and are never read."""
        store, _ = fs.FileSystem.from_uri(self.path if ":" in self.path else "/")
        for m in messages:
            if m is not None:
                store.move(f"{m.root}/.{m.name}", f"{m.root}/{m.name}")

    def abort(self, messages: list) -> None:
        store, _ = fs.FileSystem.from_uri(self.path if ":" in self.path else "/")
        for m in messages:
            if m is not None:
                store.delete_file(f"{m.root}/.{m.name}")


class TfRecordSource(DataSource):
    """Options: path. Columns are features: binary or string for bytes, long or int for integers."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> StructType:
        store, files = _files(self.options["path"])
        first = next((r for p in files for r in records(store, p)), {})
        out = StructType()
        for k, v in sorted(first.items()):
            out.add(k, LongType() if isinstance(v, int) else BinaryType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options)


def training_examples(df, pages: tuple[int, int] | None = None, epochs: int = 1, seed: int | None = None):
    """Records as a trainer reads them: pages within a range, in an order drawn with the seed, once an epoch."""
    from pyspark.sql import functions as F

    if pages:
        df = df.where(F.col("page_no").between(*pages))
    df = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return df.orderBy("epoch", F.xxhash64("input_uri", "page_no", F.lit(seed), "epoch")) if seed is not None else df
