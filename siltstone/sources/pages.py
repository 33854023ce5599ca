"""Dictionary pages of Parquet column chunks, read without their data pages.

The library reads footers and whole chunks, but neither tells which pages of a chunk are coded by its
dictionary nor gives the dictionary alone; both are read here from the file format: structures in
Thrift's compact protocol.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Fixed values of the format: physical types, codecs, encodings, page types.
INT32, INT64, FLOAT, DOUBLE, BYTE_ARRAY = 1, 2, 4, 5, 6
CODECS = {0: None, 1: "snappy", 2: "gzip", 4: "brotli", 5: "lz4", 6: "zstd", 7: "lz4_raw"}
DICTIONARY_ENCODINGS, DATA_PAGES, DICTIONARY_PAGE = (2, 8), (0, 3), 2
NUMPY = {INT32: "<i4", INT64: "<i8", FLOAT: "<f4", DOUBLE: "<f8"}


class Compact:
    """Reads values of the compact protocol from bytes; structures become dicts by field number."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def signed(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def read(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            return self.signed()
        if kind == 7:
            self.at += 8
            return struct.unpack("<d", self.data[self.at - 8 : self.at])[0]
        if kind == 8:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (9, 10):
            head = self.byte()
            n, item = head >> 4, head & 15
            n = self.varint() if n == 15 else n
            return [self.byte() == 1 if item in (1, 2) else self.read(item) for _ in range(n)]
        if kind == 12:
            return self.structure()
        raise ValueError(f"a value of kind {kind}")

    def structure(self) -> dict:
        out, field = {}, 0
        while head := self.byte():
            field = field + (head >> 4) if head >> 4 else self.signed()
            out[field] = self.read(head & 15)
        return out


@dataclass
class Chunk:
    """Where a chunk's dictionary lies, whether all of its data is coded by it, and whether its extrema are marked as exact."""

    physical: int
    codec: int
    offset: int | None
    complete: bool
    exact: bool


def chunks(file: pa.NativeFile) -> list[dict[str, Chunk]]:
    """Of each row group the flat columns' chunks by name."""
    size = file.size()
    file.seek(size - 8)
    length = struct.unpack("<i", file.read(4))[0]
    file.seek(size - 8 - length)
    footer = Compact(file.read(length)).structure()
    groups = []
    for group in footer.get(4, []):
        own = {}
        for column in group[1]:
            meta = column[3]
            path = [p.decode() for p in meta[3]]
            if len(path) != 1:
                continue
            data = [s for s in meta.get(13, []) if s[1] in DATA_PAGES and s[3] > 0]
            own[path[0]] = Chunk(meta[1], meta[4], meta.get(11), bool(data) and all(s[2] in DICTIONARY_ENCODINGS for s in data), meta.get(12, {}).get(7) is True and meta.get(12, {}).get(8) is True)
        groups.append(own)
    return groups


def dictionary(file: pa.NativeFile, chunk: Chunk) -> np.ndarray | list[bytes] | None:
    """The values of a chunk's dictionary in their physical form; None where they don't stand for all of its data or can't be read."""
    if not chunk.complete or not chunk.offset or chunk.codec not in CODECS or chunk.physical not in (*NUMPY, BYTE_ARRAY):
        return None
    file.seek(chunk.offset)
    head = Compact(file.read(256))
    page = head.structure()
    if page.get(1) != DICTIONARY_PAGE:
        return None
    file.seek(chunk.offset + head.at)
    raw = file.read(page[3])
    if codec := CODECS[chunk.codec]:
        raw = pa.decompress(raw, page[2], codec, asbytes=True)
    n = page[7][1]
    if chunk.physical in NUMPY:
        return np.frombuffer(raw, NUMPY[chunk.physical], n)
    values, at = [], 0
    for _ in range(n):
        size = int.from_bytes(raw[at : at + 4], "little")
        values.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return values


def physical(values: pa.Array) -> np.ndarray | list[bytes]:
    """Values without nulls in the form that a dictionary has; other types as the text of each."""
    t = values.type
    if pa.types.is_timestamp(t) or pa.types.is_time64(t) or pa.types.is_duration(t):
        return values.cast(pa.int64()).to_numpy()
    if pa.types.is_date32(t) or pa.types.is_time32(t):
        return values.cast(pa.int32()).to_numpy()
    if pa.types.is_integer(t) or pa.types.is_floating(t):
        return values.to_numpy()
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return values.cast(pa.large_binary()).to_pylist()
    if pa.types.is_binary(t) or pa.types.is_large_binary(t):
        return values.to_pylist()
    return [repr(v).encode() for v in values.to_pylist()]


def hashes(values: np.ndarray | list[bytes]) -> np.ndarray:
    """A 64-bit number for each value, the same for the same value of a column; numbers never collide."""
    if isinstance(values, list):
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(v) for v in values], np.uint64).view(np.int64)
    if values.dtype.kind == "f":
        wide = values.astype(np.float64) + 0.0
        return np.where(np.isnan(wide), np.float64("nan"), wide).view(np.int64)
    return values.astype(np.uint64 if values.dtype == np.uint64 else np.int64).view(np.int64)
