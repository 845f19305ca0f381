"""Adaptive zstd frames for payload bytes: an Arrow-batched encoder and a checked decoder.

A frame is one codec byte (0 raw, 1 zstd), the raw length (8 bytes) and CRC32 (4 bytes) of the raw bytes, then the body.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.schema import Corruption


@dataclass(frozen=True)
class Policy:
    """level -7..22; inputs below min_input or saving less than min_savings stay raw; so do skipped content types."""

    level: int = 3
    min_input: int = 64
    min_savings: int = 16
    skip_prefixes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not -7 <= self.level <= 22 or self.min_input < 0 or self.min_savings < 0 or len(self.skip_prefixes) > 128:
            raise ValueError("bad compression policy")


def encode(data: bytes, p: Policy, content_type: str | None = None, dictionary: bytes | None = None) -> bytes:
    import zstandard

    head = struct.pack("<QI", len(data), zlib.crc32(data))
    if len(data) >= p.min_input and not any((content_type or "").startswith(x) for x in p.skip_prefixes):
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packed = zstandard.ZstdCompressor(level=p.level, dict_data=d).compress(data)
        if len(packed) + p.min_savings < len(data):
            return b"\1" + head + packed
    return b"\0" + head + data


def decode(frame: bytes, dictionary: bytes | None = None) -> bytes:
    import zstandard

    if len(frame) < 13 or frame[0] > 1:
        raise Corruption("not a payload frame")
    size, check = struct.unpack_from("<QI", frame, 1)
    body = frame[13:]
    if frame[0]:
        try:
            body = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress(body, max_output_size=size)
        except zstandard.ZstdError as e:
            raise Corruption("the body can't be decompressed") from e
    if len(body) != size or zlib.crc32(body) != check:
        raise Corruption("wrong length or checksum")
    return body


def encoded(df: DataFrame, key: str, column: str, p: Policy = Policy()) -> DataFrame:
    """(key, frame) of a binary column; null stays null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else encode(x, p) for x in b.column(1).to_pylist()], pa.binary())], ["key", "frame"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(column).cast("binary").alias("data")).mapInArrow(run, "key string, frame binary")


def decoded(df: DataFrame) -> DataFrame:
    """(key, data) of (key, frame); a broken frame is an error."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else decode(x) for x in b.column(1).to_pylist()], pa.binary())], ["key", "data"])

    return df.select("key", "frame").mapInArrow(run, "key string, data binary")
