"""Key-value logs of the first generation: framed files, last sequence wins, a torn tail is cut and a corrupt frame is an error.

A frame here is: magic ``KVF1``, unsigned 32-bit length, CRC32 of the body, body; a body is a JSON object of sequence, kind
(put or delete), key and value.  Files are read whole by ``binaryFile`` and decoded in Arrow batches, a file in each row.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.records import bounded, heads
from rillstone.schema import Corruption

MAGIC = b"KVF1"
SCHEMA = "sequence long, kind string, key string, value string"


def frame(sequence: int, kind: str, key: str, value: str | None = None) -> bytes:
    body = json.dumps([sequence, kind, key, value]).encode()
    return MAGIC + struct.pack("<II", len(body), zlib.crc32(body)) + body


def decode(data: bytes) -> list[tuple]:
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != MAGIC[: len(data) - at]:
            raise Corruption(f"no frame at byte {at}")
        if at + 12 > len(data):
            break
        size, check = struct.unpack_from("<II", data, at + 4)
        if at + 12 + size > len(data):
            break  # a torn tail
        body = data[at + 12 : at + 12 + size]
        if zlib.crc32(body) != check:
            raise Corruption(f"wrong checksum at byte {at}")
        out.append(tuple(json.loads(body)))
        at += 12 + size
    return out


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for data in b.column(0).to_pylist():
                rows = decode(data)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["sequence", "kind", "key", "value"])

    return spark.read.format("binaryFile").load(list(paths)).select("content").mapInArrow(run, SCHEMA)


def current(log: DataFrame) -> DataFrame:
    return heads(log, ["key"], "sequence").withColumn("tombstone", F.col("kind") == "delete")


def live_export(log: DataFrame, most: int) -> DataFrame:
    """Live keys in order, or ResourceLimit above ``most``."""
    return bounded(current(log).filter("not tombstone").select("key", "value", "sequence"), most).orderBy("key")


def snapshot(log: DataFrame, path: str) -> int:
    rows = current(log).filter("not tombstone").select("key", "value", "sequence")
    rows.write.mode("overwrite").parquet(path)
    return log.sparkSession.read.parquet(path).count()
