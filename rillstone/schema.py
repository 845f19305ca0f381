"""Types, limits and errors of versioned records."""

from __future__ import annotations

from pyspark.sql import types as T

IDENTITY = ("tenant", "namespace", "collection", "partition", "key")

PAYLOAD = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("bytes", T.BinaryType()),
    T.StructField("text", T.StringType()),
    T.StructField("i64", T.LongType()),
    T.StructField("f64", T.DoubleType()),
    T.StructField("bool", T.BooleanType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("vector", T.ArrayType(T.FloatType(), False)),
    T.StructField("document", T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("bytes", T.BinaryType())])),
    T.StructField("blob", T.StructType([T.StructField("id", T.BinaryType()), T.StructField("logical_bytes", T.LongType())])),
])
KINDS = tuple(f.name for f in PAYLOAD.fields[1:])

WORKFLOW = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("lease_id", T.BinaryType()),
    T.StructField("fencing", T.LongType()),
    T.StructField("deadline_ms", T.LongType()),
])

#: One row is a version of a record and the change event that made it.
MUTATION = T.StructType([
    *[T.StructField(c, T.BinaryType(), False) for c in IDENTITY],
    T.StructField("epoch", T.LongType(), False),
    T.StructField("shard", T.IntegerType(), False),
    T.StructField("sequence", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("batch_id", T.LongType(), False),
    T.StructField("previous", T.LongType()),
    T.StructField("payload", PAYLOAD),
    T.StructField("content_type", T.StringType()),
    T.StructField("created_ms", T.LongType()),
    T.StructField("updated_ms", T.LongType()),
    T.StructField("expires_ms", T.LongType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.BinaryType())),
    T.StructField("workflow", WORKFLOW),
    T.StructField("tombstone", T.BooleanType(), False),
    T.StructField("body", T.StringType(), False),
    T.StructField("delta", T.BinaryType()),
    T.StructField("event_present", T.BooleanType(), False),
    T.StructField("version_present", T.BooleanType(), False),
])

#: Default limits.
MAX_COMPONENT = 4 << 10
MAX_METADATA = 64 << 10
MAX_RECORD = 16 << 20
MAX_BATCH_OPS = 1024
MAX_PAGE = 1024
SHARDS = 16
MAX_ATTEMPTS = 5
LEASE_MARGIN_MS = 5_000


class StoreError(Exception):
    """Base of all errors a store raises."""


class InvalidArgument(StoreError): ...


class Conflict(StoreError): ...


class NotFound(StoreError): ...


class ResourceLimit(StoreError): ...


class ChangeLogGap(StoreError): ...


class LeaseError(StoreError): ...


class Corruption(StoreError): ...


class Unsupported(StoreError): ...
