"""Orders and checks over record identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillstone.schema import IDENTITY, MAX_COMPONENT, SHARDS


def scan_order(columns: tuple[str, ...] = IDENTITY) -> list[Column]:
    """Order of scans and ties: each component by length, then by bytes."""
    return [x for c in columns for x in (F.octet_length(c), F.col(c))]


def surface_order(columns: tuple[str, ...] = IDENTITY) -> list[Column]:
    """Order of surfaces: component bytes without length."""
    return [F.col(c) for c in columns]


def shard_of(*partition: str, shards: int = SHARDS) -> Column:
    """Shard of a partition; any stable hash will do, shard numbers are no contract."""
    return F.pmod(F.xxhash64(*partition), F.lit(shards)).cast("int")


def identity_problem(columns: tuple[str, ...] = IDENTITY, most: int = MAX_COMPONENT) -> Column:
    """Null for a valid identity, else the first component that is null, empty or too long."""
    return F.coalesce(*[F.when(F.col(c).isNull() | (F.octet_length(c) == 0) | (F.octet_length(c) > most), F.lit(c)) for c in columns])


def prefixed(column: str, prefix: str | bytes) -> Column:
    """Key prefix; Spark turns it into a pushed Parquet filter for text keys."""
    return F.col(column).startswith(F.lit(prefix)) if isinstance(prefix, bytes) else F.col(column).startswith(prefix)
