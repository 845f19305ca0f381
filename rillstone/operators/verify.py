"""Integrity checks: anti-joins and aggregates that must come out empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events_without_version(events: DataFrame, versions: DataFrame, key: list[str]) -> DataFrame:
    return events.join(versions.select(*key).distinct(), key, "left_anti")


def heads_without_version(heads: DataFrame, versions: DataFrame, key: list[str]) -> DataFrame:
    return heads.join(versions.select(*key).distinct(), key, "left_anti")


def last_sequence_mismatch(events: DataFrame, catalog: DataFrame, sequence: str = "seq") -> DataFrame:
    """Shards whose last event isn't the catalog's sequence; a shard without events is valid."""
    last = events.groupBy("shard").agg(F.max(sequence).alias("last"))
    return catalog.join(last, "shard").filter(F.col("last") != F.col("latest"))


def repeated_versions(versions: DataFrame, key: list[str]) -> DataFrame:
    return versions.groupBy(*key).count().filter("count > 1")


def summary(versions: DataFrame, heads: DataFrame, sequence: str = "seq") -> DataFrame:
    a = versions.agg(F.count("*").alias("events"), F.max(sequence).alias("last"))
    return a.join(F.broadcast(heads.agg(F.count("*").alias("heads"))))
