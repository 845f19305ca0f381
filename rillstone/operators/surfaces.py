"""Surfaces: filtered, capped, generational views kept up by folding change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators.records import byte_capped


def accepts(states: list[str], at_ms: int | None = None) -> Column:
    """Not a tombstone, not expired, state in the list."""
    ok = ~F.col("tombstone") & F.col("state").isin(*states)
    return ok if at_ms is None else ok & (F.col("expires_ms").isNull() | (F.col("expires_ms") > at_ms))


def rebuild(heads: DataFrame, ok: Column) -> DataFrame:
    return heads.filter(ok)


def fold(generation: DataFrame, events: DataFrame, key: list[str], order: str, ok: Column) -> DataFrame:
    """The next full state: each identity's last event replaces or removes its row.

    Only the last event counts because acceptance depends on that event's record alone; the events are reduced to one
    row for each identity before they meet the generation.
    """
    rest = [c for c in events.columns if c not in key]
    last = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    kept = generation.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.filter(ok).select(*generation.columns))


def capped(state: DataFrame, order: list[Column], size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    return byte_capped(state, order, size, most_rows, most_bytes)


def staleness(latest: DataFrame, watermarks: DataFrame) -> DataFrame:
    """(shard, stale) and whether all are 0."""
    met = latest.join(watermarks, "shard", "left").select("shard", F.greatest(F.col("latest") - F.coalesce("watermark", F.lit(0)), F.lit(0)).alias("stale"))
    return met
