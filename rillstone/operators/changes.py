"""Change pages, gaps, consumers and garbage collection over per-shard sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.operators.records import batch_aligned
from rillstone.schema import MAX_PAGE, ChangeLogGap, InvalidArgument


def page(events: DataFrame, shard: int, after: int, limit: int, sequence: str = "seq", batch: str = "batch_id", aligned: bool = True) -> DataFrame:
    """Events of one shard after a sequence, in order; the shard and sequence filters reach the scan."""
    found = events.filter((F.col("shard") == shard) & (F.col(sequence) > after))
    return batch_aligned(found, sequence, batch, limit) if aligned else found.orderBy(sequence).limit(limit)


def checked_page(events: DataFrame, shard: int, after: int, limit: int, sequence: str = "seq", batch: str = "batch_id") -> list:
    """As ``page``, with the errors of the contract: limit, watermark beyond the end, inside a batch, or a gap."""
    if limit > MAX_PAGE:
        raise InvalidArgument(f"a page has at most {MAX_PAGE} events")
    if limit == 0:
        return []
    mine = events.filter(F.col("shard") == shard)
    latest = mine.agg(F.coalesce(F.max(sequence), F.lit(0))).first()[0]
    if after > latest:
        raise InvalidArgument("the watermark is after the latest event")
    rows = page(events, shard, after, limit, sequence, batch).collect()  # at most limit + one batch
    if rows and rows[0][sequence] != after + 1:
        raise ChangeLogGap(f"events after {after} are gone")
    if rows and rows[0][batch] <= after:
        raise InvalidArgument("the watermark is inside a batch")
    return rows


def gaps(events: DataFrame, by: str = "shard", sequence: str = "seq") -> DataFrame:
    """(shard, after, before): holes in the sequence."""
    w = Window.partitionBy(by).orderBy(sequence)
    return events.select(by, F.lag(sequence).over(w).alias("after"), F.col(sequence).alias("before")).filter("before - after > 1")


def with_previous(events: DataFrame, key: list[str], order: str, created: str) -> DataFrame:
    """previous version and first time of each identity."""
    w = Window.partitionBy(*key).orderBy(order)
    return events.withColumn("previous", F.lag(order).over(w)).withColumn("created_ms", F.first(created).over(w))


def safe_watermark(required: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """(shard, watermark): the least acknowledged sequence of all required consumers; an absent one counts 0."""
    met = required.join(acknowledged, ["consumer", "shard"], "left")
    return met.groupBy("shard").agg(F.min(F.coalesce("watermark", F.lit(0))).alias("watermark"))


def collectable(events: DataFrame, watermarks: DataFrame, heads: DataFrame, key: list[str], sequence: str = "seq", batch: str = "batch_id") -> DataFrame:
    """(shard, seq, is_head): events whose whole batch is at or below the safe watermark; head versions stay."""
    ends = events.groupBy("shard", batch).agg(F.max(sequence).alias("_end"))
    done = events.join(ends, ["shard", batch]).join(watermarks, "shard").filter(F.col("_end") <= F.col("watermark"))
    current = heads.select(*key, F.col(sequence), F.lit(True).alias("_head"))
    return done.join(current, [*key, sequence], "left").select("shard", *key, sequence, F.coalesce("_head", F.lit(False)).alias("is_head"))


def lag(latest: DataFrame, watermarks: DataFrame) -> DataFrame:
    """(consumer, shard, stale): events not yet acknowledged, 0 at least."""
    return watermarks.join(latest, "shard").select("consumer", "shard", F.greatest(F.col("latest") - F.col("watermark"), F.lit(0)).alias("stale"))
