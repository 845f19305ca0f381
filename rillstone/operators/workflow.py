"""TTL sweeps and lease-and-fencing work queues as derivations from current records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.schema import LEASE_MARGIN_MS


def due(entries: DataFrame, at_ms: int, order: list[Column], limit: int, expires: str = "expires_ms") -> DataFrame:
    return entries.filter(F.col(expires) <= at_ms).orderBy(expires, *order).limit(limit)


def split_stale(entries: DataFrame, current: DataFrame, key: list[str], expires: str = "expires_ms") -> DataFrame:
    """Due TTL entries against the current record: expired (same expiry, alive) or stale."""
    now = current.select(*key, F.col(expires).alias("_now"), F.col("tombstone").alias("_gone"))
    ok = (F.col("_now") == F.col(expires)) & ~F.col("_gone")
    return entries.join(now, key, "left").withColumn("outcome", F.when(ok, F.lit("expired")).otherwise(F.lit("stale"))).drop("_now", "_gone")


def available_at(state: Column, deadline: Column) -> Column:
    return F.when(state == "leased", deadline).otherwise(F.lit(0)).cast("long")


def lease_over(state: Column, deadline: Column, at_ms: int, margin: int = LEASE_MARGIN_MS) -> Column:
    return (state == "leased") & (F.lit(at_ms) >= deadline + margin)


def claim_candidates(current: DataFrame, at_ms: int, order: list[Column], limit: int, margin: int = LEASE_MARGIN_MS) -> DataFrame:
    """Pending records in key order, then expired leases by deadline; limited."""
    ok = (F.col("state") == "pending") | lease_over(F.col("state"), F.col("deadline_ms"), at_ms, margin)
    return current.filter(ok).withColumn("available_at", available_at(F.col("state"), F.col("deadline_ms"))).orderBy("available_at", *order).limit(limit)


def failed_state(attempt: Column, permanent: Column, most: int = 5) -> Column:
    return F.when(permanent | (attempt >= most), F.lit("dead_letter")).otherwise(F.lit("pending"))


def proof_problem(state: Column, lease: Column, fencing: Column, given_lease: Column, given_fencing: Column) -> Column:
    return F.when(state != "leased", F.lit("not leased")).when(~lease.eqNullSafe(given_lease), F.lit("another lease")).when(~fencing.eqNullSafe(given_fencing), F.lit("stale fencing token"))
