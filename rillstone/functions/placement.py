"""Placement: freshness, score, recommended layer, tier choice, cost and cache priority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    half_life_ms: int = 86_400_000
    freshness_weight: int = 700
    urgency_weight: int = 300
    promote: int = 700
    demote: int = 350
    residency_ms: int = 0

    def __post_init__(self) -> None:
        if self.freshness_weight + self.urgency_weight != 1000:
            raise ValueError("weights must sum to 1000")
        if self.half_life_ms <= 0 or not 0 <= self.demote < self.promote <= 1000:
            raise ValueError("half life must be positive and promote above demote")


def freshness(updated_ms: Column, at_ms: int, half_life_ms: int) -> Column:
    age = F.lit(at_ms) - updated_ms
    return F.when(age <= 0, F.lit(1000)).otherwise(F.greatest(F.lit(0), F.least(F.lit(1000), F.round(F.lit(1000.0) * F.pow(F.lit(2.0), -age.cast("double") / F.lit(float(half_life_ms)))).cast("int")))).cast("int")


def score(fresh: Column, urgency: Column, p: Policy) -> Column:
    total = fresh * p.freshness_weight + F.least(urgency, F.lit(1000)) * p.urgency_weight
    return F.least(F.lit(1000), F.floor(total / 1000)).cast("int")


def layer(score_: Column, pinned: Column, expired: Column, current: Column, resident_ms: Column, p: Policy) -> Column:
    """expired: archive; pinned: hot; then thresholds, inclusive; a record younger in its layer than the residency stays."""
    wanted = F.when(score_ >= p.promote, F.lit("hot")).when(score_ <= p.demote, F.lit("cold")).otherwise(F.lit("warm"))
    return F.when(expired, F.lit("archive")).when(pinned, F.lit("hot")).when(resident_ms < p.residency_ms, current).otherwise(wanted)


#: Compression level of each layer.
TIER_LEVEL = {"hot": 1, "warm": 3, "cold": 6, "archive": 9}


def tier_level(layer_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIER_LEVEL.items() for x in kv]), layer_)


def cache_priority(frequency: Column, score_: Column, protected: Column, size: Column) -> Column:
    return F.floor((F.least(frequency, F.lit(1_000_000)).cast("long") * 1000 + score_ + protected.cast("int") * 1000) * 1024 / F.greatest(size, F.lit(1))).cast("long")


def cost_us(transfer_ns: Column, launch_ns: Column, compute_ns: Column, sync_ns: Column, risk_ns: Column) -> Column:
    return F.ceil((transfer_ns + launch_ns + compute_ns + sync_ns + risk_ns) / 1000).cast("long")
