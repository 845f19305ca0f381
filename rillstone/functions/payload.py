"""Typed payloads: checks, sizes, content types, retention bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillstone.schema import KINDS

#: Fixed value: bytes that a record's envelope is counted with.
ENVELOPE = 128


def payload_problem(p: str = "payload") -> Column:
    """Null for a valid payload, else what is wrong with it."""
    c = lambda n: F.col(f"{p}.{n}")
    filled = sum((c(k).isNotNull().cast("int") for k in KINDS), F.lit(0))
    return F.coalesce(
        F.when((filled != 1) | ~c("kind").isin(*KINDS), F.lit("exactly one member must be set")),
        F.when(F.isnan(c("f64")) | (F.abs(c("f64")) == float("inf")), F.lit("f64 must be finite")),
        F.when((F.size(c("vector")) == 0) | F.exists(c("vector"), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("vector must be finite and not empty")),
        F.when(c("document.schema_version") <= 0, F.lit("schema_version must be positive")),
        F.when(F.octet_length(c("blob.id")) == 0, F.lit("blob id must not be empty")),
    )


def payload_bytes(p: str = "payload") -> Column:
    c = lambda n: F.col(f"{p}.{n}")
    return F.coalesce(F.octet_length(c("bytes")), F.octet_length(c("text")), F.size(F.when(c("vector").isNotNull(), c("vector"))) * 4, F.octet_length(c("document.bytes")) + 4, F.octet_length(c("blob.id")) + 8, F.when(c("bool").isNotNull(), 1), F.lit(8)).cast("long")


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ENVELOPE).cast("long")


def has_prefix(content_type: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: content_type.startswith(p))


def body_kind(mode: Column, delta: Column, size: Column, most: int) -> Column:
    """Body of a change event by retention mode: version_ref, delta (needs a delta) or self_contained (size cap)."""
    return F.when(mode == "version_ref", F.lit("version_ref")).when(mode == "delta", F.when(delta.isNotNull(), F.lit("delta")).otherwise(F.lit("error: delta missing"))).when(mode == "self_contained", F.when(size <= most, F.lit("self_contained")).otherwise(F.lit("error: body too large"))).otherwise(F.lit("error: unknown mode"))
