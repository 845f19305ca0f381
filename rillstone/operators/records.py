"""Current state, time travel, scans and bounded limits over a log of versions.

Every function takes DataFrames and returns a DataFrame; ``key`` names the identity columns, ``order`` the version column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.schema import ResourceLimit


def heads(versions: DataFrame, key: list[str], order: str) -> DataFrame:
    """The current version of each identity: a partial and final max_by, so only one row of a key and task is shuffled."""
    rest = [c for c in versions.columns if c not in key]
    return versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def as_of(versions: DataFrame, key: list[str], order: str, at: int) -> DataFrame:
    """Heads as they were when ``order`` had reached ``at``; the filter goes to the scan."""
    return heads(versions.filter(F.col(order) <= at), key, order)


def live(current: DataFrame, at_ms: int, tombstone: str = "tombstone", expires: str = "expires_ms") -> DataFrame:
    return current.filter(~F.col(tombstone) & (F.col(expires).isNull() | (F.col(expires) > at_ms)))


def get_batch(current: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Keys in their order with their rows; a missing key keeps nulls.  keys has an ``ord`` column."""
    return keys.join(current, key, "left").orderBy("ord")


def get_batch_of(versions: DataFrame, keys: DataFrame, key: list[str], order: str, most: int = 1024) -> DataFrame:
    """As ``get_batch``, from the log: a request of at most ``most`` keys is broadcast, so only its versions are aggregated."""
    mine = versions.join(F.broadcast(bounded(keys, most).select(*key).distinct()), key, "left_semi")
    return get_batch(heads(mine, key, order), keys, key)


def get_version(versions: DataFrame, key: dict, order: str, at: int) -> DataFrame:
    """One exact version."""
    found = versions.filter(F.col(order) == at)
    for k, v in key.items():
        found = found.filter(F.col(k) == v)
    return found


def scan(rows: DataFrame, where: Column, order: list[Column], limit: int) -> DataFrame:
    """Ordered and bounded scan: TakeOrderedAndProject, with the predicate pushed to Parquet."""
    return rows.filter(where).orderBy(*order).limit(limit)


def keyset_page(rows: DataFrame, cursor: str, after, limit: int) -> DataFrame:
    return rows.filter(F.col(cursor) > after).orderBy(cursor).limit(limit)


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """rows, or ResourceLimit if there are more than ``most``; reads most + 1 rows at most for the test, none where the plan bounds them."""
    known = rows._jdf.queryExecution().optimizedPlan().maxRows()
    if known.isDefined() and known.get() <= most:
        return rows
    if rows.limit(most + 1).count() > most:
        raise ResourceLimit(f"more than {most} rows")
    return rows


def batch_aligned(rows: DataFrame, order: str, batch: str, limit: int, most_batch: int = 1024) -> DataFrame:
    """The first ``limit`` rows, extended to the end of the last one's batch; reads limit + most_batch rows at most."""
    page = rows.orderBy(order).limit(limit + most_batch)
    numbered = page.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    last = numbered.filter(F.col("_n") <= limit).agg(F.max_by(batch, F.col("_n")).alias("_last"))
    return numbered.join(F.broadcast(last)).filter((F.col("_n") <= limit) | (F.col(batch) == F.col("_last"))).drop("_n", "_last")


def byte_capped(rows: DataFrame, order: list[Column], size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """The longest prefix of at most ``most_rows`` rows whose JSON array fits ``most_bytes``: 2 brackets, a comma between rows."""
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = rows.orderBy(*order).limit(most_rows)
    return first.withColumn("_bytes", F.sum(size).over(window) + F.count("*").over(window) + 1).filter(F.col("_bytes") <= most_bytes).drop("_bytes")


def store_stats(current: DataFrame, size: Column, stored: Column, is_compressed: Column) -> DataFrame:
    alive = ~F.col("tombstone")
    n = lambda c: F.count_if(c).alias
    out = current.agg(n(alive)("live"), n(F.col("tombstone"))("tombstones"), n(alive & is_compressed)("compressed"), n(alive & ~is_compressed)("raw"), F.coalesce(F.sum(F.when(alive, size)), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum(F.when(alive, stored)), F.lit(0)).alias("stored_bytes"))
    return out.withColumn("ratio", F.when(F.col("logical_bytes") == 0, F.lit(1.0)).otherwise(F.col("stored_bytes") / F.col("logical_bytes")))


def precondition(kind: Column, expected: Column, head: Column) -> Column:
    """ok or conflict: any; missing (a tombstone's head conflicts too); exact version."""
    return F.when(kind == "any", F.lit("ok")).when(kind == "missing", F.when(head.isNull(), F.lit("ok")).otherwise(F.lit("conflict"))).when(head == expected, F.lit("ok")).otherwise(F.lit("conflict"))


def mutation_outcomes(mutations: DataFrame, current: DataFrame, key: list[str], version: str) -> DataFrame:
    """Each mutation's precondition against the current heads, with the previous version."""
    known = current.select(*key, F.col(version).alias("previous"))
    return mutations.join(known, key, "left").withColumn("outcome", precondition(F.col("kind"), F.col("expected"), F.col("previous")))


def inventory_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one inventory only, with repeats."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def idempotent(requests: DataFrame, scope: list[str], fingerprint: str, order: str) -> DataFrame:
    """Each request against the first of its (scope, hash): stored, replay or conflict."""
    w = Window.partitionBy(*scope).orderBy(order)
    first = F.first(fingerprint).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return requests.withColumn("outcome", F.when(F.row_number().over(w) == 1, F.lit("stored")).when(F.col(fingerprint) == first, F.lit("replay")).otherwise(F.lit("conflict")))


def purge_expired(records: DataFrame, entries: DataFrame, key: list[str], at_ms: int) -> DataFrame:
    """Expiry entries due at ``at_ms``: purged if the record still has that expiry, else stale."""
    due = entries.filter(F.col("expires_ms") <= at_ms)
    now = records.select(*key, F.col("expires_ms").alias("_now"))
    return due.join(now, key, "left").withColumn("outcome", F.when(F.col("_now") == F.col("expires_ms"), F.lit("purged")).otherwise(F.lit("stale"))).drop("_now")
