"""Streaming forms of the change log, idempotent ingest, surfaces, work queues and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillstone.operators import records, surfaces
from rillstone.store import Store


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream; ``ts`` without zone becomes a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else rows


def idempotent_stream(events: DataFrame, key: list[str], ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are forgotten when the watermark has passed them by ``within``."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, by: str, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, by: str, ts: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))


def surface_sink(path: str, key: list[str], order: str, states: list[str]):
    """For ``foreachBatch``: fold each micro-batch into the surface's newest generation and publish the next.

    A generation is a folder named by its batch; a batch that runs again after a restart writes the same folder, so the
    surface sees each event once.
    """

    def publish(batch: DataFrame, number: int) -> None:
        from rillstone.sources.files import Files

        spark = batch.sparkSession
        files = Files(spark, path)
        done = [int(n) for n in files.names("") if n.isdigit() and int(n) < number and files.exists(f"{n}/_SUCCESS")]
        before = spark.read.parquet(f"{path}/{max(done)}") if done else batch.limit(0)
        surfaces.fold(before, batch, key, order, surfaces.accepts(states)).write.mode("overwrite").parquet(f"{path}/{number}")

    return publish


def newest_generation(spark: SparkSession, path: str) -> DataFrame:
    from rillstone.sources.files import Files

    files = Files(spark, path)
    return spark.read.parquet(f"{path}/{max(int(n) for n in files.names('') if n.isdigit() and files.exists(f'{n}/_SUCCESS'))}")


def workflow_states(events: DataFrame, most: int = 5) -> DataFrame:
    """(user_id, state, attempt, fencing): replay of append, claim, fail, complete and publish events of each record.

    State of one record only is held; the events of a micro-batch come in order of event_id.
    """
    out = "user_id long, state string, attempt long, fencing long"

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        now, attempt, fencing = state.get if state.exists else ("none", 0, 0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        for op in rows["op"]:
            if op == "append":
                now = "pending"
            elif op == "claim" and now in ("pending", "leased"):
                now, attempt, fencing = "leased", attempt + 1, fencing + 1
            elif op == "fail" and now == "leased":
                now = "dead_letter" if attempt >= most else "pending"
            elif op == "complete" and now == "leased":
                now = "completed"
            elif op == "publish" and now == "completed":
                now = "published"
        state.update((now, attempt, fencing))
        yield pd.DataFrame({"user_id": [key[0]], "state": [now], "attempt": [attempt], "fencing": [fencing]})

    return events.groupBy("user_id").applyInPandasWithState(step, out, "state string, attempt long, fencing long", "update", GroupStateTimeout.NoTimeout)


def ingest_into(store: Store):
    """For ``foreachBatch``: a micro-batch of small mutations (id columns, text) as batches by partition, each replayed at most once."""
    from rillstone.schema import IDENTITY
    from rillstone.store import Mutation

    def commit(batch: DataFrame, number: int) -> None:
        rows = records.bounded(batch, 1024).collect()
        groups: dict[tuple, list] = {}
        for r in rows:
            i = tuple(bytes(r[c]) for c in IDENTITY)
            groups.setdefault(i[:4], []).append(Mutation(i, r["text"]))
        for part, ms in sorted(groups.items()):
            store.atomic_batch(ms, request=number.to_bytes(8, "big") + b"|".join(part), scope="stream")

    return commit
