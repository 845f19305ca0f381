"""A store of versioned records: one append-only Parquet log and numbered manifests.

A commit writes its rows, then publishes manifest n + 1; of two writers that try the same number one gets a Conflict.  A reader
takes the newest manifest once and so has a snapshot.  Heads, TTL entries, work queues and placement are derived from
the log.  Mutations of a call are a bounded request and are checked on the driver; everything over the log is a DataFrame.
"""

from __future__ import annotations

import hashlib
import json
import math
import secrets
import struct
import time
import uuid
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.functions import codec, keys, placement
from rillstone.operators import changes, records, surfaces, vector_search
from rillstone.operators.quota import Guard
from rillstone.schema import (
    IDENTITY, KINDS, LEASE_MARGIN_MS, MAX_ATTEMPTS, MAX_BATCH_OPS, MAX_COMPONENT, MAX_METADATA, MAX_PAGE, MAX_RECORD, MUTATION, PAYLOAD, SHARDS,
    ChangeLogGap, Conflict, Corruption, InvalidArgument, LeaseError, NotFound, ResourceLimit, Unsupported,
)
from rillstone.sources.files import Files

Id = tuple[bytes, bytes, bytes, bytes, bytes]


def identity(*parts: str | bytes) -> Id:
    out = tuple(p.encode() if isinstance(p, str) else bytes(p) for p in parts)
    if len(out) != 5 or any(not p or len(p) > MAX_COMPONENT for p in out):
        raise InvalidArgument("an identity has five parts of 1 to 4096 bytes")
    return out  # type: ignore[return-value]


def _f32(x: float) -> float:
    try:
        return struct.unpack("<f", struct.pack("<f", x))[0]
    except OverflowError:
        return math.inf


def payload_of(value) -> dict:
    """A Python value as a payload; a dict of one kind is taken as it is."""
    if isinstance(value, dict):
        (kind, v), *more = value.items()
        if more or kind not in KINDS:
            raise InvalidArgument("a payload has exactly one kind")
    else:
        kind = {bytes: "bytes", str: "text", bool: "bool", int: "i64", float: "f64", list: "vector", tuple: "vector"}.get(type(value))
        v = list(value) if kind == "vector" else value
        if kind is None:
            raise InvalidArgument(f"no payload kind for {type(value).__name__}")
    if kind == "f64" and not math.isfinite(v):
        raise InvalidArgument("f64 must be finite")
    if kind == "vector" and (not v or not all(math.isfinite(_f32(x)) for x in v)):
        raise InvalidArgument("vector must be finite as 32-bit floats and not empty")
    if kind == "document" and v["schema_version"] <= 0:
        raise InvalidArgument("schema_version must be positive")
    if kind == "blob" and not v["id"]:
        raise InvalidArgument("blob id must not be empty")
    if isinstance(v, (bytes, str)) and len(v) > MAX_RECORD:
        raise ResourceLimit("record too large")
    if kind == "vector":
        v = [float(x) for x in v]
    return dict.fromkeys(("kind", *KINDS)) | {"kind": kind, kind: v}


@dataclass
class Mutation:
    """op: put, append or delete; expected: any, missing, or an exact sequence."""

    id: Id
    value: object = None
    op: str = "put"
    expected: str | int = "any"
    content_type: str = "application/octet-stream"
    ttl_ms: int | None = None
    metadata: dict[str, bytes] = field(default_factory=dict)
    delta: bytes | None = None


@dataclass(frozen=True)
class Receipt:
    id: Id
    sequence: int
    shard: int
    batch_id: int
    durable: int


def now_ms() -> int:
    return int(time.time() * 1000)


class Store:
    def __init__(self, spark: SparkSession, root: str, shards: int = SHARDS, guard: Guard | None = None, max_bytes: int | None = None) -> None:
        """guard: quotas of the tenants; max_bytes: what the store's files may hold, a commit counting twice its size."""
        self.guard, self.max_bytes, self.failed = guard, max_bytes, False
        if shards & (shards - 1) or shards <= 0:
            raise InvalidArgument("shards must be a power of two")
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        found = self._newest()
        if found is None:
            self.state = {"n": 0, "epoch": 1, "shards": shards, "sequence": {}, "files": [], "collections": {}, "consumers": {}, "surfaces": {}, "policy": {}, "signals": {}, "classes": {}, "idempotency": {}, "compression": {}, "dictionaries": {}, "audit": 0, "durable": {}}
            self._publish({})
        else:
            self.state = found
            if found["shards"] != shards:
                raise Conflict("the store has another number of shards")

    # ------------------------------------------------------------ manifests

    def _newest(self) -> dict | None:
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        return json.loads(self.files.read(f"manifests/{names[-1]}")) if names else None

    def _publish(self, change: dict) -> None:
        state = self.state | change
        state["n"] += 1
        if not self.files.create(f"manifests/{state['n']:012d}.json", json.dumps(state, sort_keys=True).encode()):
            raise Conflict("another writer committed first; reopen the store")
        self.state = state

    def healthy(self) -> bool:
        """False once a commit broke off half-way; every later commit is then refused until the store is opened again."""
        return not self.failed

    def _may_write(self, size: int) -> None:
        if self.failed:
            raise Corruption("an earlier write failed; open the store again")
        if self.max_bytes is not None and self.files.used() + 2 * size > self.max_bytes:
            raise ResourceLimit("the store's disk budget is used up")

    def refresh(self) -> None:
        self.state = self._newest() or self.state

    def _copy(self, name: str) -> dict:
        return json.loads(json.dumps(self.state[name]))

    # ------------------------------------------------------------ derived views

    def mutations(self) -> DataFrame:
        files = [f"{self.root}/{f}" for f in self.state["files"]]
        return self.spark.read.schema(MUTATION).parquet(*files) if files else self.spark.createDataFrame([], MUTATION)

    def versions(self) -> DataFrame:
        return self.mutations().filter("version_present")

    def events(self) -> DataFrame:
        return self.mutations().filter("event_present")

    def heads(self) -> DataFrame:
        return records.heads(self.versions(), list(IDENTITY), "sequence")

    def _only(self, df: DataFrame, parts: tuple[bytes, ...]) -> DataFrame:
        for c, v in zip(IDENTITY, parts, strict=False):
            df = df.filter(F.col(c) == F.lit(bytearray(v)))
        return df

    def _heads_of(self, ids: list[Id]) -> dict[Id, dict]:
        """Current rows of a bounded request's identities; tenant..partition are pushed to the scan."""
        if not ids:
            return {}
        df = self.versions()
        for k, c in enumerate(IDENTITY):
            df = df.filter(F.col(c).isin(*[bytearray(x) for x in {i[k] for i in ids}]))
        rows = records.heads(df, list(IDENTITY), "sequence").collect()
        out = {tuple(bytes(r[c]) for c in IDENTITY): r.asDict(True) for r in rows}
        return {i: out[i] for i in ids if i in out}

    # ------------------------------------------------------------ writes

    def _mode(self, collection: tuple[bytes, ...]) -> str:
        return self.state["collections"].get(_name(collection), {}).get("retention", "version_ref")

    def configure_collection(self, tenant: str, namespace: str, collection: str, retention: str = "version_ref", required_consumers: list[str] | None = None) -> None:
        """Replaces the collection's policy as a whole, required consumers included."""
        if retention not in ("version_ref", "delta", "self_contained"):
            raise InvalidArgument("unknown retention")
        c = self._copy("collections")
        c[_name((tenant, namespace, collection))] = {"retention": retention, "required": required_consumers or []}
        self._publish({"collections": c})

    def put(self, id: Id, value, **options) -> Receipt:
        return self.atomic_batch([Mutation(id, value, **options)])[0]

    def compare_and_swap(self, id: Id, value, expected: int, **options) -> Receipt:
        return self.atomic_batch([Mutation(id, value, expected=expected, **options)])[0]

    def append(self, id: Id, value, **options) -> Receipt:
        return self.atomic_batch([Mutation(id, value, op="append", expected="missing", **options)])[0]

    def delete(self, id: Id, expected: str | int = "any") -> Receipt:
        return self.atomic_batch([Mutation(id, op="delete", expected=expected)])[0]

    def atomic_batch(self, mutations: list[Mutation], request: bytes | None = None, scope: str = "", at_ms: int | None = None, request_ttl_ms: int = 86_400_000, durable: bool = True) -> list[Receipt]:
        """All or none: at most 1,024 mutations of one partition, each identity once.

        A relaxed batch (durable=False) is readable at once, but its receipts carry the durable watermark of before; ``sync``
        moves the watermark.

        With ``request``, the same hash and mutations return the first receipts; other mutations are a Conflict until
        the request expires.
        """
        at = now_ms() if at_ms is None else at_ms
        if not mutations or len(mutations) > MAX_BATCH_OPS:
            raise ResourceLimit(f"a batch has 1 to {MAX_BATCH_OPS} mutations")
        ids = [m.id for m in mutations]
        if len({i[:4] for i in ids}) != 1:
            raise InvalidArgument("a batch stays inside one partition")
        if len(set(ids)) != len(ids):
            raise InvalidArgument("a batch names each identity once")
        mark = hashlib.sha256(repr([(m.id, m.value, m.op, m.expected, m.content_type, m.ttl_ms, sorted(m.metadata.items()), m.delta) for m in mutations]).encode()).hexdigest()
        memo, key = self._copy("idempotency"), f"{scope}/{request.hex()}" if request else None
        if key and (seen := memo.get(key)) and seen["expires"] > at:
            if seen["mark"] != mark:
                raise Conflict("the request's hash was used for another batch")
            return [Receipt(i, *r) for i, r in zip(ids, seen["receipts"], strict=True)]
        heads, rows = self._heads_of(ids), []
        for m in mutations:
            old = heads.get(m.id)
            if m.expected == "missing" and old is not None:
                raise Conflict("the record has a version already")  # a tombstone's too
            if isinstance(m.expected, int) and (old is None or old["sequence"] != m.expected):
                raise Conflict("the record has another version")
            if sum(len(k.encode()) + len(v) for k, v in m.metadata.items()) > MAX_METADATA:
                raise ResourceLimit("metadata too large")
            fresh = {"state": "pending" if m.op == "append" else "ready", "attempt": 0, "lease_id": None, "fencing": 0, "deadline_ms": None}
            if m.op == "delete":  # a tombstone is written for a key without versions, too
                kept = {"content_type": old["content_type"], "workflow": old["workflow"]} if old else {"content_type": m.content_type, "workflow": fresh}
                rows.append({"op": "delete", "payload": None, "expires_ms": None, "metadata": {}, "tombstone": True, "delta": m.delta} | kept)
                continue
            rows.append({"op": m.op, "payload": payload_of(m.value), "content_type": m.content_type, "expires_ms": None if m.ttl_ms is None else at + m.ttl_ms, "metadata": m.metadata, "workflow": old["workflow"] if old and m.op == "put" else fresh, "tombstone": False, "delta": m.delta})
        receipts = self._commit(ids, rows, heads, at, lambda made: {"idempotency": memo | {key: {"mark": mark, "expires": at + request_ttl_ms, "receipts": [[r.sequence, r.shard, r.batch_id, r.durable] for r in made]}}} if key else {}, durable)
        return receipts

    def _commit(self, ids: list[Id], rows: list[dict], heads: dict[Id, dict], at: int, more=lambda made: {}, durable: bool = True) -> list[Receipt]:
        shard = int.from_bytes(hashlib.sha256(b"\0".join(ids[0][:4])).digest()[:8], "big") & (self.state["shards"] - 1)
        last, mode = self.state["sequence"].get(str(shard), 0), self._mode(ids[0][:3])
        mark = last + len(ids) if durable else self.state["durable"].get(str(shard), 0)
        out, receipts = [], []
        for k, (i, r) in enumerate(zip(ids, rows, strict=True)):
            if mode == "delta" and r["delta"] is None:
                raise InvalidArgument("the collection keeps deltas: a delta is needed")
            old = heads.get(i)
            out.append(dict(zip(IDENTITY, map(bytearray, i), strict=True)) | r | {"epoch": self.state["epoch"], "shard": shard, "sequence": last + k + 1, "batch_id": last + 1, "previous": old["sequence"] if old else None, "created_ms": old["created_ms"] if old else at, "updated_ms": at, "body": mode, "event_present": True, "version_present": True})
            receipts.append(Receipt(i, last + k + 1, shard, last + 1, mark))
        name = f"data/{uuid.uuid4().hex}"
        order = [f.name for f in MUTATION.fields]
        size = sum(len(repr(r["payload"])) for r in rows)
        self._may_write(size)
        with self.guard.request(ids[0][0].decode(), size) if self.guard else nullcontext():
            try:
                self.spark.createDataFrame([tuple(r[c] for c in order) for r in out], MUTATION).coalesce(1).write.parquet(f"{self.root}/{name}")
            except Exception:
                self.failed = True
                raise
        self._publish({"files": [*self.state["files"], name], "sequence": self.state["sequence"] | {str(shard): last + len(ids)}, "durable": self.state["durable"] | {str(shard): mark}} | more(receipts))
        return receipts

    def put_frame(self, rows: DataFrame, at_ms: int | None = None) -> int:
        """Put every row of a DataFrame in one commit, without passing the driver; returns how many.

        Columns: the identity's five (text or binary), ``kind`` and the column of that kind, as in the payload.  Each identity once.
        A shard's sequences follow one another; its rows are batches of 1,024.
        """
        at, wide = now_ms() if at_ms is None else at_ms, {f.name: f.dataType for f in PAYLOAD.fields}
        self._may_write(0)
        payload = F.struct(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t.simpleString()).alias(c) for c, t in wide.items()])
        ids = [F.col(c).cast("binary").alias(c) for c in IDENTITY]
        parts = [x for c in IDENTITY[:4] for x in (F.col(c), F.lit(bytearray(b"\0")))][:-1]
        shard = F.conv(F.substring(F.sha2(F.concat(*parts), 256), 9, 8), 16, 10).cast("long").bitwiseAND(F.lit(self.state["shards"] - 1)).cast("int")
        made = rows.select(*ids, payload.alias("payload")).withColumns({"shard": shard, "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
        staging, name = f"staging/{uuid.uuid4().hex}", f"data/{uuid.uuid4().hex}"
        made.write.parquet(f"{self.root}/{staging}")
        staged = self.spark.read.parquet(f"{self.root}/{staging}")
        try:
            odd = F.exists("payload.vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size("payload.vector") == 0) | F.isnan("payload.f64") | (F.abs("payload.f64") == float("inf"))
            bad = F.count_if(F.coalesce(odd, F.lit(False)) | F.array_contains(F.array(*[F.col(c).isNull() | (F.octet_length(c) == 0) | (F.octet_length(c) > MAX_COMPONENT) for c in IDENTITY]), True) | ~F.col("payload.kind").isin(*KINDS) | F.col("payload.kind").isNull())
            if staged.agg(bad).first()[0] or not staged.groupBy(*IDENTITY).count().filter("count > 1").isEmpty():
                raise InvalidArgument("an identity, kind or number is wrong, or an identity repeats")
            names = [tuple(bytes(x) for x in r) for r in records.bounded(staged.select(*IDENTITY[:3]).distinct(), MAX_PAGE).collect()]
            modes = {n: self._mode(n) for n in names}
            if "delta" in modes.values():
                raise InvalidArgument("the collection keeps deltas: a delta is needed")
            sizes = staged.groupBy("shard", "_part").agg(F.count("*").alias("n"))
            before = F.sum("n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
            last = self.spark.createDataFrame([(k, self.state["sequence"].get(str(k), 0)) for k in range(self.state["shards"])], "shard int, last long")
            offsets = sizes.withColumn("before", before).join(F.broadcast(last), "shard")
            nth = F.col("before") + F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_at"))
            old = self.heads().select(*IDENTITY, F.col("sequence").alias("previous"), F.col("created_ms").alias("_created"), F.col("workflow").alias("_workflow"))
            fresh = F.struct(F.lit("ready").alias("state"), F.lit(0).alias("attempt"), F.lit(None).cast("binary").alias("lease_id"), F.lit(0).cast("long").alias("fencing"), F.lit(None).cast("long").alias("deadline_ms"))
            retention = F.create_map(*[x for n, m in modes.items() for x in (F.lit("/".join(p.hex() for p in n)), F.lit(m))]) if modes else F.create_map(F.lit(""), F.lit(""))
            whole = staged.join(offsets, ["shard", "_part"]).withColumn("nth", nth).join(old, list(IDENTITY), "left").select(
                *IDENTITY, F.lit(self.state["epoch"]).cast("long").alias("epoch"), "shard", (F.col("last") + F.col("nth")).alias("sequence"), F.lit("put").alias("op"),
                (F.col("last") + 1 + F.floor((F.col("nth") - 1) / MAX_BATCH_OPS) * MAX_BATCH_OPS).cast("long").alias("batch_id"), "previous", "payload", F.lit("application/octet-stream").alias("content_type"),
                F.coalesce("_created", F.lit(at)).alias("created_ms"), F.lit(at).cast("long").alias("updated_ms"), F.lit(None).cast("long").alias("expires_ms"), F.expr("cast(map() as map<string,binary>)").alias("metadata"),
                F.coalesce("_workflow", fresh).alias("workflow"), F.lit(False).alias("tombstone"), F.element_at(retention, F.concat_ws("/", *[F.lower(F.hex(c)) for c in IDENTITY[:3]])).alias("body"),
                F.lit(None).cast("binary").alias("delta"), F.lit(True).alias("event_present"), F.lit(True).alias("version_present"),
            )
            whole.write.parquet(f"{self.root}/{name}", compression="zstd")
            ends = {str(r["shard"]): self.state["sequence"].get(str(r["shard"]), 0) + r["n"] for r in staged.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        finally:
            self.files.delete(staging)
        total = sum(v - self.state["sequence"].get(k, 0) for k, v in ends.items())
        if total:
            self._publish({"files": [*self.state["files"], name], "sequence": self.state["sequence"] | ends, "durable": self.state["durable"] | ends})
        return total

    def sync(self) -> dict[str, int]:
        """Every shard's durable watermark becomes its sequence."""
        self._publish({"durable": dict(self.state["sequence"])})
        return self.state["durable"]

    def purge_expired_idempotency(self, at_ms: int) -> int:
        memo = self.state["idempotency"]
        kept = {k: v for k, v in memo.items() if v["expires"] > at_ms}
        self._publish({"idempotency": kept})
        return len(memo) - len(kept)

    # ------------------------------------------------------------ reads

    def get(self, id: Id, at_ms: int | None = None) -> dict | None:
        row = self._heads_of([id]).get(id)
        if row is None or row["tombstone"] or (row["expires_ms"] is not None and row["expires_ms"] <= (now_ms() if at_ms is None else at_ms)):
            return None
        return row

    def get_batch(self, ids: list[Id], at_ms: int | None = None) -> list[dict | None]:
        at, found = now_ms() if at_ms is None else at_ms, self._heads_of(ids)
        return [r if (r := found.get(i)) and not r["tombstone"] and (r["expires_ms"] is None or r["expires_ms"] > at) else None for i in ids]

    def current_version(self, id: Id) -> int | None:
        row = self._heads_of([id]).get(id)
        return row["sequence"] if row else None

    def get_version(self, id: Id, sequence: int) -> dict:
        rows = self._only(self.versions(), id).filter(F.col("sequence") == sequence).limit(1).collect()
        if not rows:
            raise NotFound("the version isn't there or was collected")
        return rows[0].asDict(True)

    def scan_prefix(self, parts: tuple[bytes, ...], key_prefix: bytes = b"", limit: int = MAX_PAGE, at_ms: int | None = None) -> DataFrame:
        """Live records below identity parts whose key starts with a prefix, in length-first order."""
        df = self._only(self.heads(), parts)
        live = records.live(df, now_ms() if at_ms is None else at_ms)
        return records.scan(live, keys.prefixed("key", key_prefix), keys.scan_order(), limit)

    def vector_exact(self, tenant: str, namespace: str, collection: str, query: list[float], limit: int, metric: str = "cosine", max_scan: int = 1_000_000, at_ms: int | None = None) -> DataFrame:
        """Exact top-k of one collection; errors above max_scan records, tombstones and expired ones included."""
        if not 0 < max_scan <= 1_000_000:
            raise InvalidArgument("max_scan is 1 to 1000000")
        mine = records.bounded(self._only(self.heads(), (tenant.encode(), namespace.encode(), collection.encode())), max_scan)
        alive = records.live(mine, now_ms() if at_ms is None else at_ms).select(*IDENTITY, "sequence", F.col("payload.vector").alias("vector"))
        return vector_search.exact_top_k(alive, "vector", query, limit, keys.scan_order(("partition", "key")), metric)

    def vector_counts(self, tenant: str, namespace: str, collection: str, width: int, at_ms: int | None = None) -> dict:
        """What ``vector_exact`` reads of a collection and what of it is scored."""
        mine = self._only(self.heads(), (tenant.encode(), namespace.encode(), collection.encode()))
        alive = records.live(mine, now_ms() if at_ms is None else at_ms).select(F.col("payload.vector").alias("vector"))
        return {"scanned": mine.count(), "candidates": vector_search.search_counts(alive, "vector", width).first()["candidates"]}

    def dereference(self, events: DataFrame) -> DataFrame:
        """Events with the version each names: its payload, or null where the version was collected."""
        key = [*IDENTITY, "sequence"]
        return events.drop("payload").join(self.versions().select(*key, "payload"), key, "left")

    # ------------------------------------------------------------ changes

    def changes(self, shard: int, after: int, limit: int) -> list:
        """A page of one shard, in order, extended to whole batches."""
        return changes.checked_page(self.events(), shard, after, limit, "sequence")

    def subscribe_changes(self, parts: tuple[bytes, bytes, bytes], shard: int, after: int, limit: int) -> tuple[list, int]:
        """(events of one collection, watermark): the watermark passes over other collections' events."""
        page = self.changes(shard, after, limit)
        return [r for r in page if tuple(bytes(r[c]) for c in IDENTITY[:3]) == parts], page[-1]["sequence"] if page else after

    def acknowledge_consumer(self, collection: tuple[str, str, str], consumer: str, shard: int, watermark: int) -> None:
        name = _name(collection)
        if consumer not in self.state["collections"].get(name, {}).get("required", []):
            raise NotFound("the consumer isn't declared")
        if watermark > self.state["sequence"].get(str(shard), 0):
            raise InvalidArgument("the watermark is after the latest event")
        c, key = self._copy("consumers"), f"{name}|{consumer}|{shard}"
        if watermark < c.get(key, 0):
            raise InvalidArgument("a watermark doesn't go back")
        c[key] = watermark
        self._publish({"consumers": c})

    def garbage_collect(self, collection: tuple[str, str, str]) -> dict:
        """Events and superseded versions of a collection below the least required watermark, by whole batches."""
        name = _name(collection)
        required = self.state["collections"].get(name, {}).get("required", [])
        if not required:
            raise InvalidArgument("the collection has no required consumers")
        marks = [(s, min(self.state["consumers"].get(f"{name}|{c}|{s}", 0) for c in required)) for s in range(self.state["shards"])]
        safe = self.spark.createDataFrame(marks, "shard int, watermark long")
        mine = self._only(self.events(), tuple(p.encode() for p in collection))
        gone = changes.collectable(mine, safe, self._only(self.heads(), tuple(p.encode() for p in collection)), list(IDENTITY), "sequence")
        gone = gone.select("shard", "sequence", "is_head")
        counts = gone.agg(F.count("*").alias("events"), F.count_if(~F.col("is_head")).alias("versions")).first()
        if counts["events"]:
            marked = self.mutations().join(gone, ["shard", "sequence"], "left").withColumns({"event_present": F.col("event_present") & F.col("is_head").isNull(), "version_present": F.col("version_present") & F.coalesce("is_head", F.lit(True))})
            self._rewrite(marked.filter("event_present or version_present"))
        return {"events": counts["events"], "versions": counts["versions"]}

    def _rewrite(self, rows: DataFrame) -> None:
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*[f.name for f in MUTATION.fields]).write.parquet(f"{self.root}/{name}", compression="zstd")
        self._publish({"files": [name]})

    def compact(self) -> int:
        """All files as one set sorted by identity, so that point reads skip row groups; returns how many files went."""
        old = len(self.state["files"])
        self._rewrite(self.mutations().repartitionByRange(*IDENTITY[:4]).sortWithinPartitions(*IDENTITY, "sequence"))
        return old

    # ------------------------------------------------------------ TTL and work

    def expire_due(self, at_ms: int, limit: int = MAX_PAGE) -> int:
        """Tombstones for live records whose expiry is due, in order of (expiry, key); deltas collections can't expire."""
        due = self.heads().filter(~F.col("tombstone") & (F.col("expires_ms") <= at_ms)).orderBy("expires_ms", *keys.scan_order()).limit(limit).collect()
        groups: dict[tuple, list[Mutation]] = {}
        for r in due:
            i = tuple(bytes(r[c]) for c in IDENTITY)
            if self._mode(i[:3]) == "delta":
                raise Unsupported("a delta collection can't expire")
            groups.setdefault(i[:4], []).append(Mutation(i, op="delete", expected=r["sequence"]))
        for batch in groups.values():  # a commit for each partition
            self.atomic_batch(batch, at_ms=at_ms)
        return len(due)

    def _work(self, id: Id, lease: bytes | None, fencing: int | None, at: int, change: dict, op: str, expect: str = "leased") -> dict:
        row = self._heads_of([id]).get(id)
        if row is None or row["tombstone"]:
            raise NotFound("no such record")
        w = row["workflow"]
        if w["state"] != expect:
            raise LeaseError(f"the record is {w['state']}")
        if expect == "leased":
            if bytes(w["lease_id"]) != lease or w["fencing"] != fencing:
                raise LeaseError("another lease or a stale fencing token")
            if at >= w["deadline_ms"] and op != "claim":
                raise LeaseError("the lease has expired")
        self._commit([id], [{c: row[c] for c in ("payload", "content_type", "expires_ms", "metadata")} | {"workflow": w | change, "op": op, "tombstone": False, "delta": None}], {id: row}, at)
        return w | change

    def claim(self, parts: tuple[bytes, bytes, bytes, bytes], lease_ms: int, limit: int = 1, at_ms: int | None = None, margin_ms: int = LEASE_MARGIN_MS, request: bytes | None = None, request_ttl_ms: int = 86_400_000) -> list[dict]:
        """Lease pending records in key order, then records whose lease ran out by deadline; one batch of one partition.

        With ``request``, a repeated call returns the first call's leases, also if it found nothing; other arguments are a Conflict.
        """
        at = now_ms() if at_ms is None else at_ms
        key, mark = f"claim/{request.hex()}" if request else None, repr((parts, lease_ms, limit))
        if key and (seen := self.state["idempotency"].get(key)) and seen["expires"] > at:
            if seen["mark"] != mark:
                raise Conflict("the request's hash was used for another claim")
            out = []
            for sequence, *hexes in seen["receipts"]:
                i = tuple(bytes.fromhex(h) for h in hexes)
                row = self.get_version(i, sequence)
                out.append({"id": i, "payload": row["payload"]} | row["workflow"] | {"lease_id": bytes(row["workflow"]["lease_id"])})
            return out

        def memo(receipts: list[Receipt]) -> dict:
            if not key:
                return {}
            return {"idempotency": self._copy("idempotency") | {key: {"mark": mark, "expires": at + request_ttl_ms, "receipts": [[r.sequence, *(p.hex() for p in r.id)] for r in receipts]}}}

        if self._mode(parts[:3]) == "delta":
            raise Unsupported("a delta collection has no work queue")
        w = F.col("workflow")
        over = (w.state == "leased") & (w.deadline_ms + margin_ms <= at)
        live = records.live(self._only(self.heads(), parts), at).filter((w.state == "pending") | over)
        rows = live.withColumn("_at", F.when(w.state == "leased", w.deadline_ms).otherwise(0)).orderBy("_at", *keys.scan_order()).limit(min(limit, MAX_PAGE)).drop("_at").collect()
        if not rows:
            if key:
                self._publish(memo([]))
            return []
        ids, out, heads = [], [], {}
        for r in rows:
            row = r.asDict(True)
            i = tuple(bytes(row[c]) for c in IDENTITY)
            new = {"state": "leased", "attempt": (row["workflow"]["attempt"] or 0) + 1, "lease_id": bytearray(secrets.token_bytes(16)), "fencing": (row["workflow"]["fencing"] or 0) + 1, "deadline_ms": at + lease_ms}
            ids.append(i)
            heads[i] = row
            out.append({c: row[c] for c in ("payload", "content_type", "expires_ms", "metadata")} | {"workflow": new, "op": "claim", "tombstone": False, "delta": None})
        self._commit(ids, out, heads, at, memo)
        return [{"id": i, "payload": o["payload"]} | o["workflow"] | {"lease_id": bytes(o["workflow"]["lease_id"])} for i, o in zip(ids, out, strict=True)]

    def heartbeat(self, id: Id, lease: bytes, fencing: int, lease_ms: int, at_ms: int | None = None) -> dict:
        at = now_ms() if at_ms is None else at_ms
        return self._work(id, lease, fencing, at, {"deadline_ms": at + lease_ms}, "heartbeat")

    def complete(self, id: Id, lease: bytes, fencing: int, at_ms: int | None = None) -> dict:
        return self._work(id, lease, fencing, now_ms() if at_ms is None else at_ms, {"state": "completed", "lease_id": None, "deadline_ms": None}, "complete")

    def fail(self, id: Id, lease: bytes, fencing: int, permanent: bool = False, at_ms: int | None = None) -> dict:
        row = self._heads_of([id]).get(id)
        dead = permanent or bool(row and (row["workflow"]["attempt"] or 0) >= MAX_ATTEMPTS)
        return self._work(id, lease, fencing, now_ms() if at_ms is None else at_ms, {"state": "dead_letter" if dead else "pending", "lease_id": None, "deadline_ms": None}, "fail")

    def publish(self, id: Id, at_ms: int | None = None) -> dict:
        row = self._heads_of([id]).get(id)
        if row and row["workflow"]["state"] == "published":
            return row["workflow"]
        return self._work(id, None, None, now_ms() if at_ms is None else at_ms, {"state": "published"}, "publish", "completed")

    # ------------------------------------------------------------ surfaces

    def create_surface(self, name: str, collection: tuple[str, str, str], states: list[str], max_records: int = 10_000, max_bytes: int = 26_843_545, retained: int = 2) -> None:
        if not name or not states or max_records <= 0 or max_bytes <= 2 or retained < 1:
            raise InvalidArgument("bad surface definition")
        if self._mode(tuple(p.encode() for p in collection)) == "delta":
            raise Unsupported("a delta collection has no surfaces")
        new = {"collection": list(collection), "states": states, "max_records": max_records, "max_bytes": max_bytes, "retained": retained}
        s = self._copy("surfaces")
        if name in s:
            if s[name]["definition"] != new:
                raise Conflict("the surface is defined otherwise")
            return
        s[name] = {"definition": new, "generation": 0, "generations": {}, "watermarks": {}}
        c, col = self._copy("collections"), _name(collection)
        c.setdefault(col, {"retention": "version_ref", "required": []})
        if f"surface:{name}" not in c[col]["required"]:
            c[col]["required"].append(f"surface:{name}")
        self._publish({"surfaces": s, "collections": c})

    def _surface(self, name: str) -> dict:
        s = self._copy("surfaces")
        if name not in s:
            raise NotFound("no such surface")
        return s[name]

    def _accepts(self, d: dict, at_ms: int):
        return ~F.col("tombstone") & F.col("workflow.state").isin(*d["states"]) & (F.col("expires_ms").isNull() | (F.col("expires_ms") > at_ms))

    def build_surface(self, name: str, max_events: int = 100_000, at_ms: int | None = None) -> int:
        """Fold new events into the surface's full state; returns the generation.  A gap in the events needs a rebuild."""
        s, at = self._surface(name), now_ms() if at_ms is None else at_ms
        marks, budget, upto = s["watermarks"], max_events, dict(s["watermarks"])
        for shard, last in sorted(self.state["sequence"].items(), key=lambda x: int(x[0])):
            done = marks.get(shard, 0)
            if last > done and budget > 0:
                after = self.events().filter((F.col("shard") == int(shard)) & (F.col("sequence") > done)).agg(F.min("sequence")).first()[0]
                if after != done + 1:
                    raise ChangeLogGap(f"events after {done} are gone")
                stop = min(last, done + budget)
                if stop < last:  # to the end of its batch
                    stop = self.events().filter((F.col("shard") == int(shard)) & (F.col("batch_id") <= stop)).agg(F.max("sequence")).first()[0]
                budget -= stop - done
                upto[shard] = stop
        if upto == marks and s["generation"]:
            return s["generation"]
        bounds = self.spark.createDataFrame([(int(k), marks.get(k, 0), v) for k, v in upto.items()] or [(-1, 0, 0)], "shard int, lo long, hi long")
        mine = self._only(self.events(), tuple(p.encode() for p in s["definition"]["collection"]))
        fresh = mine.join(F.broadcast(bounds), "shard").filter("sequence > lo and sequence <= hi").select(*[f.name for f in MUTATION.fields])
        before = self.spark.read.schema(MUTATION).parquet(f"{self.root}/surfaces/{name}/{s['generation']}/state") if s["generation"] else self.spark.createDataFrame([], MUTATION)
        return self._publish_surface(name, s, surfaces.fold(before, fresh, list(IDENTITY), "sequence", self._accepts(s["definition"], at)), upto)

    def rebuild_surface(self, name: str, at_ms: int | None = None) -> int:
        s, at = self._surface(name), now_ms() if at_ms is None else at_ms
        mine = self._only(self.heads(), tuple(p.encode() for p in s["definition"]["collection"]))
        return self._publish_surface(name, s, mine.filter(self._accepts(s["definition"], at)), dict(self.state["sequence"]))

    def _publish_surface(self, name: str, s: dict, state: DataFrame, marks: dict) -> int:
        """Full state and capped output are kept side by side, so rows cut by a cap come back when there is room."""
        g, d = s["generation"] + 1, s["definition"]
        path = f"{self.root}/surfaces/{name}/{g}"
        state.select(*[f.name for f in MUTATION.fields]).write.parquet(f"{path}/state")
        full = self.spark.read.schema(MUTATION).parquet(f"{path}/state")
        size = F.octet_length(F.to_json(F.struct(*IDENTITY, "payload", "content_type", "sequence")))
        surfaces.capped(full, keys.surface_order(), size, d["max_records"], d["max_bytes"]).write.parquet(f"{path}/rows")
        all_, consumers = self._copy("surfaces"), self._copy("consumers")
        kept = {k: v for k, v in (s["generations"] | {str(g): marks}).items() if int(k) > g - d["retained"]}
        for old in set(s["generations"]) - set(kept):
            self.files.delete(f"surfaces/{name}/{old}")
        all_[name] = s | {"generation": g, "generations": kept, "watermarks": marks}
        for shard, v in marks.items():
            consumers[f"{_name(d['collection'])}|surface:{name}|{shard}"] = v
        self._publish({"surfaces": all_, "consumers": consumers})
        return g

    def read_surface(self, name: str) -> tuple[DataFrame, dict[int, int]]:
        """(rows in component order, events by shard that the generation hasn't seen)."""
        s = self._surface(name)
        if not s["generation"]:
            raise NotFound("the surface was never built")
        rows = self.spark.read.schema(MUTATION).parquet(f"{self.root}/surfaces/{name}/{s['generation']}/rows").orderBy(*keys.surface_order())
        return rows, {int(k): max(0, v - s["watermarks"].get(k, 0)) for k, v in self.state["sequence"].items()}

    # ------------------------------------------------------------ placement

    def configure_placement(self, collection: tuple[str, str, str], **policy) -> None:
        placement.Policy(**policy)
        self._publish({"policy": self.state["policy"] | {_name(collection): policy}})

    def register_storage_class(self, name: str, **facts) -> None:
        self._publish({"classes": self.state["classes"] | {name: facts}})

    def set_signals(self, id: Id, urgency: int = 0, pinned: bool = False, cost: int = 0) -> None:
        if not 0 <= urgency <= 1000:
            raise InvalidArgument("urgency is 0 to 1000")
        self._publish({"signals": self.state["signals"] | {"|".join(p.hex() for p in id): [urgency, pinned, cost]}})

    def explain_placement(self, collection: tuple[str, str, str], at_ms: int) -> DataFrame:
        """Freshness, score and recommended layer of every record of a collection; the current layer is always warm."""
        p = placement.Policy(**self.state["policy"].get(_name(collection), {}))
        signals = self.spark.createDataFrame([(*[bytearray.fromhex(x) for x in k.split("|")], *v) for k, v in self.state["signals"].items()], ", ".join(f"{c} binary" for c in IDENTITY) + ", urgency int, pinned boolean, cost int")
        rows = self._only(self.heads(), tuple(x.encode() for x in collection)).filter("not tombstone").join(signals, list(IDENTITY), "left")
        fresh = placement.freshness(F.col("updated_ms"), at_ms, p.half_life_ms)
        rows = rows.select(*IDENTITY, fresh.alias("freshness"), F.coalesce("urgency", F.lit(0)).alias("urgency"), F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce(F.col("expires_ms") <= at_ms, F.lit(False)).alias("expired"), (F.lit(at_ms) - F.col("updated_ms")).alias("resident"))
        rows = rows.withColumn("score", placement.score(F.col("freshness"), F.col("urgency"), p))
        return rows.withColumn("layer", placement.layer(F.col("score"), F.col("pinned"), F.col("expired"), F.lit("warm"), F.col("resident"), p))

    # ------------------------------------------------------------ compression

    def compression_stats(self, level: int = 3, min_input: int = 64, min_savings: int = 16) -> DataFrame:
        """(codec, n, raw_bytes, stored_bytes): zstd where it saves enough, else raw; Arrow batches in, sums out."""

        def run(batches):
            import pyarrow as pa
            import zstandard

            c = zstandard.ZstdCompressor(level=level)
            for b in batches:
                raw = [len(x) for x in b.column(0).to_pylist()]
                packed = [len(c.compress(x)) for x in b.column(0).to_pylist()]
                small = [n >= min_input and z + min_savings < n for n, z in zip(raw, packed, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(["zstd" if s else "raw" for s in small]), pa.array(raw, pa.int64()), pa.array([z if s else n for n, z, s in zip(raw, packed, small, strict=True)], pa.int64())], ["codec", "raw", "stored"])

        body = F.coalesce(F.col("payload.bytes"), F.col("payload.text").cast("binary"), F.col("payload.document.bytes"))
        made = self.heads().filter("not tombstone").select(body.alias("b")).filter("b is not null").mapInArrow(run, "codec string, raw long, stored long")
        return made.groupBy("codec").agg(F.count("*").alias("n"), F.sum("raw").alias("raw_bytes"), F.sum("stored").alias("stored_bytes"))

    def train_dictionary(self, name: str, samples: int = 1000, size: int = 8192, min_gain: float = 0.0) -> dict:
        """A zstd dictionary from a bounded sample; kept only if it saves more than ``min_gain`` of the plain size."""
        import zstandard

        body = F.coalesce(F.col("payload.bytes"), F.col("payload.text").cast("binary"))
        rows = [bytes(r[0]) for r in self.heads().filter("not tombstone").select(body.alias("b")).filter("b is not null").limit(samples).collect()]
        if len(rows) < 8:
            raise InvalidArgument("a dictionary needs at least 8 samples")
        d = zstandard.train_dictionary(size, rows)
        plain = sum(len(zstandard.ZstdCompressor().compress(r)) for r in rows)
        with_it = sum(len(zstandard.ZstdCompressor(dict_data=d).compress(r)) for r in rows)
        active = with_it < plain * (1 - min_gain)
        if active:
            data = d.as_bytes()
            self.files.create(f"dictionaries/{name}-{hashlib.sha256(data).hexdigest()[:16]}", data)
            self._publish({"dictionaries": self.state["dictionaries"] | {name: hashlib.sha256(data).hexdigest()}})
        return {"raw": sum(map(len, rows)), "without": plain, "with": with_it, "active": active}

    def configure_compression(self, level: int = 3, min_input: int = 64, min_savings: int = 16, skip_prefixes: tuple[str, ...] = ()) -> None:
        codec.Policy(level, min_input, min_savings, tuple(skip_prefixes))
        self._publish({"compression": {"level": level, "min_input": min_input, "min_savings": min_savings, "skip_prefixes": list(skip_prefixes)}})

    def compression_policy(self) -> codec.Policy:
        p = self.state["compression"]
        return codec.Policy(**(p | {"skip_prefixes": tuple(p["skip_prefixes"])})) if p else codec.Policy()

    def storage_classes(self) -> dict:
        return dict(self.state["classes"])

    def capabilities(self) -> dict:
        return {"kinds": list(KINDS), "metrics": list(vector_search.METRICS), "retention": ["version_ref", "delta", "self_contained"], "shards": self.state["shards"], "max_batch": MAX_BATCH_OPS, "max_page": MAX_PAGE}

    # ------------------------------------------------------------ audit, checks, copies

    def append_audit_event(self, actor: str, action: str, outcome: str, at_ms: int | None = None) -> int:
        n = self.state["audit"] + 1
        self.files.create(f"audit/{n:012d}.json", json.dumps({"n": n, "at_ms": now_ms() if at_ms is None else at_ms, "actor": actor, "action": action, "outcome": outcome}).encode())
        self._publish({"audit": n})
        return n

    def read_audit(self, after: int = 0, limit: int = 100) -> list[dict]:
        return [json.loads(self.files.read(f"audit/{n:012d}.json")) for n in range(after + 1, min(self.state["audit"], after + limit) + 1)]

    def audited(self, actor: str, action: str, call, *args, **options):
        """Run an administrative call between its Attempted and outcome events."""
        self.append_audit_event(actor, action, "attempted")
        try:
            out = call(*args, **options)
        except Exception:
            self.append_audit_event(actor, action, "failed")
            raise
        self.append_audit_event(actor, action, "succeeded")
        return out

    def verify(self) -> dict:
        """Counts of the log, or Corruption: repeated versions, sequences beyond the catalog, leases without their fields."""
        m = self.mutations()
        w = F.col("workflow")
        a = m.agg(F.count_if("event_present").alias("events"), F.count_if("version_present").alias("versions"), F.count_if(F.col("tombstone") != F.col("payload").isNull()).alias("bodies"), F.count_if((w.state == "leased") & (w.lease_id.isNull() | w.deadline_ms.isNull() | (w.fencing <= 0))).alias("leases")).first()
        if a["bodies"] or a["leases"]:
            raise Corruption("a record breaks its own rules")
        if not m.groupBy("shard", "sequence").count().filter("count > 1").isEmpty():
            raise Corruption("a sequence was used twice")
        for r in m.groupBy("shard").agg(F.max("sequence").alias("last")).collect():  # one row for each shard
            if r["last"] > self.state["sequence"].get(str(r["shard"]), 0):
                raise Corruption("a sequence is beyond the catalog")
        return {"events": a["events"], "versions": a["versions"], "heads": self.heads().count()}

    def stats(self) -> dict:
        h = self.heads().agg(F.count("*").alias("heads"), F.count_if("tombstone").alias("tombstones")).first()
        return {"manifest": self.state["n"], "files": len(self.state["files"]), "sequence": self.state["sequence"], **h.asDict()}

    def backup(self, to: str) -> dict[str, str]:
        """Copy the live files with a hash inventory."""
        other = Files(self.spark, to)
        if other.names(""):
            raise Conflict("the target isn't empty")
        live = [n for n in self.files.tree() if n.startswith(("audit/", "dictionaries/", "surfaces/", f"manifests/{self.state['n']:012d}")) or any(n.startswith(f + "/") for f in self.state["files"])]
        for n in live:
            self.files.copy(n, other)
        inventory = {n: other.digest(n) for n in live}
        other.create("INVENTORY.json", json.dumps(inventory).encode())
        return inventory

    @staticmethod
    def verify_backup(spark: SparkSession, path: str) -> int:
        f = Files(spark, path)
        inventory = json.loads(f.read("INVENTORY.json"))
        if any(n.startswith("/") or ".." in n.split("/") for n in inventory):
            raise Corruption("unsafe path in the inventory")
        for n, h in inventory.items():
            if not f.exists(n) or f.digest(n) != h:
                raise Corruption(f"{n} is missing or changed")
        return len(inventory)

    @staticmethod
    def restore(spark: SparkSession, path: str, to: str) -> Store:
        Store.verify_backup(spark, path)
        source, target = Files(spark, path), Files(spark, to)
        if target.names(""):
            raise Conflict("the target isn't empty")
        for n in json.loads(source.read("INVENTORY.json")):
            source.copy(n, target)
        return Store(spark, to, json.loads(source.read(next(n for n in source.tree("manifests"))))["shards"])

    def checkpoint(self, to: str) -> Store:
        """A copy that opens as a store of its own."""
        self.backup(to)
        return Store(self.spark, to, self.state["shards"])

    def repair_to_copy(self, to: str) -> Store:
        """A checkpoint whose derived data is made anew: sequences from the log, every surface rebuilt."""
        copy = self.checkpoint(to)
        last = copy.mutations().groupBy("shard").agg(F.max("sequence").alias("last")).collect()  # one row for each shard
        copy._publish({"sequence": copy.state["sequence"] | {str(r["shard"]): max(r["last"], copy.state["sequence"].get(str(r["shard"]), 0)) for r in last}})
        for name in copy.state["surfaces"]:
            copy.rebuild_surface(name)
        copy.verify()
        return copy

    @staticmethod
    def rekey(spark: SparkSession, path: str, to: str, keyring: dict[str, bytes], key: bytes, key_id: str) -> None:
        """An encrypted export opened with a keyring and sealed again under one key."""
        aad = F.concat_ws("|", *[F.hex(c) for c in IDENTITY], F.lit(key_id))
        sealed = F.aes_encrypt("body", F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), aad)
        Store.encrypted_import(spark, path, keyring).select(*IDENTITY, sealed.alias("sealed"), F.lit(key_id).alias("key_id")).write.parquet(to)

    def surface_json(self, name: str) -> str:
        """A surface's capped rows as one JSON array in component order; its size was bounded when it was built."""
        rows = self.read_surface(name)[0]
        size = F.to_json(F.struct(*IDENTITY, "payload", "content_type", "sequence")).alias("j")
        return "[" + ",".join(r["j"] for r in rows.select(size).collect()) + "]"

    def encrypted_export(self, to: str, key: bytes, key_id: str) -> None:
        """Live payload texts and bytes under AES-GCM; the identity and key id are authenticated with them."""
        aad = F.concat_ws("|", *[F.hex(c) for c in IDENTITY], F.lit(key_id))
        body = F.coalesce(F.col("payload.bytes"), F.col("payload.text").cast("binary"))
        rows = self.heads().filter("not tombstone").select(*IDENTITY, F.aes_encrypt(body, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), aad).alias("sealed"), F.lit(key_id).alias("key_id"))
        rows.write.parquet(to)

    @staticmethod
    def encrypted_import(spark: SparkSession, path: str, keyring: dict[str, bytes]) -> DataFrame:
        rows, opened = spark.read.parquet(path), None
        for k, v in keyring.items():
            aad = F.concat_ws("|", *[F.hex(c) for c in IDENTITY], F.lit(k))
            opened = (F if opened is None else opened).when(F.col("key_id") == k, F.aes_decrypt("sealed", F.lit(bytearray(v)), F.lit("GCM"), F.lit("DEFAULT"), aad))
        return rows.select(*IDENTITY, opened.alias("body"))

    def sequence_numbers(self) -> DataFrame:
        """Each event with its number inside its shard, for checks."""
        return self.events().withColumn("n", F.row_number().over(Window.partitionBy("shard").orderBy("sequence")))


def _name(parts) -> str:
    return "/".join(p if isinstance(p, str) else p.decode() for p in parts)
