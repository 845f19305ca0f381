import pytest

from rillstone.functions import codec
from rillstone.operators.quota import Guard, Quota
from rillstone.schema import ChangeLogGap, Conflict, Corruption, InvalidArgument, LeaseError, ResourceLimit
from rillstone.store import Mutation, Store, identity

C = ("t", "n", "c")


def ident(key, partition="p", collection="c"):
    return identity("t", "n", collection, partition, key)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), 4)


def test_put_get_delete_and_time_travel(store, spark):
    a = ident("a")
    first = store.put(a, "one")
    second = store.compare_and_swap(a, "two", first.sequence)
    with pytest.raises(Conflict):
        store.compare_and_swap(a, "three", first.sequence)
    assert store.get(a)["payload"]["text"] == "two"
    assert store.get_version(a, first.sequence)["payload"]["text"] == "one"
    store.delete(a)
    assert store.get(a) is None and store.current_version(a) > second.sequence
    with pytest.raises(Conflict):  # a tombstone counts as present
        store.append(a, "again")
    created = store.get_version(a, first.sequence)["created_ms"]
    store.put(a, "back")
    assert store.get(a)["created_ms"] == created
    assert Store(spark, store.root, 4).get(a)["payload"]["text"] == "back"
    assert store.verify()["heads"] == 1


def test_batch_pages_idempotency_and_limits(store):
    a, b = ident("a"), ident("b")
    got = store.atomic_batch([Mutation(a, 1), Mutation(b, 2.5)], request=b"r" * 32, at_ms=1000)
    assert got == store.atomic_batch([Mutation(a, 1), Mutation(b, 2.5)], request=b"r" * 32, at_ms=2000)
    with pytest.raises(Conflict):
        store.atomic_batch([Mutation(a, 9)], request=b"r" * 32, at_ms=2000)
    page = store.changes(got[0].shard, 0, 1)
    assert len(page) == 2 and page[0]["batch_id"] == page[1]["batch_id"]  # a page ends with its batch
    assert store.changes(got[0].shard, 0, 0) == []
    with pytest.raises(InvalidArgument):
        store.changes(got[0].shard, 99, 10)
    with pytest.raises(InvalidArgument):
        store.atomic_batch([Mutation(a, 1), Mutation(ident("a", "other"), 1)])
    assert store.purge_expired_idempotency(10**15) == 1
    assert store.get_batch([b, ident("x"), a])[1] is None


def test_consumers_gc_and_gap(store):
    store.configure_collection(*C, required_consumers=["x"])
    a = ident("a")
    for k in range(4):
        last = store.put(a, k)
    store.create_surface("s", C, ["ready"])
    store.configure_collection(*C, required_consumers=["x"])  # replaces what the surface had added
    store.acknowledge_consumer(C, "x", last.shard, 3)
    with pytest.raises(InvalidArgument):
        store.acknowledge_consumer(C, "x", last.shard, 2)
    assert store.garbage_collect(C) == {"events": 3, "versions": 3}
    with pytest.raises(ChangeLogGap):
        store.changes(last.shard, 0, 10)
    with pytest.raises(ChangeLogGap):
        store.build_surface("s")
    store.rebuild_surface("s")
    assert store.read_surface("s")[0].count() == 1
    assert store.garbage_collect(C) == {"events": 0, "versions": 0}


def test_workflow_fencing(store):
    a = ident("a")
    store.append(a, "job")
    (c,) = store.claim(a[:4], 1000, at_ms=10_000)
    store.heartbeat(a, c["lease_id"], c["fencing"], 1000, at_ms=10_100)
    assert store.fail(a, c["lease_id"], c["fencing"], at_ms=10_200)["state"] == "pending"
    (d,) = store.claim(a[:4], 1000, at_ms=20_000)
    assert d["attempt"] == 2 and d["fencing"] == 2
    with pytest.raises(LeaseError):
        store.complete(a, c["lease_id"], c["fencing"], at_ms=20_001)
    assert store.claim(a[:4], 1000, at_ms=20_500) == []
    store.complete(a, d["lease_id"], d["fencing"], at_ms=20_600)
    assert store.publish(a, at_ms=20_700)["state"] == "published" == store.publish(a)["state"]


def test_claim_replay(store):
    part = ident("a")[:4]
    assert store.claim(part, 1000, at_ms=1, request=b"0") == []
    store.append(ident("a"), "job")
    assert store.claim(part, 1000, at_ms=2, request=b"0") == []
    first = store.claim(part, 1000, at_ms=3, request=b"1")
    assert len(first) == 1 and store.claim(part, 1000, at_ms=4, request=b"1") == first
    with pytest.raises(Conflict):
        store.claim(part, 2000, at_ms=4, request=b"1")


def test_surfaces_incremental_equals_rebuild(store):
    for k in ("a", "bb", "c"):
        store.append(ident(k), k)
    store.create_surface("work", C, ["pending"])
    store.build_surface("work")
    rows, stale = store.read_surface("work")
    assert [bytes(r["key"]) for r in rows.collect()] == [b"a", b"bb", b"c"] and not any(stale.values())
    store.delete(ident("bb"))
    assert any(store.read_surface("work")[1].values())
    g = store.build_surface("work")
    assert g == store.build_surface("work")
    folded = [bytes(r["key"]) for r in store.read_surface("work")[0].collect()]
    store.rebuild_surface("work")
    assert folded == [bytes(r["key"]) for r in store.read_surface("work")[0].collect()] == [b"a", b"c"]


def test_ttl_scan_order_vectors_placement(store):
    store.atomic_batch([Mutation(ident("zz"), [1.0, 0.0], ttl_ms=5), Mutation(ident("b"), [1.0, 0.0]), Mutation(ident("a"), [0.0, 1.0]), Mutation(ident("w"), [1.0, 0.0, 0.0]), Mutation(ident("t"), "text")], at_ms=1000)
    top = store.vector_exact(*C, [1.0, 0.0], 3, at_ms=1001).collect()
    assert [bytes(r["key"]) for r in top] == [b"b", b"zz", b"a"]
    assert [bytes(r["key"]) for r in store.scan_prefix((b"t", b"n", b"c"), at_ms=1001).collect()] == [b"a", b"b", b"t", b"w", b"zz"]
    assert store.expire_due(1004) == 0 and store.expire_due(1005) == 1 and store.get(ident("zz"), 1) is None
    with pytest.raises(InvalidArgument):
        store.vector_exact(*C, [1.0, 0.0], 0)
    store.configure_placement(C, half_life_ms=1000)
    store.set_signals(ident("b"), urgency=10, pinned=True)
    layers = {bytes(r["key"]): r["layer"] for r in store.explain_placement(C, 3000).collect()}
    assert layers[b"b"] == "hot" and layers[b"a"] == "cold"


def test_backup_audit_compression(store, spark, tmp_path):
    for k in range(9):
        store.put(ident(f"k{k}"), "same words again and again " * 20)
    store.compact()
    assert store.audited("me", "verify", store.verify)["heads"] == 9
    assert [e["outcome"] for e in store.read_audit()] == ["attempted", "succeeded"]
    stats = {r["codec"]: r for r in store.compression_stats().collect()}
    assert stats["zstd"]["stored_bytes"] < stats["zstd"]["raw_bytes"]
    n = len(store.backup(str(tmp_path / "b")))
    assert Store.verify_backup(spark, str(tmp_path / "b")) == n
    again = Store.restore(spark, str(tmp_path / "b"), str(tmp_path / "r"))
    assert again.verify() == store.verify()
    victim = next(p for p in (tmp_path / "b").rglob("*.parquet"))
    victim.write_bytes(b"x")
    for crc in (tmp_path / "b").rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(Corruption):
        Store.verify_backup(spark, str(tmp_path / "b"))
    store.encrypted_export(str(tmp_path / "e"), b"k" * 16, "k1")
    assert Store.encrypted_import(spark, str(tmp_path / "e"), {"k1": b"k" * 16}).filter("body is not null").count() == 9


def test_durability_copies_and_codec(store, spark, tmp_path):
    a = ident("a")
    store.append(a, "x" * 200)
    relaxed = store.atomic_batch([Mutation(ident("b"), "y")], durable=False)[0]
    assert relaxed.durable == 1 and relaxed.sequence == 2 and store.sync()[str(relaxed.shard)] == 2
    store.create_surface("s", C, ["pending"], max_records=1)
    store.build_surface("s")
    assert store.surface_json("s").startswith("[{")
    copy = store.repair_to_copy(str(tmp_path / "copy"))
    assert copy.verify()["heads"] == 2 and copy.read_surface("s")[0].count() == 1
    store.configure_compression(level=6, skip_prefixes=("image/",))
    p = store.compression_policy()
    frame = codec.encode(b"z" * 1000, p)
    assert len(frame) < 100 and codec.decode(frame) == b"z" * 1000
    assert codec.encode(b"z" * 1000, p, "image/png")[0] == 0
    with pytest.raises(Corruption):
        codec.decode(frame[:-1] + b"!")
    df = spark.createDataFrame([("k", bytearray(b"q" * 300)), ("n", None)], "k string, d binary")
    assert {r["key"]: r["data"] and bytes(r["data"]) for r in codec.decoded(codec.encoded(df, "k", "d")).collect()} == {"k": b"q" * 300, "n": None}
    store.encrypted_export(str(tmp_path / "e1"), b"k" * 16, "old")
    Store.rekey(spark, str(tmp_path / "e1"), str(tmp_path / "e2"), {"old": b"k" * 16}, b"n" * 16, "new")
    assert Store.encrypted_import(spark, str(tmp_path / "e2"), {"new": b"n" * 16}).filter("body is not null").count() == 2
    assert store.capabilities()["shards"] == 4


def test_quota():
    now = [0.0]
    guard = Guard(Quota(max_bytes=10, per_second=2, in_flight=1, vector_work=100), lambda: now[0])
    with guard.request("t"):
        with pytest.raises(ResourceLimit), guard.request("t"):
            pass
    for bad in ({"size": 11}, {"dim": 64, "scan": 2}):
        with pytest.raises(ResourceLimit), guard.request("t", **bad):
            pass
    with guard.request("t"):
        pass
    with pytest.raises(ResourceLimit), guard.request("t"):
        pass
    now[0] = 2.0
    with guard.request("t"):
        pass
