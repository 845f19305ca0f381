"""Queries that drive a store through its calls, and the SQL of what must be left.

Each builds a store in the shared folder from ``nation``, ``region``, ``customer`` or ``embeddings``, runs a fixed script of calls
at fixed times and returns what is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions import codec
from rillstone.operators import records
from rillstone.operators.quota import Guard, Quota
from rillstone.plans.catalog import _SCORE, KEY, LOG, QUERIES, SQL, _query_vectors, log, query, table
from rillstone.schema import ChangeLogGap, Conflict, InvalidArgument, LeaseError, NotFound, ResourceLimit, Unsupported
from rillstone.sources import legacy, shared
from rillstone.sources.files import Files
from rillstone.store import Mutation, Store, identity
from rillstone.streaming import flows

C = ("t", "n", "c")
PARTS = tuple(x.encode() for x in C)
ERRORS = (ChangeLogGap, Conflict, InvalidArgument, LeaseError, NotFound, ResourceLimit, Unsupported)
_stores: dict[tuple[str, str], Store] = {}


def ident(key: str, partition: str = "p", collection: str = "c"):
    return identity("t", "n", collection, partition, key)


def fresh(spark: SparkSession, **options) -> Store:
    return Store(spark, shared.fresh_path(spark, "store"), 4, **options)


def nations(spark: SparkSession, d: str) -> list[tuple[int, str]]:
    return sorted((int(r[0]), r[1]) for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect())  # 25 rows


def regions(spark: SparkSession, d: str) -> list[tuple[int, str]]:
    return sorted((int(r[0]), r[1]) for r in table(spark, d, "region").select("r_regionkey", "r_name").collect())  # 5 rows


def lived(spark: SparkSession, d: str) -> Store:
    """25 puts, 5 compare-and-swaps, 4 deletions and 5 appends, a batch each; read-only to the queries that share it."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _stores:
        s = fresh(spark)
        rows = nations(spark, d)
        first = s.atomic_batch([Mutation(ident(f"{k:02d}"), name) for k, name in rows], at_ms=1000)
        s.atomic_batch([Mutation(ident(f"{k:02d}"), f"{name}!", expected=first[k].sequence) for k, name in rows if k % 5 == 0], at_ms=2000)
        s.atomic_batch([Mutation(ident(f"{k:02d}"), op="delete") for k, _ in rows if k % 7 == 0], at_ms=3000)
        s.atomic_batch([Mutation(ident(f"x{k}"), name, op="append", expected="missing") for k, name in regions(spark, d)], at_ms=4000)
        _stores[at] = s
    return _stores[at]


def _shard(s: Store) -> int:
    return int(next(iter(s.state["sequence"])))


def keyed() -> Column:
    return F.col("key").cast("string").alias("key")


def text() -> Column:
    return F.col("payload.text").alias("value")



VERSIONS = """with n as (select n_nationkey::bigint as k, lpad(n_nationkey::varchar, 2, '0') as key, n_name from nation), v as (
  select key, k + 1 as sequence, null::bigint as previous, 'put' as op, 'ready' as state, false as tombstone, n_name as value, 1 as batch_id from n
  union all select key, 26 + k // 5, k + 1, 'put', 'ready', false, n_name || '!', 26 from n where k % 5 = 0
  union all select key, 31 + k // 7, case when k % 5 = 0 then 26 + k // 5 else k + 1 end, 'delete', 'ready', true, null, 31 from n where k % 7 = 0
  union all select 'x' || r_regionkey, 35 + r_regionkey, null, 'append', 'pending', false, r_name, 35 from region
), h as (select * from v where (key, sequence) in (select key, max(sequence) from v group by key))"""


@query(VERSIONS + " select key, sequence::bigint as sequence, previous, op, state, tombstone, value, 1000::bigint as created_ms from h where key not like 'x%' union all select key, sequence, previous, op, state, tombstone, value, 4000 from h where key like 'x%'")
def store_heads(spark: SparkSession, d: str) -> DataFrame:
    return lived(spark, d).heads().select(keyed(), "sequence", "previous", "op", F.col("workflow.state").alias("state"), "tombstone", text(), "created_ms")


@query(VERSIONS + " select key, sequence::bigint as sequence, op, batch_id::bigint as batch_id, value from v")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    return lived(spark, d).versions().select(keyed(), "sequence", "op", "batch_id", text())


@query(VERSIONS + " select key, value, (select max(sequence) from v x where x.key = n.key)::bigint as current, n_name as first from n left join (select key, value from h where not tombstone) using (key)")
def store_point_reads(spark: SparkSession, d: str) -> DataFrame:
    s, out = lived(spark, d), []
    ids = [ident(f"{k:02d}") for k, _ in nations(spark, d)]
    old = {bytes(r["key"]): r["payload"]["text"] for r in s.versions().filter("batch_id = 1").collect()}  # 25 rows
    for i, row in zip(ids, s.get_batch(ids, at_ms=9000), strict=True):
        current = s._heads_of([i])[i]["sequence"] if i is ids[0] else None
        out.append((i[4].decode(), row and row["payload"]["text"], current, old[i[4]]))
    heads = {i: r["sequence"] for i, r in s._heads_of(ids).items()}
    return spark.createDataFrame([(k, v, heads[i], f) for i, (k, v, _, f) in zip(ids, out, strict=True)], "key string, value string, current long, first string")


@query(VERSIONS + " select key, sequence::bigint as sequence, value from v where key = '05' union all select 'absent', null, null")
def store_get_version(spark: SparkSession, d: str) -> DataFrame:
    s, i = lived(spark, d), ident("05")
    rows = [("05", n, s.get_version(i, n)["payload"]["text"]) for n in (6, s.current_version(i))]
    try:
        s.get_version(i, 999)
    except NotFound:
        rows.append(("absent", None, None))
    return spark.createDataFrame(rows, "key string, sequence long, value string")


@query(VERSIONS + " select key, value from h where not tombstone and key like '1%'")
def store_scan_prefix(spark: SparkSession, d: str) -> DataFrame:
    return lived(spark, d).scan_prefix(PARTS, b"1", at_ms=9000).select(keyed(), text())


@query(VERSIONS + " select sequence::bigint as sequence, key, op from v where sequence between 26 and 30")
def store_changes(spark: SparkSession, d: str) -> DataFrame:
    s = lived(spark, d)
    page = s.changes(_shard(s), 25, 2)  # to the end of its batch
    return spark.createDataFrame([(r["sequence"], bytes(r["key"]).decode(), r["op"]) for r in page], "sequence long, key string, op string")


@query(VERSIONS + " select sequence::bigint as sequence, key, 34::bigint as watermark from v where sequence between 31 and 34")
def store_subscription(spark: SparkSession, d: str) -> DataFrame:
    s = lived(spark, d)
    page, mark = s.subscribe_changes(PARTS, _shard(s), 30, 1)
    return spark.createDataFrame([(r["sequence"], bytes(r["key"]).decode(), mark) for r in page], "sequence long, key string, watermark long")


@query(VERSIONS + " select count(*) as events, count(*) as versions, (select count(*) from h) as heads, (select count(*) from h where tombstone) as tombstones, max(sequence)::bigint as last from v")
def store_verify(spark: SparkSession, d: str) -> DataFrame:
    s = lived(spark, d)
    v, n = s.verify(), s.stats()
    return spark.createDataFrame([(v["events"], v["versions"], v["heads"], n["tombstones"], s.state["sequence"][str(_shard(s))])], "events long, versions long, heads long, tombstones long, last long")


@query(VERSIONS + " select 'raw' as codec, count(*) as n, sum(octet_length(encode(value)))::bigint as raw_bytes, sum(octet_length(encode(value)))::bigint as stored_bytes from h where not tombstone")
def store_compression_stats(spark: SparkSession, d: str) -> DataFrame:
    return lived(spark, d).compression_stats()


@query(VERSIONS + " select key, sequence::bigint as sequence, value from h")
def store_backup_restore(spark: SparkSession, d: str) -> DataFrame:
    backup, to = shared.fresh_path(spark, "backup"), shared.fresh_path(spark, "restored")
    lived(spark, d).backup(backup)
    return Store.restore(spark, backup, to).heads().select(keyed(), "sequence", text())


@query(VERSIONS + " select key, sequence::bigint as sequence, value from h")
def store_repair_copy(spark: SparkSession, d: str) -> DataFrame:
    return lived(spark, d).repair_to_copy(shared.fresh_path(spark, "copy")).heads().select(keyed(), "sequence", text())


@query(VERSIONS + " select key, value from h where not tombstone")
def store_rekey(spark: SparkSession, d: str) -> DataFrame:
    one, two = shared.fresh_path(spark, "sealed"), shared.fresh_path(spark, "resealed")
    lived(spark, d).encrypted_export(one, b"k" * 16, "old")
    Store.rekey(spark, one, two, {"old": b"k" * 16}, b"n" * 32, "new")
    return Store.encrypted_import(spark, two, {"new": b"n" * 32}).select(keyed(), F.col("body").cast("string").alias("value"))


def _outcomes(spark: SparkSession, cases: list[tuple[str, object]]) -> DataFrame:
    out = []
    for name, call in cases:
        try:
            call()
            out.append((name, "ok"))
        except ERRORS as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, '"case" string, outcome string'.replace('"', "`"))


def _expected(cases: dict[str, str]) -> str:
    return "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in cases.items()) + ') t("case", outcome)'


@query(_expected({"swap to a stale version": "Conflict", "append to a tombstone": "Conflict", "put over a tombstone": "ok", "two partitions": "InvalidArgument", "one identity twice": "InvalidArgument", "too many": "ResourceLimit", "delete an unknown key": "ok", "delete an unknown version": "Conflict", "large metadata": "ResourceLimit", "vector beyond floats": "InvalidArgument", "empty key": "InvalidArgument"}))
def store_preconditions(spark: SparkSession, d: str) -> DataFrame:
    s = fresh(spark)
    names = [n for _, n in regions(spark, d)]
    a = s.put(ident("a"), names[0])
    s.put(ident("a"), names[1])
    s.delete(ident("b"))
    return _outcomes(spark, [
        ("swap to a stale version", lambda: s.compare_and_swap(ident("a"), "x", a.sequence)), ("append to a tombstone", lambda: s.append(ident("b"), "x")), ("put over a tombstone", lambda: s.put(ident("b"), "x")),
        ("two partitions", lambda: s.atomic_batch([Mutation(ident("a"), 1), Mutation(ident("a", "q"), 1)])), ("one identity twice", lambda: s.atomic_batch([Mutation(ident("a"), 1), Mutation(ident("a"), 2)])),
        ("too many", lambda: s.atomic_batch([Mutation(ident(str(k)), k) for k in range(1025)])), ("delete an unknown key", lambda: s.delete(ident("z"))), ("delete an unknown version", lambda: s.delete(ident("y"), expected=3)),
        ("large metadata", lambda: s.put(ident("m"), 1, metadata={"k": b"x" * 70_000})), ("vector beyond floats", lambda: s.put(ident("v"), [1e300])), ("empty key", lambda: s.put(ident(""), 1)),
    ])


@query(_expected({"within": "ok", "too large": "ResourceLimit", "vector work": "ResourceLimit", "too often": "ResourceLimit", "over the disk": "ResourceLimit"}))
def store_quotas(spark: SparkSession, d: str) -> DataFrame:
    guard = Guard(Quota(max_bytes=400, per_second=2, in_flight=1, vector_work=100), lambda: 0.0)
    s, full = fresh(spark, guard=guard), fresh(spark, max_bytes=10)

    def work():
        with Guard(guard.default).request("t", dim=64, scan=2):
            pass

    def often():
        for _ in range(2):
            with guard.request("t"):
                pass

    return _outcomes(spark, [("within", lambda: s.put(ident("a"), "x")), ("too large", lambda: s.put(ident("b"), "x" * 500)), ("vector work", work), ("too often", often), ("over the disk", lambda: full.put(ident("a"), "x"))])


@query("select * from (values ('first', 1::bigint, 2::bigint), ('again', 1, 2), ('other', null, null), ('purged', 0, 1), ('after', 3, 4)) t(call, lowest, highest)")
def store_idempotency(spark: SparkSession, d: str) -> DataFrame:
    s, r = fresh(spark), regions(spark, d)
    batch = [Mutation(ident("a"), r[0][1]), Mutation(ident("b"), r[1][1])]
    ends = lambda receipts: (receipts[0].sequence, receipts[-1].sequence)
    out = [("first", *ends(s.atomic_batch(batch, request=b"r", at_ms=1000, request_ttl_ms=500))), ("again", *ends(s.atomic_batch(batch, request=b"r", at_ms=1200)))]
    try:
        s.atomic_batch(batch[:1], request=b"r", at_ms=1200)
    except Conflict:
        out.append(("other", None, None))
    out.append(("purged", s.purge_expired_idempotency(1400), s.purge_expired_idempotency(1500)))
    out.append(("after", *ends(s.atomic_batch(batch, request=b"r", at_ms=1600))))
    return spark.createDataFrame(out, "call string, lowest long, highest long")


@query("""with v as (select 'x' || r_regionkey as key, t * 5 + r_regionkey + 1 as sequence, r_name || t as value from region, range(4) r(t))
select key, sequence::bigint as sequence, case when sequence > 15 then value end as value, sequence > 10 as event from v where sequence > 10""")
def store_gc(spark: SparkSession, d: str) -> DataFrame:
    """Four batches; the slower consumer is in the third, so the first two go as events and, all superseded, as versions."""
    s = fresh(spark)
    s.configure_collection(*C, required_consumers=["fast", "slow"])
    for t in range(4):
        last = s.atomic_batch([Mutation(ident(f"x{k}"), f"{name}{t}") for k, name in regions(spark, d)], at_ms=t)[-1]
    s.acknowledge_consumer(C, "fast", last.shard, 20)
    s.acknowledge_consumer(C, "slow", last.shard, 12)
    if s.garbage_collect(C) != {"events": 10, "versions": 10}:
        raise AssertionError("other counts")
    left = s.mutations().select(*[F.col(c) for c in ("key", "sequence", "event_present", "payload")])
    return left.select(keyed(), "sequence", F.when(F.col("sequence") > 15, F.col("payload.text")).alias("value"), F.col("event_present").alias("event"))


@query("""select 'x' || r_regionkey as key, t * 5 + r_regionkey + 1 as sequence, case when t = 1 then r_name || t end as value from region, range(2) r(t)""")
def store_dereference(spark: SparkSession, d: str) -> DataFrame:
    """Events resolved to their versions; those whose version was collected keep their place without a payload."""
    s = fresh(spark)
    for t in range(2):
        s.atomic_batch([Mutation(ident(f"x{k}"), f"{name}{t}") for k, name in regions(spark, d)], at_ms=t)
    events = s.events()
    s._rewrite(s.mutations().withColumn("version_present", F.col("sequence") > 5))
    return s.dereference(events).select(keyed(), "sequence", text())


@query("""with n as (select n_nationkey::bigint as k, lpad(n_nationkey::varchar, 2, '0') as key from nation)
select key, case k when 1 then 'published' when 2 then 'completed' when 4 then 'dead_letter' else 'leased' end as state,
  (case when k in (3, 5, 6) then 2 else 1 end)::int as attempt, (case when k in (3, 5, 6) then 2 else 1 end)::bigint as fencing,
  (case when k = 0 then 7500 when k in (1, 2, 4) then null when k in (3, 10, 11) then 3600 when k in (7, 8, 9) then 3000 else 11000 end)::bigint as deadline_ms from n""")
def store_work_queue(spark: SparkSession, d: str) -> DataFrame:
    """Claims, a heartbeat, completions, failures, a publication, and leases that ran out and are claimed again."""
    s = fresh(spark)
    s.atomic_batch([Mutation(ident(f"{k:02d}"), name, op="append") for k, name in nations(spark, d)], at_ms=1000)
    got = {c["id"][4].decode(): (c["id"], c["lease_id"], c["fencing"]) for c in s.claim(ident("x")[:4], 1000, 10, at_ms=2000)}
    s.heartbeat(*got["00"], 5000, at_ms=2500)
    for k in ("01", "02"):
        s.complete(*got[k], at_ms=2500)
    s.fail(*got["03"], at_ms=2500)
    s.fail(*got["04"], permanent=True, at_ms=2500)
    s.publish(got["01"][0], at_ms=2550)
    s.claim(ident("x")[:4], 1000, 3, at_ms=2600)
    s.claim(ident("x")[:4], 1000, 15, at_ms=10_000)
    w = F.col("workflow")
    return s.heads().select(keyed(), w.state.alias("state"), w.attempt.alias("attempt"), w.fencing.alias("fencing"), w.deadline_ms.alias("deadline_ms"))


@query(_expected({"stale fencing": "LeaseError", "another lease": "LeaseError", "too late": "LeaseError", "not leased": "LeaseError", "unknown": "NotFound", "publish unfinished": "LeaseError", "delta claim": "Unsupported", "delta without delta": "InvalidArgument", "other claim arguments": "Conflict", "claim replay": "ok"}))
def store_lease_proofs(spark: SparkSession, d: str) -> DataFrame:
    s = fresh(spark)
    s.configure_collection("t", "n", "d", retention="delta")
    s.atomic_batch([Mutation(ident(f"{k:02d}"), name, op="append") for k, name in regions(spark, d)], at_ms=1000)
    part = ident("x")[:4]
    (c,) = s.claim(part, 1000, 1, at_ms=2000, request=b"q")
    i = c["id"]
    return _outcomes(spark, [
        ("stale fencing", lambda: s.complete(i, c["lease_id"], 0, at_ms=2001)), ("another lease", lambda: s.complete(i, b"x" * 16, 1, at_ms=2001)), ("too late", lambda: s.complete(i, c["lease_id"], 1, at_ms=3000)),
        ("not leased", lambda: s.complete(ident("01"), c["lease_id"], 1, at_ms=2001)), ("unknown", lambda: s.complete(ident("zz"), b"", 1, at_ms=2001)), ("publish unfinished", lambda: s.publish(ident("01"), at_ms=2001)),
        ("delta claim", lambda: s.claim(ident("x", collection="d")[:4], 1000)), ("delta without delta", lambda: s.put(ident("a", collection="d"), 1)),
        ("other claim arguments", lambda: s.claim(part, 1000, 2, at_ms=2001, request=b"q")), ("claim replay", lambda: s.claim(part, 1000, 1, at_ms=2001, request=b"q")[0]["lease_id"] == c["lease_id"] or 1 / 0),
    ])


@query("""select lpad(n_nationkey::varchar, 2, '0') as key, n_nationkey <= 10 as tombstone, case when n_nationkey > 10 then 1000 + n_nationkey * 100 end::bigint as expires_ms from nation""")
def store_expire(spark: SparkSession, d: str) -> DataFrame:
    s = fresh(spark)
    s.atomic_batch([Mutation(ident(f"{k:02d}"), name, ttl_ms=k * 100) for k, name in nations(spark, d)], at_ms=1000)
    s.expire_due(1500, 4)  # 00 to 03
    s.expire_due(2000)
    return s.heads().select(keyed(), "tombstone", "expires_ms")


@query("""select lpad(n_nationkey::varchar, 2, '0') as key, 2::bigint as generation, 1::bigint as stale from nation where n_nationkey % 6 <> 0 order by key limit 15""")
def store_surface(spark: SparkSession, d: str) -> DataFrame:
    """Built, changed, folded, changed again: the second generation's first 15 rows, one event behind."""
    s = fresh(spark)
    rows = nations(spark, d)
    s.atomic_batch([Mutation(ident(f"{k:02d}"), name, op="append") for k, name in rows], at_ms=1000)
    s.create_surface("work", C, ["pending"], max_records=15)
    s.build_surface("work", at_ms=1000)
    s.atomic_batch([Mutation(ident(f"{k:02d}"), op="delete") for k, _ in rows if k % 6 == 0], at_ms=2000)
    g = s.build_surface("work", at_ms=2000)
    s.delete(ident("01"))
    found, stale = s.read_surface("work")
    return found.select(keyed(), F.lit(g).cast("long").alias("generation"), F.lit(sum(stale.values())).cast("long").alias("stale"))


@query("""with f as (select lpad(n_nationkey::varchar, 2, '0') as key, (case when n_nationkey < 12 then 31 else 500 end)::int as freshness, (case when n_nationkey % 5 = 0 then 900 else 0 end)::int as urgency, n_nationkey = 5 as pinned from nation),
s as (select *, ((freshness * 700 + urgency * 300) // 1000)::int as score from f)
select key, freshness, urgency, score, case when pinned then 'hot' when score >= 700 then 'hot' when score <= 350 then 'cold' else 'warm' end as layer from s""")
def store_placement(spark: SparkSession, d: str) -> DataFrame:
    s = fresh(spark)
    rows = nations(spark, d)
    for at, some in ((1_000_000, rows[:12]), (5_000_000, rows[12:])):
        s.atomic_batch([Mutation(ident(f"{k:02d}"), name) for k, name in some], at_ms=at)
    s.configure_placement(C, half_life_ms=1_000_000, residency_ms=0)
    for k in range(0, 25, 5):
        s.set_signals(ident(f"{k:02d}"), urgency=900, pinned=k == 5)
    return s.explain_placement(C, 6_000_000).select(keyed(), "freshness", "urgency", "score", "layer")


@query("select * from (values (1::bigint, 'verify', 'attempted'), (2, 'verify', 'succeeded'), (3, 'gc', 'attempted'), (4, 'gc', 'failed')) t(n, action, outcome)")
def store_audit(spark: SparkSession, d: str) -> DataFrame:
    s = fresh(spark)
    s.audited("me", "verify", s.verify)
    try:
        s.audited("me", "gc", s.garbage_collect, C)
    except InvalidArgument:
        pass
    return spark.createDataFrame([(e["n"], e["action"], e["outcome"]) for e in s.read_audit()], "n long, action string, outcome string")


@query("select c_custkey::varchar as key, case when c_custkey % 3 = 0 then c_name || '!' else c_name end as value, case when c_custkey % 3 = 0 then 2 else 1 end::bigint as versions, true as gapless from customer")
def store_put_frame(spark: SparkSession, d: str) -> DataFrame:
    """All customers in one commit, a third again in a second; sequences have no gap in any shard."""
    s, c = fresh(spark), table(spark, d, "customer")

    def rows(value, where: str) -> DataFrame:
        part = F.concat(F.lit("p"), F.pmod("c_custkey", F.lit(64)).cast("string"))
        return c.filter(where).select(F.lit("t").alias("tenant"), F.lit("n").alias("namespace"), F.lit("c").alias("collection"), part.alias("partition"), F.col("c_custkey").cast("string").alias("key"), F.lit("text").alias("kind"), value.alias("text"))

    s.put_frame(rows(F.col("c_name"), "true"), at_ms=1000)
    s.put_frame(rows(F.concat("c_name", F.lit("!")), "c_custkey % 3 = 0"), at_ms=2000)
    n = s.versions().groupBy("key").agg(F.count("*").alias("versions"))
    whole = s.versions().groupBy("shard").agg((F.countDistinct("sequence") == F.max("sequence")).alias("ok")).agg(F.min("ok").alias("gapless"))
    return s.heads().join(n, "key").select(keyed(), text(), "versions").crossJoin(F.broadcast(whole))  # one row


@query(f"""with s as (select v.vec_id, {_SCORE["cosine"]} as score from embeddings v, (select embedding from embeddings where vec_id = 0) q)
select vec_id::varchar as key, round(score::double, 6) as score, (select count(*) + 1 from embeddings) as scanned, (select count(*) from embeddings) as candidates from s order by score desc, vec_id limit 10""")
def store_vector_exact(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings in a store, and one text: what the search scans, scores and finds."""
    s = fresh(spark)
    ids = [F.lit(x).alias(c) for c, x in zip(("tenant", "namespace", "collection", "partition"), (*C, "p"), strict=True)]
    s.put_frame(table(spark, d, "embeddings").select(*ids, F.col("vec_id").cast("string").alias("key"), F.lit("vector").alias("kind"), F.col("embedding").alias("vector")))
    s.put(ident("text"), "no vector")
    n = s.vector_counts(*C, 64)
    top = s.vector_exact(*C, _query_vectors(spark, d, 1)[0], 10)
    return top.select(keyed(), F.round(F.col("score").cast("double"), 6).alias("score"), F.lit(n["scanned"]).cast("long").alias("scanned"), F.lit(n["candidates"]).cast("long").alias("candidates"))


def _old_files(spark: SparkSession, d: str) -> tuple[Files, str]:
    """A snapshot of all nations at sequences 1 to 25, and a log: the regions' five overwrite 00 to 04, 20 to 24 go; its last frame is torn."""
    files = Files(spark, shared.fresh_path(spark, "old"))
    rows = nations(spark, d)
    files.replace("store.snapshot", legacy.SNAPSHOT_MAGIC + b"".join(legacy.frame(k + 1, f"{k:02d}", "text", name * 40) for k, name in rows))
    frames = [legacy.frame(26 + k, f"{k:02d}", "text", name) for k, name in regions(spark, d)] + [legacy.frame(31 + k, f"{20 + k}") for k in range(5)]
    files.replace("store.log", b"".join(frames) + legacy.frame(36, "00")[:-3])
    return files, files.root


_OLD = """with n as (select n_nationkey::bigint as k, lpad(n_nationkey::varchar, 2, '0') as key, n_name from nation)
select key, coalesce(r_name, repeat(n_name, 40)) as value{} from n left join region on r_regionkey = k where k < 20"""


@query(_OLD.format(", case when k < 5 then 26 + k else k + 1 end::bigint as sequence"))
def legacy_replay(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot and log of the first generation replayed, the torn tail cut, live keys exported."""
    files, root = _old_files(spark, d)
    if not legacy.repair(files, "store.log") or legacy.repair(files, "store.log"):
        raise AssertionError("the tail was not cut once")
    found = legacy.live_export(legacy.read_files(spark, f"{root}/store.snapshot", f"{root}/store.log"), 1000)
    return found.select("key", F.col("text").alias("value"), "sequence")


@query(_OLD.format(", case when k < 5 then 26 + k else k + 1 end::bigint as sequence"))
def legacy_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot saved over the old one, read again."""
    files, root = _old_files(spark, d)
    everything = legacy.read_files(spark, f"{root}/store.snapshot", f"{root}/store.log")
    legacy.save_snapshot(everything, files, "store.snapshot")
    return legacy.read_files(spark, f"{root}/store.snapshot").select("key", F.col("text").alias("value"), "sequence")


@query(_OLD.format(""))
def legacy_import(spark: SparkSession, d: str) -> DataFrame:
    _, root = _old_files(spark, d)
    s = fresh(spark)
    legacy.import_into(s, legacy.read_files(spark, f"{root}/*"), *C)
    return s.heads().select(keyed(), text())


@query("""with r as (select n_nationkey as k, repeat(n_name || ' is a nation. ', 3) as t from nation) select k::bigint as k, octet_length(encode(t))::bigint as size, sha256(t) as sha from r""")
def dictionary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts packed and opened with a shared dictionary."""
    rows = [(k, f"{name} is a nation. ".encode() * 3) for k, name in nations(spark, d)]
    book, p = b" ".join(t for _, t in rows), codec.Policy(min_input=0, min_savings=0)
    back = [(k, codec.decode(codec.encode(t, p, dictionary=book), dictionary=book)) for k, t in rows]
    return spark.createDataFrame([(k, bytearray(t)) for k, t in back], "k long, t binary").select("k", F.octet_length("t").cast("long").alias("size"), F.sha2("t", 256).alias("sha"))


# ---------------------------------------------------------------- streams


def _drain(spark: SparkSession, stream: DataFrame, each, mode: str = "append") -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", shared.fresh_path(spark, "progress")).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return flows.event_stream(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)


@query("""select epoch_us(time_bucket(interval 1 hour, ts)) // 1000 as start_ms, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    path = shared.fresh_path(spark, "windows")
    _drain(spark, flows.windowed_counts(_event_stream(spark, d), "event_type"), lambda b, n: b.write.mode("overwrite").parquet(path), "complete")
    w = spark.read.parquet(path)
    return w.select(F.unix_millis("window.start").alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


@query(LOG + " select user_id, seq, state from heads where not tombstone and state in ('pending')")
def stream_surface(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream of files, folded batch by batch into generations."""
    rows, path = log(spark, d), shared.fresh_path(spark, "generations")
    folder = rows.inputFiles()[0].rsplit("/shard=", 1)[0]
    _drain(spark, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(folder), flows.surface_sink(path, KEY, "seq", ["pending"]))
    return flows.newest_generation(spark, path).select("user_id", "seq", "state")


@query("select min(event_id) as event_id, user_id, event_type from events group by user_id, event_type")
def batch_first_of_key(spark: SparkSession, d: str) -> DataFrame:
    """What an idempotent stream keeps of a whole table: the first event of each key."""
    out = records.idempotent(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_type", "event_id")
    return out.filter("outcome = 'stored'").select("event_id", "user_id", "event_type")


__all__ = ["QUERIES", "SQL"]
