"""Catalogue of the record-stream queries and their DuckDB SQL.

A change log is derived from ``events``: one identity for each user, shard = user_id % 16, sequence by event_id inside the shard,
batches of three.  It is written once for each application and folder, partitioned by shard and sorted by identity, as a
store keeps it; the queries read it from there, so their filters reach the scan.  Numbering works in two levels (places inside a range of
event ids, ranges inside a shard), so no task holds a shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.functions import codec, keys, payload, placement, synthetic, vectors
from rillstone.operators import changes, records, surfaces, vector_search, verify, workflow
from rillstone.sources import jsonl, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AT = 1_706_000_000_000
LATE = 1_706_745_432_000
HOUR = 3_600_000
KEY = ["user_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_logs: dict[tuple[str, str], DataFrame] = {}


def log(spark: SparkSession, d: str) -> DataFrame:
    """The change log of a folder's events."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _logs:
        _logs[at] = shared.table(_numbered(spark, d).repartition("shard", F.floor(F.col("user_id") / 4096)).sortWithinPartitions("shard", "user_id", "seq"), "log", "shard")
    return _logs[at]


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    e = table(spark, d, "events").withColumn("shard", (F.col("user_id") % 16).cast("int"))
    e = shared.table(e.repartitionByRange(ranges, "event_id").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = e.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("event_id"))
    # sizes has a row for each shard and range
    e = e.withColumn("place", place).join(sizes.withColumn("before", before), ["shard", "part"]).withColumn("seq", (F.col("before") + F.col("place")).cast("long"))
    kind = F.col("event_type")
    op = F.when(kind == "error", "delete").when(kind == "purchase", "publish").when(kind == "signup", "append").otherwise("put")
    state = F.when(kind == "error", "deleted").when(kind == "purchase", "published").otherwise("pending")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", "user_id", "event_type", "value", "seq", (F.col("seq") - (F.col("seq") - 1) % 3).alias("batch_id"), op.alias("op"), state.alias("state"),
        (kind == "error").alias("tombstone"), ts.alias("ts_ms"), (ts + HOUR * (F.col("event_id") % 48)).alias("expires_ms"), "shard",
    )


LOG = f"""with log as (
  select event_id, user_id, event_type, value, (user_id % 16)::int as shard, seq, seq - (seq - 1) % 3 as batch_id,
    case event_type when 'error' then 'delete' when 'purchase' then 'publish' when 'signup' then 'append' else 'put' end as op,
    case event_type when 'error' then 'deleted' when 'purchase' then 'published' else 'pending' end as state,
    event_type = 'error' as tombstone, epoch_us(ts) // 1000 as ts_ms, epoch_us(ts) // 1000 + {HOUR} * (event_id % 48) as expires_ms
  from (select *, row_number() over (partition by user_id % 16 order by event_id) as seq from events)
), heads as (
  select * from (select *, row_number() over (partition by user_id order by seq desc) as r from log) where r = 1
)"""

# ---------------------------------------------------------------- vectors


def _query_vectors(spark: SparkSession, d: str, n: int) -> dict[int, list[float]]:
    rows = table(spark, d, "embeddings").filter(F.col("vec_id") < n).select("vec_id", "embedding").collect()  # the request
    return {r["vec_id"]: list(r["embedding"]) for r in rows}


def _top_k(spark: SparkSession, d: str, metric: str) -> DataFrame:
    q = _query_vectors(spark, d, 1)[0]
    top = vector_search.exact_top_k(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", q, 10, [F.col("vec_id")], metric)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))
    return top.select(rank.cast("long").alias("rank"), "vec_id", F.round(F.col("score").cast("double"), 6).alias("score"))


_SCORE = {"dot": "list_dot_product(v.embedding::double[], q.embedding::double[])::float", "cosine": "(list_dot_product(v.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]) * list_dot_product(q.embedding::double[], q.embedding::double[])))::float"}


def _top_sql(metric: str) -> str:
    return f"""with s as (select v.vec_id, {_SCORE[metric]} as score from embeddings v, (select embedding from embeddings where vec_id = 0) q)
select row_number() over (order by score desc, vec_id) as rank, vec_id, round(score::double, 6) as score from s order by score desc, vec_id limit 10"""


@query(_top_sql("dot"))
def vector_topk_dot(spark: SparkSession, d: str) -> DataFrame:
    return _top_k(spark, d, "dot")


@query(_top_sql("cosine"))
def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _top_k(spark, d, "cosine")


@query(f"""with s as (select q.vec_id as query_id, v.vec_id, {_SCORE["cosine"]} as score from embeddings v, (select * from embeddings where vec_id < 5) q),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank, vec_id, round(score::double, 6) as score from r where rank <= 10""")
def vector_topk_multi(spark: SparkSession, d: str) -> DataFrame:
    out = vector_search.multi_top_k(table(spark, d, "embeddings"), "embedding", _query_vectors(spark, d, 5), 10, "vec_id")
    return out.select("query_id", F.col("rank").cast("long"), "vec_id", F.round(F.col("score").cast("double"), 6).alias("score"))


def _spoilt(spark: SparkSession, d: str) -> DataFrame:
    """The vectors, of every seven one with a NaN, one with a null, one too short and one missing."""
    v, k = F.col("embedding"), F.col("vec_id") % 7
    odd = lambda x: F.concat(F.slice(v, 1, 63), F.array(x.cast("float")))
    bad = F.when(k == 1, odd(F.lit(float("nan")))).when(k == 2, odd(F.lit(None))).when(k == 3, F.slice(v, 1, 63)).when(k == 4, F.lit(None)).otherwise(v)
    return table(spark, d, "embeddings").select("vec_id", bad.alias("embedding"))


@query("select count(*) as scanned, count(*) filter (vec_id % 7 in (0, 5, 6)) as candidates from embeddings")
def vector_candidates(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.search_counts(_spoilt(spark, d), "embedding", 64)


@query(f"""with s as (select v.vec_id, {_SCORE["cosine"]} as score from embeddings v, (select embedding from embeddings where vec_id = 0) q where v.vec_id % 7 in (0, 5, 6))
select vec_id, round(score::double, 6) as score from s order by score desc, vec_id limit 10""")
def vector_topk_spoilt(spark: SparkSession, d: str) -> DataFrame:
    q = _query_vectors(spark, d, 1)[0]
    top = vector_search.exact_top_k(_spoilt(spark, d), "embedding", q, 10, [F.col("vec_id")])
    return top.select("vec_id", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(f"""with s as (select v.vec_id, {_SCORE["cosine"]} as score from embeddings v, (select embedding from embeddings where vec_id = 0) q)
select vec_id, round(score::double, 6) as score from s order by score desc, vec_id limit 10""")
def vector_topk_accelerated(spark: SparkSession, d: str) -> DataFrame:
    found = vector_search.accelerated_top_k(table(spark, d, "embeddings"), "embedding", "vec_id", _query_vectors(spark, d, 1)[0], 10)
    return found.select("vec_id", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("""with p as (select v.vec_id, list_transform(list_zip(v.embedding::float[], q.embedding::float[]), lambda z: (z[1] * z[2])::float) as x from embeddings v, (select embedding from embeddings where vec_id = 0) q)
select vec_id, round(list_reduce(x, lambda a, b: (a + b)::float)::double, 4) as score from p""")
def vector_dot_f32(spark: SparkSession, d: str) -> DataFrame:
    q = _query_vectors(spark, d, 1)[0]
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.dot_f32("embedding", q).cast("double"), 4).alias("score"))


@query("""select i as row, list_transform(range(8), lambda c: (((i * 1664525 + c * 1013904223 + 1013904223) % 10000)::float / 10000)::float)::double[] as vector from range(200) t(i)""")
def synthetic_vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(200).select(F.col("id").alias("row"), synthetic.vector(F.col("id"), 8).cast("array<double>").alias("vector"))


@query("select doc_id, octet_length(encode(text)) as size, sha256(text) as sha from documents")
def codec_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text through the adaptive compression and back."""
    back = codec.decoded(codec.encoded(table(spark, d, "documents").filter("text is not null"), "doc_id", "text"))
    return back.select(F.col("key").cast("long").alias("doc_id"), F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha"))


# ---------------------------------------------------------------- current state and scans


@query(LOG + " select user_id, seq, event_id, op, state, tombstone, ts_ms from heads")
def heads_lww(spark: SparkSession, d: str) -> DataFrame:
    return records.heads(log(spark, d), KEY, "seq").select("user_id", "seq", "event_id", "op", "state", "tombstone", "ts_ms")


@query(LOG + " select user_id, seq, event_id from (select *, row_number() over (partition by user_id order by seq desc) as q from log where seq <= 100) where q = 1")
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    return records.as_of(log(spark, d), KEY, "seq", 100).select("user_id", "seq", "event_id")


@query(LOG + " select user_id, seq, event_id, op from log where user_id = 7 and seq = (select max(seq) from log where user_id = 7)")
def get_version(spark: SparkSession, d: str) -> DataFrame:
    mine = log(spark, d).filter("shard = 7 and user_id = 7")
    return records.heads(mine, KEY, "seq").select("user_id", "seq", "event_id", "op")


@query(LOG + f" select user_id, seq, expires_ms from heads where not tombstone and expires_ms > {AT}")
def get_live(spark: SparkSession, d: str) -> DataFrame:
    return records.live(records.heads(log(spark, d), KEY, "seq"), AT).select("user_id", "seq", "expires_ms")


@query(LOG + ", k as (select i::bigint as ord, (i * 7 % 200)::bigint as user_id from range(40) t(i)) select k.ord, k.user_id, seq, case when not tombstone then event_type end as value from k left join heads using (user_id)")
def get_batch(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(40).select(F.col("id").alias("ord"), (F.col("id") * 7 % 200).alias("user_id"))
    got = records.get_batch_of(log(spark, d), asked, KEY, "seq")
    return got.select("ord", "user_id", "seq", F.when(~F.col("tombstone"), F.col("event_type")).alias("value"))


@query("select row_number() over (order by c_name) as rank, c_name, c_custkey from customer where starts_with(c_name, 'Customer#00000') order by c_name limit 50")
def scan_prefix(spark: SparkSession, d: str) -> DataFrame:
    got = records.scan(table(spark, d, "customer").select("c_name", "c_custkey"), keys.prefixed("c_name", "Customer#00000"), [F.col("c_name")], 50)
    return got.select(F.row_number().over(Window.orderBy("c_name")).cast("long").alias("rank"), "c_name", "c_custkey")


@query("select row_number() over (order by o_orderkey) as rank, o_orderkey, o_totalprice from orders where o_orderkey between 500 and 5000 order by o_orderkey limit 200")
def scan_range(spark: SparkSession, d: str) -> DataFrame:
    got = records.scan(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey").between(500, 5000), [F.col("o_orderkey")], 200)
    return got.select(F.row_number().over(Window.orderBy("o_orderkey")).cast("long").alias("rank"), "o_orderkey", "o_totalprice")


@query("select p_partkey, p_name from part where p_partkey > 100 order by p_partkey limit 25")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return records.keyset_page(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 100, 25)


@query("select row_number() over (order by octet_length(encode(p_name)), p_name, p_partkey) as rank, p_partkey from part order by octet_length(encode(p_name)), p_name, p_partkey limit 100")
def length_first_order(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "part").select("p_name", "p_partkey").orderBy(*keys.scan_order(("p_name",)), "p_partkey").limit(100)
    return got.select(F.row_number().over(Window.orderBy(*keys.scan_order(("p_name",)), "p_partkey")).cast("long").alias("rank"), "p_partkey")


@query(LOG + """ select count(*) filter (not tombstone) as live, count(*) filter (tombstone) as tombstones, count(*) filter (not tombstone and event_id % 2 = 0) as compressed,
  count(*) filter (not tombstone and event_id % 2 <> 0) as raw, coalesce(sum(octet_length(encode(event_type)) + 8) filter (not tombstone), 0)::bigint as logical_bytes from heads""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("event_type") + 8
    return records.store_stats(records.heads(log(spark, d), KEY, "seq"), size, size, F.col("event_id") % 2 == 0).select("live", "tombstones", "compressed", "raw", F.col("logical_bytes").cast("long"))


@query(LOG + """ select m.user_id, m.kind, h.seq as previous, case when m.kind = 'any' then 'ok' when m.kind = 'missing' then case when h.seq is null then 'ok' else 'conflict' end
  when h.seq = m.expected then 'ok' else 'conflict' end as outcome
from (select i::bigint as user_id, ['any', 'missing', 'exact'][i % 3 + 1] as kind, (i % 400)::bigint as expected from range(400) t(i)) m left join heads h using (user_id)""")
def version_preconditions(spark: SparkSession, d: str) -> DataFrame:
    m = spark.range(400).select(F.col("id").alias("user_id"), F.element_at(F.array(*map(F.lit, ("any", "missing", "exact"))), (F.col("id") % 3 + 1).cast("int")).alias("kind"), (F.col("id") % 400).alias("expected"))
    return records.mutation_outcomes(m, records.heads(log(spark, d), KEY, "seq"), KEY, "seq").select("user_id", "kind", "previous", "outcome")


# ---------------------------------------------------------------- changes


@query(LOG + " select seq, batch_id, user_id, op from log where shard = 3 and seq > 30 order by seq limit 100")
def change_page(spark: SparkSession, d: str) -> DataFrame:
    return changes.page(log(spark, d), 3, 30, 100, aligned=False).select("seq", "batch_id", "user_id", "op")


@query(LOG + ", p as (select *, row_number() over (order by seq) as n from log where shard = 3 and seq > 30) select seq, batch_id, user_id, op from p where n <= 100 or batch_id = (select max(batch_id) from p where n <= 100)")
def change_page_batch_aligned(spark: SparkSession, d: str) -> DataFrame:
    return changes.page(log(spark, d), 3, 30, 100).select("seq", "batch_id", "user_id", "op")


@query(LOG + ", p as (select *, row_number() over (order by seq) as n from log where shard = 3 and seq > 30) select seq, user_id, op, (select max(seq) from p where n <= 100 or batch_id = (select max(batch_id) from p where n <= 100)) as watermark from p where (n <= 100 or batch_id = (select max(batch_id) from p where n <= 100)) and op = 'put'")
def subscribe_changes(spark: SparkSession, d: str) -> DataFrame:
    page = changes.page(log(spark, d), 3, 30, 100)
    return page.withColumn("watermark", F.max("seq").over(Window.partitionBy())).filter("op = 'put'").select("seq", "user_id", "op", "watermark")


@query(LOG + ', l as (select * from log where event_id % 97 <> 0), g as (select shard, lag(seq) over (partition by shard order by seq) as "after", seq as before from l) select shard, "after", before from g where before - "after" > 1')
def change_gaps(spark: SparkSession, d: str) -> DataFrame:
    return changes.gaps(log(spark, d).filter("event_id % 97 <> 0"))


@query(LOG + " select event_id, lag(seq) over (partition by user_id order by seq) as previous, first_value(ts_ms) over (partition by user_id order by seq) as created_ms from log")
def previous_version(spark: SparkSession, d: str) -> DataFrame:
    return changes.with_previous(log(spark, d), KEY, "seq", "ts_ms").select("event_id", "previous", "created_ms")


def _acks(spark: SparkSession, d: str) -> DataFrame:
    latest = log(spark, d).groupBy("shard").agg(F.max("seq").alias("latest"))
    return latest.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("consumer"), "shard", "latest").select("consumer", "shard", F.when(F.col("consumer") == "a", F.col("latest") - 5).otherwise(F.floor(F.col("latest") / 2)).cast("long").alias("watermark"))


_ACKS = ", latest as (select shard, max(seq) as latest from log group by shard), acks as (select 'a' as consumer, shard, latest - 5 as watermark from latest union all select 'b', shard, latest // 2 from latest)"


def _safe(spark: SparkSession, d: str) -> DataFrame:
    acks = _acks(spark, d)
    return changes.safe_watermark(acks.select("consumer", "shard"), acks.filter("not (consumer = 'b' and shard = 5)"))


_SAFE = _ACKS + ", safe as (select shard, min(case when consumer = 'b' and shard = 5 then 0 else watermark end) as watermark from acks group by shard)"


@query(LOG + _SAFE + " select shard, watermark from safe")
def safe_watermark(spark: SparkSession, d: str) -> DataFrame:
    return _safe(spark, d)


@query(LOG + _SAFE + ", ends as (select shard, batch_id, max(seq) as e from log group by all) select l.shard, l.user_id, l.seq, h.seq is not null as is_head from log l join ends using (shard, batch_id) join safe using (shard) left join heads h on h.user_id = l.user_id and h.seq = l.seq where e <= watermark")
def gc_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    return changes.collectable(e, _safe(spark, d), records.heads(e, KEY, "seq"), KEY)


@query(LOG + _ACKS + " select consumer, shard, greatest(latest - watermark, 0) as stale from acks join latest using (shard)")
def consumer_lag(spark: SparkSession, d: str) -> DataFrame:
    return changes.lag(log(spark, d).groupBy("shard").agg(F.max("seq").alias("latest")), _acks(spark, d))


# ---------------------------------------------------------------- TTL, workflow, idempotency


@query(LOG + f" select user_id, seq, expires_ms from heads where not tombstone and expires_ms <= {LATE} order by expires_ms, user_id limit 50")
def ttl_due(spark: SparkSession, d: str) -> DataFrame:
    return workflow.due(records.heads(log(spark, d), KEY, "seq").filter("not tombstone"), LATE, [F.col("user_id")], 50).select("user_id", "seq", "expires_ms")


@query(LOG + f" select l.event_id, l.user_id, case when h.expires_ms = l.expires_ms and not h.tombstone then 'expired' else 'stale' end as outcome from log l left join heads h using (user_id) where l.expires_ms <= {AT}")
def ttl_split_stale(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    due = e.filter(F.col("expires_ms") <= AT).select("event_id", "user_id", "expires_ms")
    return workflow.split_stale(due, records.heads(e, KEY, "seq"), KEY).select("event_id", "user_id", "outcome")


_JOBS = """, jobs as (select user_id, case when state = 'pending' and user_id % 4 = 0 then 'leased' else state end as state, expires_ms as deadline_ms, tombstone,
  (select count(*) from log c where c.user_id = h.user_id and c.event_type = 'click')::bigint as attempts from heads h)"""


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    clicks = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("attempts"))
    state = F.when((F.col("state") == "pending") & (F.col("user_id") % 4 == 0), "leased").otherwise(F.col("state"))
    return records.heads(e, KEY, "seq").join(clicks, "user_id").select("user_id", state.alias("state"), F.col("expires_ms").alias("deadline_ms"), "tombstone", "attempts")


@query(LOG + _JOBS + " select state, count(*) as n, sum(attempts)::bigint as attempts from jobs group by state")
def workflow_state(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query(LOG + _JOBS + f", c as (select user_id, case when state = 'leased' then deadline_ms else 0 end as available_at from jobs where state = 'pending' or (state = 'leased' and {AT} >= deadline_ms + 5000)) select user_id, available_at, row_number() over (order by available_at, user_id) as rank from c order by available_at, user_id limit 40")
def claim_candidates(spark: SparkSession, d: str) -> DataFrame:
    got = workflow.claim_candidates(_jobs(spark, d), AT, [F.col("user_id")], 40)
    return got.select("user_id", "available_at", F.row_number().over(Window.orderBy("available_at", "user_id")).cast("long").alias("rank"))


@query(LOG + _JOBS + " select user_id, attempts, case when attempts >= 5 then 'dead_letter' else 'pending' end as state from jobs where state = 'leased'")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    leased = _jobs(spark, d).filter("state = 'leased'")
    return leased.select("user_id", "attempts", workflow.failed_state(F.col("attempts"), F.lit(False)).alias("state"))


@query("""with r as (select event_id, user_id, event_type, row_number() over w as n, first_value(event_type) over w as f from events window w as (partition by user_id order by event_id))
select event_id, case when n = 1 then 'stored' when event_type = f then 'replay' else 'conflict' end as outcome from r""")
def idempotent_ingest(spark: SparkSession, d: str) -> DataFrame:
    return records.idempotent(table(spark, d, "events").select("event_id", "user_id", "event_type"), KEY, "event_type", "event_id").select("event_id", "outcome")


@query(LOG + f" select l.event_id, case when h.expires_ms = l.expires_ms then 'purged' else 'stale' end as outcome from log l left join heads h using (user_id) where l.expires_ms <= {AT}")
def purge_idempotency(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    return records.purge_expired(records.heads(e, KEY, "seq"), e.select("event_id", "user_id", "expires_ms"), KEY, AT).select("event_id", "outcome")


# ---------------------------------------------------------------- surfaces, placement


@query(LOG + " select user_id, seq, state from heads where not tombstone and state in ('pending')")
def surface_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.rebuild(records.heads(log(spark, d), KEY, "seq"), surfaces.accepts(["pending"])).select("user_id", "seq", "state")


@query(LOG + " select user_id, seq, state from heads where not tombstone and state in ('pending')")
def surface_incremental(spark: SparkSession, d: str) -> DataFrame:
    e, ok = log(spark, d), surfaces.accepts(["pending"])
    first = surfaces.rebuild(records.as_of(e, KEY, "seq", 200), ok)
    return surfaces.fold(first, e.filter("seq > 200"), KEY, "seq", ok).select("user_id", "seq", "state")


@query(LOG + """, s as (select user_id, seq, octet_length(encode('{"user_id":' || user_id || ',"seq":' || seq || '}')) as size from heads where not tombstone and state = 'pending' order by user_id limit 60),
c as (select *, sum(size) over (order by user_id) + count(*) over (order by user_id) + 1 as total from s) select user_id, seq from c where total <= 1000""")
def surface_capped(spark: SparkSession, d: str) -> DataFrame:
    state = surfaces.rebuild(records.heads(log(spark, d), KEY, "seq"), surfaces.accepts(["pending"])).select("user_id", "seq")
    return surfaces.capped(state, [F.col("user_id")], F.octet_length(F.to_json(F.struct("user_id", "seq"))), 60, 1000)


@query(LOG + _SAFE + ", x as (select shard, greatest(latest - coalesce(watermark, 0), 0) as stale from latest left join safe using (shard)) select shard, stale, (select bool_and(stale = 0) from x) as complete from x")
def surface_staleness(spark: SparkSession, d: str) -> DataFrame:
    latest = log(spark, d).groupBy("shard").agg(F.max("seq").alias("latest"))
    out = surfaces.staleness(latest, _safe(spark, d))
    return out.withColumn("complete", F.min(F.col("stale") == 0).over(Window.partitionBy()))


POLICY = placement.Policy(half_life_ms=86_400_000, residency_ms=0)


@query(LOG + f""", f as (select user_id, least(1000, greatest(0, case when {AT} <= ts_ms then 1000 else round(1000.0 * pow(2.0, -(({AT} - ts_ms)::double) / 86400000.0)) end))::int as freshness,
  (event_id % 1001)::int as urgency, user_id % 11 = 0 as pinned, expires_ms <= {AT} as expired from heads where not tombstone),
s as (select *, least(1000, (freshness * 700 + least(urgency, 1000) * 300) // 1000)::int as score from f)
select user_id, freshness, urgency, score, case when expired then 'archive' when pinned then 'hot' when score >= 700 then 'hot' when score <= 350 then 'cold' else 'warm' end as layer,
  case when expired then 9 when pinned or score >= 700 then 1 when score <= 350 then 6 else 3 end as level from s""")
def placement_explain(spark: SparkSession, d: str) -> DataFrame:
    h = records.heads(log(spark, d), KEY, "seq").filter("not tombstone")
    rows = h.select("user_id", placement.freshness(F.col("ts_ms"), AT, POLICY.half_life_ms).alias("freshness"), (F.col("event_id") % 1001).cast("int").alias("urgency"), (F.col("user_id") % 11 == 0).alias("pinned"), (F.col("expires_ms") <= AT).alias("expired"))
    rows = rows.withColumn("score", placement.score(F.col("freshness"), F.col("urgency"), POLICY))
    layer = placement.layer(F.col("score"), F.col("pinned"), F.col("expired"), F.lit("warm"), F.lit(1), POLICY)
    return rows.withColumn("layer", layer).select("user_id", "freshness", "urgency", "score", "layer", placement.tier_level(F.col("layer")).alias("level"))


@query(LOG + " select event_id, (((least(event_id % 5000, 1000000)::bigint * 1000 + user_id % 1000 + 1000 * (user_id % 2 = 0)::int) * 1024) // greatest(event_id % 700, 1))::bigint as priority, ((seq * 13 + 999) // 1000)::bigint as cost_us from log")
def cache_priority(spark: SparkSession, d: str) -> DataFrame:
    z = F.lit(0)
    return log(spark, d).select("event_id", placement.cache_priority(F.col("event_id") % 5000, F.col("user_id") % 1000, F.col("user_id") % 2 == 0, F.col("event_id") % 700).alias("priority"), placement.cost_us(F.col("seq") * 13, z, z, z, z).alias("cost_us"))


# ---------------------------------------------------------------- payloads, import, verification


@query("select doc_id, octet_length(encode(text)) + 128 as size, starts_with(source, 'src1') or starts_with(source, 'src7') as skip from documents")
def size_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", payload.text_bytes(F.col("text")).alias("size"), payload.has_prefix(F.col("source"), ["src1", "src7"]).alias("skip"))


@query("""with m as (select doc_id, ['version_ref', 'delta', 'self_contained'][doc_id % 3 + 1] as mode, case when doc_id % 2 = 0 then lang end as delta, octet_length(encode(text)) as size from documents)
select doc_id, case mode when 'version_ref' then 'version_ref' when 'delta' then case when delta is not null then 'delta' else 'error: delta missing' end
  else case when size <= 4096 then 'self_contained' else 'error: body too large' end end as body from m""")
def retention_body(spark: SparkSession, d: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, ("version_ref", "delta", "self_contained"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", payload.body_kind(mode, F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.octet_length("text"), 4096).alias("body"))


_IMPORTED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey"}


def _export(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.exported({name: (table(spark, d, name), [key]) for name, key in _IMPORTED.items()}, "tpch")


@query(" union all ".join(f"select 'public.{name}' as \"table\", count(*) as n_rows, count(*) as expected from {name}" for name in _IMPORTED))
def jsonl_import_counts(spark: SparkSession, d: str) -> DataFrame:
    found = jsonl.frames(_export(spark, d))
    jsonl.validate(found)
    return jsonl.counts(found)


_IDS = " union all ".join(f"select 'public.{name}' as \"table\", '{key}' as k, {key}::varchar as v from {name}" for name, key in _IMPORTED.items())


@query(f"""with i as ({_IDS}),
h as (select "table", v, sha256(len("table") || ':' || "table" || len(k) || ':' || k || len(v) || ':' || v) as id from i)
select "table", id, (('0x' || substr(id, 1, 2))::int % 16)::int as bucket from h""")
def jsonl_identity(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.imported(jsonl.frames(_export(spark, d))).select("table", "id", "bucket")


@query("select o_custkey as k, 'left' as side from (select o_custkey from orders where o_orderkey % 2 = 0 except all select o_custkey from orders where o_orderkey % 2 = 1) union all select o_custkey, 'right' from (select o_custkey from orders where o_orderkey % 2 = 1 except all select o_custkey from orders where o_orderkey % 2 = 0)")
def inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    half = lambda r: o.filter(F.col("o_orderkey") % 2 == r).select(F.col("o_custkey").alias("k"))
    return records.inventory_diff(half(0), half(1))


@query(LOG + " select user_id, seq from log where event_id % 101 = 0")
def verify_events(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    return verify.events_without_version(e.select("user_id", "seq"), e.filter("event_id % 101 <> 0"), ["user_id", "seq"])


@query(LOG + " select count(*) as events, max(seq) as last, (select count(*) from heads) as heads from log")
def verify_summary(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    return verify.summary(e, records.heads(e, KEY, "seq"))


@query("select event_type, count(*) as n, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95 from events group by 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"))
