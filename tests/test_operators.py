import pytest
from pyspark.sql import functions as F

from rillstone.functions import keys, payload, placement, vectors
from rillstone.operators import changes, records, surfaces, vector_search
from rillstone.schema import PAYLOAD, ChangeLogGap, Corruption, InvalidArgument, ResourceLimit
from rillstone.sources import jsonl, kvlog
from rillstone.streaming import flows


def test_vector_rules(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("w", [1.0]), ("z", [0.0, 0.0]), ("n", None)], "k string, v array<float>")
    top = vector_search.exact_top_k(rows, "v", [1.0, 0.0], 4, [F.col("k")]).collect()
    assert [(r["k"], r["score"]) for r in top] == [("a", 1.0), ("b", 1.0), ("c", 0.0), ("z", 0.0)]
    for bad in ([], [float("nan")]):
        with pytest.raises(InvalidArgument):
            vector_search.exact_top_k(rows, "v", bad, 1, [])
    with pytest.raises(ResourceLimit):
        vector_search.exact_top_k(rows, "v", [1.0, 0.0], 1, [], max_scan=2)
    wide = [0.5] * 300
    assert vector_search.exact_top_k(spark.createDataFrame([(1, wide)], "k int, v array<float>"), "v", wide, 1, [], "dot").first()["score"] == 75.0
    assert vectors.scores_equivalent([(1, 1.0)], [(1, 1.00001)]) and not vectors.scores_equivalent([(1, 1.0)], [(2, 1.0)])


def test_accelerated_top_k(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = list(rows.filter("vec_id = 3").first()["embedding"])
    for metric in ("dot", "cosine"):
        a = [(r["vec_id"], r["score"]) for r in vector_search.exact_top_k(rows, "embedding", q, 20, [F.col("vec_id")], metric).collect()]
        b = [(r["vec_id"], r["score"]) for r in vector_search.accelerated_top_k(rows, "embedding", "vec_id", q, 20, metric).collect()]
        assert vectors.scores_equivalent(a, b)


def test_orders_differ(spark):
    rows = spark.createDataFrame([(b"b",), (b"aa",), (b"a",)], "key binary")
    assert [bytes(r[0]) for r in rows.orderBy(*keys.scan_order(("key",))).collect()] == [b"a", b"b", b"aa"]
    assert [bytes(r[0]) for r in rows.orderBy(*keys.surface_order(("key",))).collect()] == [b"a", b"aa", b"b"]


def test_payload_checks(spark):
    def p(kind, **v):
        return (dict.fromkeys(f.name for f in PAYLOAD.fields) | {"kind": kind} | v,)

    from pyspark.sql import types as T

    rows = [p("text", text="x"), p("f64", f64=float("inf")), p("vector", vector=[]), p("text", text="x", i64=1), p("blob", blob={"id": bytearray(b"1"), "logical_bytes": 1})]
    got = spark.createDataFrame(rows, T.StructType([T.StructField("payload", PAYLOAD)])).select(payload.payload_problem().alias("e")).collect()
    assert [r["e"] is None for r in got] == [True, False, False, False, True]


def test_placement_policy():
    with pytest.raises(ValueError):
        placement.Policy(freshness_weight=1)
    with pytest.raises(ValueError):
        placement.Policy(promote=1, demote=2)


def test_pages(spark):
    e = spark.createDataFrame([(0, s, s - (s - 1) % 3) for s in range(4, 12)], "shard int, seq long, batch_id long")
    assert [r["seq"] for r in changes.page(e, 0, 6, 1).collect()] == [7, 8, 9]
    with pytest.raises(ChangeLogGap):
        changes.checked_page(e, 0, 0, 5)
    with pytest.raises(InvalidArgument):
        changes.checked_page(e, 0, 7, 5)
    with pytest.raises(InvalidArgument):
        changes.checked_page(e, 0, 0, 5000)


def test_fold_equals_rebuild(spark):
    rows = [(k, s, (s * 7 + k) % 3 == 0, "pending" if s % 2 else "done") for k in range(20) for s in range(1, 9)]
    v = spark.createDataFrame(rows, "k int, seq long, tombstone boolean, state string")
    ok = surfaces.accepts(["pending"])
    state = surfaces.rebuild(records.as_of(v, ["k"], "seq", 3), ok)
    for lo in (3, 5, 7):
        state = surfaces.fold(state, v.filter(f"seq > {lo} and seq <= {lo + 2}"), ["k"], "seq", ok)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, surfaces.rebuild(records.heads(v, ["k"], "seq"), ok).collect()))


def test_jsonl_import(spark, tmp_path):
    lines = ['{"type":"manifest","database":"d","tables":["a","b"]}', '{"type":"table","schema":"s","table":"a","primary_key":["id"],"estimated_rows":2}', '{"type":"row","ctid":"(0,1)","tableoid":"1","row":{"id":12345678901234567890123456}}', '{"type":"row","ctid":"(0,2)","tableoid":"1","row":{"id":2}}', '{"type":"end","rows":2}', '{"type":"table","schema":"s","table":"b","primary_key":[],"estimated_rows":1}', '{"type":"row","ctid":"(0,1)","tableoid":"2","row":{"x":null}}', '{"type":"end","rows":1}', '{"type":"complete","tables":2}']
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    frames = jsonl.read_frames(spark, str(tmp_path / "e.jsonl"))
    jsonl.validate(frames)
    rows = jsonl.imported(frames).collect()
    assert len({r["id"] for r in rows}) == 3 and any("12345678901234567890123456" in r["row"] for r in rows)
    (tmp_path / "bad.jsonl").write_text("\n".join([*lines[:3], *lines[4:]]))
    with pytest.raises(Corruption):
        jsonl.validate(jsonl.read_frames(spark, str(tmp_path / "bad.jsonl")))


def test_kvlog(spark, tmp_path):
    data = kvlog.frame(1, "put", "a", "1") + kvlog.frame(2, "put", "b", "2") + kvlog.frame(3, "delete", "a") + kvlog.frame(4, "put", "c", "3")[:-2]
    (tmp_path / "x.log").write_bytes(data)
    log = kvlog.read_log(spark, str(tmp_path / "x.log"))
    assert [tuple(r) for r in kvlog.live_export(log, 10).collect()] == [("b", "2", 2)]
    assert kvlog.snapshot(log, str(tmp_path / "snap")) == 1
    with pytest.raises(Corruption):
        kvlog.decode(data[:13] + b"!" + data[14:])


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(2).write.parquet(source)
    stream = flows.event_stream(spark, source, events.schema, 1)
    q = flows.idempotent_stream(stream, ["event_id"], within="3650 days").groupBy("event_type").count().writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in events.groupBy("event_type").count().collect()}

    ops = stream.select("event_id", "user_id", F.when(F.col("event_type") == "signup", "append").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "error", "fail").otherwise("complete").alias("op"))
    q = flows.workflow_states(ops).writeStream.outputMode("update").format("memory").queryName("work").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("work").filter("state is not null").count() >= events.select("user_id").distinct().count()

    kind = F.col("event_type")
    rows = stream.select("user_id", F.col("event_id").alias("seq"), (kind == "error").alias("tombstone"), F.when(kind == "purchase", "published").otherwise("pending").alias("state"))
    q = rows.writeStream.foreachBatch(flows.surface_sink(str(tmp_path / "surface"), ["user_id"], "seq", ["pending"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = flows.newest_generation(spark, str(tmp_path / "surface"))
    assert got.count() <= events.select("user_id").distinct().count() and got.filter("tombstone").count() == 0

    q = flows.windowed_counts(stream, "event_type").writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    q = flows.session_counts(stream, "user_id").writeStream.outputMode("append").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").columns == ["window", "event_type", "n", "total"]


def test_without_training_operators():
    """The entry imports when the optional operators are gone."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['rillstone.llm'] = None; import __spark_entry__ as e; assert 'vector_topk_dot' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
