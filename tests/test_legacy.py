import threading

import pytest
from pyspark.sql import functions as F

from rillstone.functions import synthetic, vectors
from rillstone.operators import vector_search
from rillstone.schema import Corruption, InvalidArgument, ResourceLimit
from rillstone.sources import jsonl, legacy
from rillstone.sources.files import Files
from rillstone.store import Store

#: Fixed value: a snapshot with one record, sequence 7, key "key", text "hello".
GOLDEN = "4150534e415030314150524622000000a4e6488b070000000000000001030000000e0000006b657901000200060000000268656c6c6f"
VALUES = {"bytes": b"\0\xff", "text": "é" * 300, "i64": -5, "f64": 0.25, "vector": [1.0, -2.5]}


def test_golden_snapshot():
    data = legacy.SNAPSHOT_MAGIC + legacy.frame(7, "key", "text", "hello")
    assert data.hex() == GOLDEN and legacy.records_of(data) == ([(7, "key", "text", "hello")], len(data))


def test_values_and_broken_files():
    for kind, v in VALUES.items():
        assert legacy.opened_value(legacy.stored_value(kind, v)) == (kind, v)
    log = b"".join(legacy.frame(k, f"k{k}", *kv) for k, kv in enumerate(VALUES.items())) + legacy.frame(9, "k0")
    rows, whole = legacy.records_of(log)
    assert whole == len(log) and rows[-1] == (9, "k0", None, None) and [r[3] for r in rows[:-1]] == list(VALUES.values())
    for cut in (1, 11, 20):
        assert legacy.records_of(log[:-cut])[0] == rows[:-1]
        with pytest.raises(Corruption):
            legacy.records_of(legacy.SNAPSHOT_MAGIC + log[:-cut])
    for at in (0, 8, 20):
        with pytest.raises(Corruption):
            legacy.records_of(log[:at] + bytes([log[at] ^ 0x55]) + log[at + 1 :])
    assert legacy.records_of(b"") == ([], 0)


def test_read_export_and_limits(spark, tmp_path):
    files = Files(spark, str(tmp_path / "old"))
    files.replace("a.log", b"".join(legacy.frame(k, f"k{k}", *kv) for k, kv in enumerate(VALUES.items())))
    found = legacy.read_files(spark, f"{files.root}/a.log")
    row = {r["key"]: r for r in legacy.live_export(found, 10).collect()}
    assert bytes(row["k0"]["bytes"]) == b"\0\xff" and row["k4"]["vector"] == [1.0, -2.5] and row["k2"]["i64"] == -5
    with pytest.raises(ResourceLimit):
        legacy.live_export(found, 4)
    with pytest.raises(ResourceLimit):
        legacy.live_export(found, 10, most_bytes=20)
    store = Store(spark, str(tmp_path / "new"), 4)
    assert legacy.import_into(store, found, "t", "n", "c") == 5 and store.verify()["heads"] == 5


def test_one_of_many_writers_publishes(spark, tmp_path):
    files, won = Files(spark, str(tmp_path)), []
    files.create("x/first", b"")
    threads = [threading.Thread(target=lambda k=k: won.append((files.create("x/m", str(k).encode()), k))) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [k for ok, k in won if ok]
    assert len(winners) == 1 and files.read("x/m") == str(winners[0]).encode() and files.names("x") == ["first", "m"]


def test_put_frame_refuses(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    row = ("t", "n", "c", "p", "k", "text", "x", None)
    schema = "tenant string, namespace string, collection string, partition string, key string, kind string, text string, vector array<float>"
    for bad in ([row, row], [(*row[:4], "", *row[5:])], [(*row[:5], "other", "x", None)], [(*row[:5], "vector", None, [1.0, float("nan")])]):
        with pytest.raises(InvalidArgument):
            store.put_frame(spark.createDataFrame(bad, schema))
    assert store.put_frame(spark.createDataFrame([], schema)) == 0 and store.put_frame(spark.createDataFrame([row], schema)) == 1
    store.failed = True
    with pytest.raises(Corruption):
        store.put_frame(spark.createDataFrame([row], schema))


def test_scores_that_floats_cannot_hold(spark):
    df = spark.createDataFrame([(1, [3e38, 3e38]), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [1.0, 2.0])], "id long, v array<float>")
    with pytest.raises(Exception, match="finite"):
        vector_search.exact_top_k(df, "v", [3e38, 3e38], 3, [F.col("id")], "dot").collect()
    assert [r["id"] for r in vector_search.exact_top_k(df, "v", [1.0, 1.0], 3, [F.col("id")]).collect()] == [1, 4]
    assert tuple(vector_search.search_counts(df, "v", 2).first()) == (4, 2)
    got = df.filter("id = 4").select(vectors.cosine_f32("v", [2.0, 1.0])).first()[0]
    assert abs(got - 0.8) < 1e-6


def test_payloads():
    assert synthetic.compressible(3, 90) == (b'{"sensor":"temperature","site":"rome","status":"ok","record":00000003}\n' * 2)[:90]
    a = synthetic.incompressible(0, 20)
    assert len(a) == 20 and a == synthetic.incompressible(0, 40)[:20] != synthetic.incompressible(1, 20)


def test_export_frames_out_of_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    lines = jsonl.exported({"t": (rows, ["id"])}, "db")
    jsonl.validate(jsonl.frames(lines))
    moved = lines.withColumn("n", F.when(F.col("line").contains('"a"'), F.lit("000000|1|")).otherwise(F.col("n")))
    after = lines.withColumn("n", F.when(F.col("line").contains('"a"'), F.lit("000001|3|")).otherwise(F.col("n")))
    for bad in (moved, after, lines.filter("not line like '%complete%'"), lines.withColumn("line", F.replace("line", F.lit('"tables": 1'), F.lit('"tables": 2')))):
        with pytest.raises(Corruption):
            jsonl.validate(jsonl.frames(bad))
