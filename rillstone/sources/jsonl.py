"""Import of a relational export: JSON lines of manifest, table, row, end and complete frames.

    {"type":"manifest","database":d,"tables":[...]}     {"type":"table","schema":s,"table":t,"primary_key":[...],"estimated_rows":n}
    {"type":"row","ctid":c,"tableoid":o,"row":{...}}    {"type":"end","rows":n}       {"type":"complete","tables":n}

Frames are an ordered stream; a row belongs to the table frame before it.  Numbers wider than 64 bits survive because rows
stay JSON text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.records import bounded
from rillstone.schema import Corruption

FRAME_MOST = 17 << 20


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of an export.  A line's number is its file, its split's first byte and its place there, so no global sort is needed."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    digits = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    return frames(lines.select(F.concat_ws("|", "file", digits("start"), digits("at")).alias("n"), F.col("value").alias("line")))


def frames(lines: DataFrame, most_tables: int = 10_000) -> DataFrame:
    """lines(n, line), n of any ordered type -> (n, type, segment, table, primary_key, ctid, tableoid, row, rows, size).

    segment counts the table frames so far.  Table frames are few (at most ``most_tables``), so their numbers are a literal
    of the plan and every row finds its segment by itself.
    """
    get = lambda p: F.get_json_object("line", f"$.{p}")
    typed = lines.select("n", "line", get("type").alias("type"))
    starts = [r["n"] for r in bounded(typed.filter("type = 'table'").select("n"), most_tables).collect()]
    segment = F.size(F.filter(F.array(*[F.lit(n) for n in sorted(starts)]), lambda x: x <= F.col("n"))) if starts else F.lit(0)
    return typed.withColumn("segment", segment).select(
        "n", "type", "segment", F.concat_ws(".", get("schema"), get("table")).alias("table"), F.from_json(get("primary_key"), "array<string>").alias("primary_key"),
        get("ctid").alias("ctid"), get("tableoid").alias("tableoid"), get("row").alias("row"), get("rows").cast("long").alias("rows"), get("tables").alias("tables"), F.octet_length("line").alias("size"),
    )


def exported(tables: dict[str, tuple[DataFrame, list[str]]], database: str, schema: str = "public") -> DataFrame:
    """(n, line): the frames of an export of tables (rows, primary key), in order of n.

    n is the table's number, then 0 for its frame, 1 for a row and 2 for its end, then the row's key as text, so nothing is numbered
    in one task.  ``lines.orderBy("n").select("line").write.text(path)`` makes the file.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    place = lambda k, step: F.concat(F.lit(f"{k:06d}|{step}|"))
    ends = [("000000|0|", json.dumps({"type": "manifest", "database": database, "tables": list(tables)})), ("999999|2|", json.dumps({"type": "complete", "tables": len(tables)}))]
    out = None
    for k, (name, (rows, key)) in enumerate(tables.items(), 1):
        n = rows.count()
        ends.append((f"{k:06d}|0|", json.dumps({"type": "table", "schema": schema, "table": name, "primary_key": key, "estimated_rows": n})))
        ends.append((f"{k:06d}|2|", json.dumps({"type": "end", "rows": n})))
        by = F.concat_ws(",", *[F.lpad(F.col(c).cast("string"), 20, "0") for c in key])
        ctid = F.concat(F.lit("(0,"), F.xxhash64(*key).cast("string"), F.lit(")"))
        line = F.to_json(F.struct(F.lit("row").alias("type"), ctid.alias("ctid"), F.lit(str(16383 + k)).alias("tableoid"), F.struct("*").alias("row")))
        part = rows.select(F.concat(place(k, 1), by).alias("n"), line.alias("line"))
        out = part if out is None else out.union(part)
    return out.union(spark.createDataFrame(ends, "n string, line string"))


def counts(frames_: DataFrame) -> DataFrame:
    """(table, n_rows, expected): rows read and rows that the end frame promised."""
    per = frames_.filter("segment > 0").groupBy("segment").agg(F.max(F.when(F.col("type") == "table", F.col("table"))).alias("table"), F.count_if(F.col("type") == "row").alias("n_rows"), F.max(F.when(F.col("type") == "end", F.col("rows"))).alias("expected"))
    return per.select("table", "n_rows", "expected")


def identity(table: Column, primary_key: Column, row: Column, tableoid: Column, ctid: Column) -> Column:
    """sha2 of length-prefixed parts: table and key columns with their raw JSON values, or (tableoid, ctid) without a key."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    fields = F.from_json(row, "map<string,string>")
    keyed = F.aggregate(primary_key, part(table), lambda acc, k: F.concat(acc, part(k), part(F.coalesce(F.element_at(fields, k), F.lit("null")))))
    physical = F.concat(part(table), part(tableoid), part(ctid))
    return F.sha2(F.when(F.size(primary_key) > 0, keyed).otherwise(physical), 256)


def bucket(identity_: Column, buckets: int = 16) -> Column:
    return F.pmod(F.conv(F.substring(identity_, 1, 2), 16, 10).cast("int"), F.lit(buckets)).cast("int")


def imported(frames_: DataFrame) -> DataFrame:
    """(table, id, bucket, row): rows of the export with their identity."""
    tables = frames_.filter("type = 'table'").select("segment", F.col("table").alias("_table"), F.col("primary_key").alias("_pk"))
    rows = frames_.filter("type = 'row'").select("segment", "row", "tableoid", "ctid").join(tables, "segment")
    out = rows.withColumn("id", identity(F.col("_table"), F.col("_pk"), F.col("row"), F.coalesce("tableoid", F.lit("")), F.coalesce("ctid", F.lit(""))))
    return out.select(F.col("_table").alias("table"), "id", bucket(F.col("id")).alias("bucket"), "row")


def validate(frames_: DataFrame) -> None:
    """Raise Corruption unless the stream is complete and every count holds."""
    problem = frames_.agg(F.count_if(F.col("type") == "manifest").alias("m"), F.count_if(F.col("type") == "complete").alias("c"), F.count_if(F.col("type").isNull() | ~F.col("type").isin("manifest", "table", "row", "end", "complete")).alias("bad"), F.max("size").alias("size")).first()
    if problem["m"] != 1 or problem["c"] != 1:
        raise Corruption("an export has one manifest and one complete frame")
    if problem["bad"]:
        raise Corruption("unknown frame")
    if problem["size"] > FRAME_MOST:
        raise Corruption("frame too large")
    order = frames_.agg(
        F.min_by("type", "n").alias("first"), F.max_by("type", "n").alias("last"), F.count_if((F.col("type") == "row") & (F.col("segment") == 0)).alias("loose"),
        F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type") == "end").alias("ends"), F.max(F.when(F.col("type") == "complete", F.col("tables").cast("long"))).alias("said"),
    ).first()
    if (order["first"], order["last"]) != ("manifest", "complete") or order["loose"]:
        raise Corruption("frames are out of order")
    if not order["tables"] == order["ends"] == order["said"]:
        raise Corruption("the numbers of table, end and complete frames differ")
    late = frames_.groupBy("segment").agg(F.max(F.when(F.col("type") == "row", F.col("n"))).alias("row"), F.min(F.when(F.col("type") == "end", F.col("n"))).alias("end"))
    if not late.filter("row > end").isEmpty():
        raise Corruption("a row after its table's end")
    if not counts(frames_).filter(F.col("expected").isNull() | (F.col("expected") != F.col("n_rows"))).isEmpty():
        raise Corruption("a table's rows differ from its end frame")
