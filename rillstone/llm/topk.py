"""Exact top-k by inner product over norm-sorted blocks.

Vectors become integers floor(scale * x).  Candidates are range-sorted by descending length and cut into blocks, blocks into runs;
queries are cut into blocks too.  With q = (q1, q2) and x = (x1, x2) in an SVD-rotated basis whose first coordinates carry most of
the candidates' energy,

    q.x <= |q| |x|              drops whole blocks and all that follow,
    q.x <= q1.x1 + |q2| |x2|    drops single pairs after a partial sum,

both against the query's current k-th score; survivors get the exact integer product.  Bounds carry a relative margin for
rounding, so nothing that could enter the result is dropped.

Two phases.  All queries meet the run of the longest vectors first; the k-th score there is each query's floor.  Then the
queries are sorted by floor / |q|, the length a vector needs to enter the result, and a block of queries goes to those other runs only
whose longest vector has it.  A task walks one run: its blocks are held, the query blocks stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.common import written

_EXACT = float(1 << 53)
_LOW = -(1 << 63)


def _usable(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, dim, q array<long>) of usable rows: vector and id not null, not empty, all components finite.

    A component whose floor(scale * x) is no 64-bit integer is an error.
    """
    x = F.transform(F.col(f"`{vec_col}`"), lambda v: v.cast("double"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    rows = rows.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    too_large = F.raise_error(F.lit(f"a component times {scale} exceeds 64 bits")).cast("long")
    whole = F.transform("x", lambda v: F.when(F.abs(v * scale) < float(1 << 63), F.floor(v * scale).cast("long")).otherwise(too_large))
    return rows.select("vec_id", F.size("x").alias("dim"), whole.alias("q"))


def _norm(rows: DataFrame) -> DataFrame:
    return rows.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


_BLOB = "dim int, part int, block int, ids binary, floors binary, data binary, place double"


def _blocks(rows: DataFrame, size: int, groups: int) -> DataFrame:
    """Blobs of at most ``size`` rows(vec_id, dim, q, floor, place) of one width, by ascending place: the blob's is its first row's."""
    dealt = rows.repartitionByRange(groups, "place", "vec_id").sortWithinPartitions("dim", "place", "vec_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, dim = TaskContext.get().partitionId(), 0, None
        held: list[tuple[np.ndarray, ...]] = []

        def out(n: int):
            nonlocal number, held
            ids, floors, places, data = (np.concatenate([h[k] for h in held]) for k in range(4))
            held = [(ids[n:], floors[n:], places[n:], data[n:])] if len(ids) > n else []
            number += 1
            blobs = [pa.array([x[:n].tobytes()], pa.binary()) for x in (ids, floors, data)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([number - 1], pa.int32()), *blobs, pa.array([float(places[0])])], ["dim", "part", "block", "ids", "floors", "data", "place"])

        for batch in batches:
            ids, dims, floors, places = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
            cuts = np.flatnonzero(np.concatenate(([True], dims[1:] != dims[:-1]))).tolist() + [len(dims)] if len(dims) else []
            for i, j in zip(cuts, cuts[1:]):
                if held and dim != int(dims[i]):
                    yield out(size)
                dim = int(dims[i])
                held.append((ids[i:j], floors[i:j], places[i:j], _matrix(batch.column(2).slice(i, j - i), dim)))
                while sum(len(h[0]) for h in held) >= size:
                    yield out(size)
        if held:
            yield out(size)

    return dealt.select("vec_id", "dim", "q", "floor", "place").mapInArrow(run, _BLOB)


def rotations(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors of the candidates of each width, from their summed Gram matrices (width x width each)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.frombuffer(data, np.int64).reshape(-1, dim).astype(float)
                sums[dim] = sums.get(dim, 0) + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))], ["dim", "gram"])

    grams = blocks.select("dim", "data").mapInArrow(run, "dim int, gram array<double>")
    cells = grams.select("dim", F.posexplode("gram").alias("cell", "v")).groupBy("dim", "cell").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("cell", "v"))).alias("g")).collect()
    found = {}
    for r in rows:
        gram = np.array([c["v"] for c in r["g"]]).reshape(r["dim"], r["dim"])
        found[r["dim"]] = np.ascontiguousarray(np.linalg.eigh(gram)[1][:, ::-1]) if np.isfinite(gram).all() else np.eye(r["dim"])
    return found


def _products(a: np.ndarray, b: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every partial sum stays under 2**53, in int64 under 2**62, else in Python's integers.

    Pairs that are not ``needed`` may have any value.
    """
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < float(1 << 62):
        return a @ b.T
    whole = np.where(needed, a.astype(object) @ b.T.astype(object), 0)
    if any(not _LOW <= x <= -_LOW - 1 for x in whole.ravel()):
        raise OverflowError("an inner product exceeds 64 bits")
    return whole.astype(np.int64)


class _Best:
    """The k best (score, smallest id) of each query so far; the same id with the same score counts once.  floors: scores that others reach."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None = None) -> None:
        self.k, self.scores, self.ids = k, np.full((n, k), _LOW), np.full((n, k), np.iinfo(np.int64).max)
        self.filled = np.zeros((n, k), bool)
        self.given = np.full(n, _LOW) if floors is None else floors

    def floor(self) -> np.ndarray:
        return np.maximum(np.where(self.filled[:, -1], self.scores[:, -1], _LOW), self.given)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        on = self.filled[q]
        s, i = np.concatenate((self.scores[q][on], scores)), np.concatenate((self.ids[q][on], ids))
        top = np.lexsort((i, -s.astype(float))) if (s == _LOW).any() else np.lexsort((i, -s))
        top = top[np.concatenate(([True], (s[top[1:]] != s[top[:-1]]) | (i[top[1:]] != i[top[:-1]])))][: self.k]
        self.scores[q, : len(top)], self.ids[q, : len(top)], self.filled[q, : len(top)] = s[top], i[top], True


def search_block(queries: np.ndarray, query_ids: np.ndarray, candidates: list[tuple[float, np.ndarray, np.ndarray]], turn: np.ndarray, k: int, head: int | None = None, floors: np.ndarray | None = None) -> tuple[_Best, int]:
    """(the k best of each query, number of exact products) over candidate blocks (top, ids, matrix) by descending top.

    floors: each query's k-th score elsewhere; what lies below needn't be found.
    """
    dim = queries.shape[1]
    head = head or max(1, dim // 4)
    best, verified = _Best(len(queries), k, floors), 0
    q = queries.astype(float) @ turn
    q_norm, q_rest = np.sqrt((q * q).sum(1)), np.sqrt((q[:, head:] ** 2).sum(1))
    for top, ids, m in candidates:
        floor = best.floor()
        live = np.flatnonzero(q_norm * top * (1 + 1e-9) + 1e-6 >= floor)
        if not len(live):
            break  # later blocks are shorter
        x = m.astype(float) @ turn
        rest = np.sqrt((x[:, head:] ** 2).sum(1))
        single = len(np.unique(ids)) == len(ids)  # repeated rows would fill the k places of the cut below
        for start in range(0, len(live), 256):
            rows = live[start : start + 256]
            bound = q[rows, :head] @ x[:, :head].T + q_rest[rows, None] * rest[None, :]
            slack = 1e-9 * q_norm[rows] * top + 1e-6
            ok = bound + slack[:, None] >= floor[rows, None]
            need = np.flatnonzero(ok.any(0))
            if not len(need):
                continue
            verified += int(ok.sum())
            good = ok[:, need] & (ids[need][None, :] != query_ids[rows][:, None])
            scores = _products(queries[rows], m[need], good)
            good &= scores >= floor[rows][:, None]
            for r in np.flatnonzero(good.any(1)):
                at = np.flatnonzero(good[r])
                if single and len(at) > 4 * k:
                    cut = np.partition(scores[r, at], len(at) - k)[len(at) - k]
                    at = at[scores[r, at] >= cut]
                best.add(int(rows[r]), scores[r, at], ids[need][at])
    return best, verified


def _met(queries: DataFrame, runs: DataFrame, turns, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query block in its run.  Both sides: to (the run's number), ids, floors, data, place, dim."""
    columns = ["to", "kind", "dim", "ids", "floors", "data", "place"]
    both = runs.withColumn("kind", F.lit(0)).select(*columns).union(queries.withColumn("kind", F.lit(1)).select(*columns))
    dealt = both.repartition("to").sortWithinPartitions("to", "kind", "place")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                to, kind, dim, ids, floors, data, place = (batch.column(c)[i].as_py() for c in range(7))
                if to != now:
                    now, held = to, []
                ids, m = np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, dim)
                if kind == 0:
                    held.append((-place, ids, m))
                    continue
                best, _ = search_block(m, ids, held, turns.value[dim], k, floors=np.frombuffer(floors, np.int64))
                q, r = np.nonzero(best.filled)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.ids[q, r]), pa.array(best.scores[q, r])], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(met: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.groupBy("query_id", "vec_id", "score").count().withColumn("rank", F.row_number().over(order))


def runs_of(cands: DataFrame, run_blocks: int) -> DataFrame:
    """(dim, part, run, top, first): the runs of candidate blocks, their longest vector, and whether they hold their width's longest."""
    runs = cands.groupBy("dim", "part", F.floor(F.col("block") / run_blocks).cast("int").alias("run")).agg((-F.min("place")).alias("top"))
    longest = runs.groupBy("dim").agg(F.max(F.struct("top", (-F.col("part")).alias("p"), (-F.col("run")).alias("r"))).alias("m"))
    return runs.join(longest, "dim").select("dim", "part", "run", "top", ((F.col("part") == -F.col("m.p")) & (F.col("run") == -F.col("m.r"))).alias("first"))


def top_k(df: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096, run_blocks: int = 8) -> DataFrame:
    """(query_id, rank int from 1, vec_id, score long): each query's k best other vectors, ties to the smaller vec_id.

    ``is_query`` is a column over vec_id.  Null vectors and ids, empty vectors and vectors with a null or non-finite component
    take no part; vectors meet only those of their own width.  Fewer than k others: all of them.  Rows that repeat a query's
    vec_id count as the query's own and are no candidates for it; repeated queries give their result once.
    Rows that repeat a vec_id with the same score take one rank (TOP_K_SQL gives each its own).  Columns
    beside the two named aren't read.  Components or scores beyond 64 bits are an error.
    """
    rows = written(_usable(df, id_col, vec_col, scale), "vectors")
    spark = df.sparkSession
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    normed = _norm(rows).withColumn("floor", F.lit(_LOW))
    cands = written(_blocks(normed.withColumn("place", -F.col("norm")), block, groups), "candidates")
    turns = spark.sparkContext.broadcast(rotations(cands))
    runs = written(runs_of(cands, run_blocks), "runs")  # a row for each run_blocks * block vectors
    asked = _norm(rows.filter(is_query(F.col("vec_id"))).groupBy("vec_id", "dim", "q").count().drop("count")).withColumn("floor", F.lit(_LOW))
    placed = cands.withColumn("run", F.floor(F.col("block") / run_blocks).cast("int")).join(runs, ["dim", "part", "run"])
    # phase 1: each part of the queries gets the longest run
    early = written(_blocks(asked.withColumn("place", F.xxhash64("vec_id").cast("double")), block // 4, max(1, groups // 4)), "queries")
    parts = early.select("dim", F.col("part").alias("q_part")).distinct()
    to = F.concat_ws("-", "dim", "q_part")
    longest = placed.filter("first").join(parts, "dim").withColumn("to", to)
    first = written(_met(early.withColumnRenamed("part", "q_part").withColumn("to", to), longest, turns, k), "first")
    # phase 2: queries by the length they need go to the runs that have it
    floors = _ranked(first).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    known = asked.drop("floor").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(_LOW)))
    needed = F.when((F.col("floor") > _LOW) & (F.col("norm") > 0), (F.col("floor").cast("double") - 1e-6) / (F.col("norm") * (1 + 1e-9))).otherwise(F.lit(float("-inf")))
    late = _blocks(known.withColumn("place", needed), block // 4, groups)
    others = runs.filter("not first").select(F.col("dim").alias("of"), F.col("part").alias("to_part"), F.col("run").alias("to_run"), "top")
    to = F.concat_ws("-", "dim", "to_part", "to_run")
    sent = late.join(others, (F.col("dim") == F.col("of")) & (F.col("top") * (1 + 1e-9) >= F.col("place"))).withColumn("to", to)
    rest = placed.filter("not first").withColumnsRenamed({"part": "to_part", "run": "to_run"}).withColumn("to", to)
    both = first.union(_met(sent, rest, turns, k))
    return _ranked(both).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: DuckDB SQL of op8 over ``embeddings``.
TOP_K_SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from usable a join usable b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0
)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored) where rank <= 5
"""
