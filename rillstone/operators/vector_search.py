"""Exact top-k over one collection of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.vectors import cosine, dot, has_width, is_candidate, query_problem, squared_length
from rillstone.operators.records import bounded
from rillstone.schema import InvalidArgument

METRICS = {"dot": dot, "cosine": cosine}


def exact_top_k(rows: DataFrame, vector: str, query: list[float], k: int, tie: list[Column], metric: str = "cosine", max_scan: int | None = None) -> DataFrame:
    """The k rows with the highest score, ties by ``tie``; rows that aren't vectors of the query's width are skipped.

    One pass without shuffle but for the k rows of each task.
    """
    if problem := query_problem(query):
        raise InvalidArgument(problem)
    if k <= 0:
        raise InvalidArgument("limit must be positive")
    if max_scan is not None:
        rows = bounded(rows, max_scan)
    scored = rows.filter(has_width(vector, len(query))).withColumn("score", METRICS[metric](vector, query))
    return scored.orderBy(F.desc_nulls_last("score"), *tie).limit(k).filter("score is not null")  # no score: no candidate


def search_counts(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """(scanned, candidates): rows a search reads, and those of them that it scores."""
    return rows.agg(F.count("*").alias("scanned"), F.count_if(is_candidate(vector, width)).alias("candidates"))


def accelerated_top_k(rows: DataFrame, vector: str, key: str, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(key, score) as ``exact_top_k`` with ties by key, scored as matrices of Arrow batches; k rows leave each batch.

    The doubles are added in another order, so scores may differ from ``exact_top_k`` in the last place of a float.
    """
    if problem := query_problem(query):
        raise InvalidArgument(problem)
    if k <= 0:
        raise InvalidArgument("limit must be positive")
    width = len(query)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        q = np.array(query, np.float64)
        for b in batches:
            m = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
            fine = np.isfinite(m).all(1)  # a null has become NaN
            m = m[fine]
            s = m @ q
            if metric == "cosine":
                below = (m * m).sum(1) * (q @ q)
                s = np.where(below > 0, s / np.sqrt(np.where(below > 0, below, 1)), 0.0)
            keys, s = b.column(0).to_numpy(zero_copy_only=False)[fine], s.astype(np.float32)
            if not np.isfinite(s).all():
                raise ValueError("a score is no finite float")
            top = np.lexsort((keys, -s))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(keys[top]), pa.array(s[top])], ["key", "score"])

    found = rows.filter(has_width(vector, width)).select(F.col(key).cast("long").alias("key"), vector).mapInArrow(run, "key long, score float")
    return found.orderBy(F.desc("score"), "key").limit(k).select(F.col("key").alias(key), "score")


def multi_top_k(rows: DataFrame, vector: str, queries: dict[int, list[float]], k: int, tie: str, metric: str = "cosine") -> DataFrame:
    """(query_id, rank, tie, score) for a bounded list of queries of one width in a single scan.

    The queries are literals of the plan (a request, not a table), and each task keeps k rows for each query.
    """
    width = {len(q) for q in queries.values()}
    if len(width) != 1:
        raise InvalidArgument("queries of one request have one width")
    n = width.pop()
    scores = F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), METRICS[metric](vector, q, F.col("_norm")).alias("score")) for i, q in queries.items()])
    normed = rows.filter(has_width(vector, n)).select(tie, vector, squared_length(vector, n).alias("_norm"))  # once for all queries
    scored = normed.select(tie, F.explode(scores).alias("s")).select("s.query_id", tie, "s.score")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & F.col("score").isNotNull())
