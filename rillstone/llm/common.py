"""Shared plumbing of the training-data operators: shared folder, tables written there, word arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words everywhere in this package: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rillstone-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    ``by``: a column whose values get a folder each, so that a filter on it reads no others.  The folder stays until ``drop`` or until the shared folder is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillstone-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._rillstone_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``written`` made."""
    path = getattr(df, "_rillstone_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def id_crc32(doc_id: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def plan_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan; used for numbers of buckets only, never for results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int = 4 << 20, least: int = 64, most: int = 1 << 20) -> int:
    return int(min(most, max(least, -(-plan_bytes(df) // bytes_each))))


# ---------------------------------------------------------------- words as arrays

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser; its two multipliers are fixed public values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Longer words take XXH3: from 1,024 bytes on, a polynomial modulo 2**64 has equal values for some different words at every base.
SHORT_WORD = 64


def word_hashes(texts: list[bytes], at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts in order, number of words of each text).

    The hash of a word of at most ``SHORT_WORD`` bytes is a polynomial over its bytes with an odd base modulo 2**64, mixed;
    it comes from prefix sums over the joined bytes, so there is no Python object for a word.  A longer word's is its
    XXH3.  About ``at_once`` bytes are joined at a time, which keeps the arrays in the processor's cache.
    """
    parts, start, total = [], 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= at_once or i == len(texts) - 1:
            parts.append(_word_hashes(texts[start : i + 1]))
            start, total = i + 1, 0
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _grown(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts])
    for k in np.flatnonzero(ends - starts > SHORT_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def batches(iterator, columns: int = 2, text: int = 1, most: int = 4 << 20):
    """Arrow batches cut into lists of rows with at most about ``most`` text bytes (one longer text stays whole).

    Yields ``columns`` lists; the text column as UTF-8 bytes, null as None.
    """
    import pyarrow as pa

    for batch in iterator:
        texts = batch.column(text).cast(pa.binary()).to_pylist()
        others = [None if k == text else batch.column(k).to_pylist() for k in range(columns)]
        start = total = 0
        for i, t in enumerate(texts):
            total += len(t) if t is not None else 0
            if total >= most or i == len(texts) - 1:
                yield [texts[start : i + 1] if k == text else others[k][start : i + 1] for k in range(columns)]
                start, total = i + 1, 0


def about(df: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """About ``most`` of df's ``total`` rows (all, if fewer), chosen by a hash of ``key``: a filter, so nothing is sorted or sent."""
    if total <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(most / total * (1 << 30)))
