"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed unigrams, bigrams and one-word skip-grams of its ASCII-lower-cased words.
Training reads labelled rows only, keeps a bounded sample of them (``Settings.most_rows`` and ``most_bytes``), and runs
FTRL-proximal with a learning rate for each coordinate; L1 leaves few non-zero weights, so what is broadcast is bounded
by the table of ``2 ** bits`` floats at most.  Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.llm.common import about, batches, id_crc32, mixed, word_hashes


@dataclass(frozen=True)
class Settings:
    """bits: size of the feature table; alpha, beta, l1, l2: FTRL's; most_rows, most_bytes: bound of the training sample."""

    bits: int = 22
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.5
    epochs: int = 3
    most_rows: int = 12_000
    most_bytes: int = 32 << 20
    threshold: float = 0.3


_SKIP = np.uint64(0xD6E8FEB86659FD93)
_PAIR = np.uint64(0xA0761D6478BD642F)


def features(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Distinct feature numbers of one document's word hashes."""
    down = np.uint64(64 - bits)
    parts = [hashes >> down]
    if len(hashes) > 1:
        parts.append(mixed(hashes[:-1] * _PAIR + hashes[1:]) >> down)
    if len(hashes) > 2:
        parts.append(mixed(hashes[:-2] * _SKIP + hashes[2:] + np.uint64(1)) >> down)
    return np.unique(np.concatenate(parts)).astype(np.int32)


def _documents(texts: list[bytes | None]) -> list[np.ndarray]:
    hashes, counts = word_hashes([(t or b"").lower() for t in texts])
    return np.split(hashes, np.cumsum(counts)[:-1]) if len(texts) else []


class Ftrl:
    """Per-coordinate FTRL-proximal; weight 0 of the extra last coordinate is the bias, which has no L1."""

    def __init__(self, s: Settings) -> None:
        self.s = s
        self.z = np.zeros((1 << s.bits) + 1)
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        s, z, n = self.s, self.z[at], self.n[at]
        return np.where(np.abs(z) > s.l1, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2), 0.0)

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.s.beta + np.sqrt(self.n[-1])) / self.s.alpha + self.s.l2))

    def learn(self, x: np.ndarray, y: int) -> None:
        w, b = self.weights(x), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - y
        for at, old in ((x, w), (-1, b)):
            sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
            self.z[at] += g - sigma * old
            self.n[at] += g * g


def train(rows: list[tuple[bytes | None, int]], s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers with a weight, their weights, bias) from (text, label) rows in the given order."""
    model = Ftrl(s)
    xs = [features(h, s.bits) for k in range(0, len(rows), 64) for h in _documents([t for t, _ in rows[k : k + 64]])]
    for _ in range(s.epochs):
        for x, (_, y) in zip(xs, rows, strict=True):
            model.learn(x, y)
    at = np.flatnonzero(np.abs(model.z[:-1]) > s.l1)
    return at, model.weights(at).astype(np.float32), model.bias()


def _sample(docs: DataFrame, labels: DataFrame, s: Settings, may_learn=None) -> DataFrame | None:
    """(_id, _toxic, t binary), a bounded, reproducible sample of labelled texts, None without any: about ``most_rows`` ids and at most ``most_bytes`` bytes.

    Labels other than 0 and 1 and null ids are left out; ids labelled both ways count as toxic.  The order is by a hash of
    the id, so it depends on neither partitions nor source; a text that doesn't fit any more is skipped.  Of rows that repeat an
    id one counts, chosen by a hash of the text.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter("_toxic in (0, 1) and _id is not null")
    if may_learn is not None:
        marks = marks.filter(may_learn(F.col("_id")))
    marks = marks.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = about(marks, "_id", s.most_rows, marks.count())
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    # chosen has about most_rows ids
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_toxic", F.col("_text").cast("binary").alias("t"), F.xxhash64("_id", F.col("_text").cast("binary")).alias("mark"))
    size = F.coalesce(F.octet_length("t"), F.lit(0))
    sizes = rows.groupBy("_id").agg(F.min(F.struct("mark", size.alias("size"))).alias("m")).select("_id", "m.*").collect()  # one row for each chosen id
    sizes.sort(key=lambda r: (r["mark"], r["_id"]))
    total, fit = 0, []
    for r in sizes:
        if total + r["size"] <= s.most_bytes:
            total += r["size"]
            fit.append((r["_id"], r["mark"]))
    if not fit:
        return None
    wanted = F.broadcast(docs.sparkSession.createDataFrame(fit, "_id long, mark long"))  # about most_rows ids
    return rows.join(wanted, ["_id", "mark"], "left_semi").groupBy("_id", "_toxic").agg(F.min("t").alias("t"))


def _in_order(rows: list[tuple[int, int, bytes | None]]) -> list[tuple[bytes | None, int]]:
    rows.sort(key=lambda r: (hash_order(r[0]), r[2] or b""))
    return [(t, y) for _, y, t in rows]


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings, may_learn=None) -> list[tuple[bytes | None, int]]:
    """The (text, label) rows that the model learns from, in order; see ``_sample``."""
    sample = _sample(docs, labels, s, may_learn)
    return [] if sample is None else _in_order([(r["_id"], r["_toxic"], None if r["t"] is None else bytes(r["t"])) for r in sample.collect()])


def fitted(docs: DataFrame, labels: DataFrame, s: Settings, may_learn=None) -> tuple[np.ndarray, np.ndarray, float] | None:
    """What ``train`` makes of the training rows, None without any.

    One task holds the sample, which ``most_rows`` and ``most_bytes`` bound; only the weights come to the driver.
    """
    sample = _sample(docs, labels, s, may_learn)
    if sample is None:
        return None

    def learn(batches_: Iterator) -> Iterator:
        import pyarrow as pa

        rows = [r for batch in batches_ for r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        if rows:
            at, weights, bias = train(_in_order(rows), s)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int64).tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["places", "weights", "bias"])

    got = sample.select("_id", "_toxic", "t").repartition(1).mapInArrow(learn, "places binary, weights binary, bias double").collect()
    return (np.frombuffer(bytes(got[0]["places"]), np.int64), np.frombuffer(bytes(got[0]["weights"]), np.float32), got[0]["bias"]) if got else None


def hash_order(key: int) -> int:
    return int(mixed(np.array([key], np.int64).view(np.uint64))[0])


def scored(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), may_learn=None) -> DataFrame:
    """docs' own columns and rows, with score double and predicted int appended.

    score is in 0..1, also for null and empty texts (the bias alone).  Without labelled rows every score is 0.5 and
    predicted 1 only if the threshold says so.  Existing columns named score or predicted are replaced.
    """
    return _scored(docs, fitted(docs, labels, s, may_learn) or train([], s), s)


def _probabilities(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], s: Settings):
    """A function from a list of texts to their probabilities, to run in tasks."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    bits = s.bits

    def of(texts: list[bytes | None], table: np.ndarray) -> np.ndarray:
        scores: list[float] = []
        for start in range(0, len(texts), 64):
            scores += [float(table[features(h, bits)].sum(dtype=np.float64)) for h in _documents(texts[start : start + 64])]
        return 1 / (1 + np.exp(-np.clip(np.array(scores, np.float64) + held.value[2], -35, 35)))

    def table() -> np.ndarray:
        out = np.zeros(1 << bits, np.float32)
        out[held.value[0]] = held.value[1]
        return out

    return of, table


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], s: Settings) -> DataFrame:
    of, table = _probabilities(docs, model, s)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema
    out_schema = T.StructType([*schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    text_at = names.index("text")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        weights = table()
        for batch in rows:
            p = of(batch.column(text_at).cast(pa.binary()).to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= s.threshold).astype(np.int32))], [*names, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, out_schema)


def held_out_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns only from ids whose crc32 mod 4 is not 2."""
    out = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels, s, lambda c: id_crc32(c) % 4 != 2)
    return out.select("doc_id", (id_crc32(F.col("doc_id")) % 4 == 2).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Rows of docs that the classifier does not reject, with docs' own columns and values; all, if there is nothing to learn from."""
    typed = docs.withColumn("text", F.col("text").cast("string"))
    model = fitted(typed, labels, s)
    if model is None:
        return typed
    of, table = _probabilities(docs, model, s)
    text_at = docs.columns.index("text")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        weights = table()
        for batch in rows:
            yield batch.filter(pa.array(of(batch.column(text_at).cast(pa.binary()).to_pylist(), weights) < s.threshold))

    return typed.mapInArrow(run, typed.schema)
