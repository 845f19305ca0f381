"""Packing into fixed-length sequences by cutting-stock column generation.

Each document's ids are cut at every ``length`` ids: whole cuts are sequences of their own, and the rest of each document is an item.
Items are counted in a histogram of ``length / grid`` size classes.  A linear program over patterns (how many items of
each class share a sequence) is solved by column generation: the simplex basis gives a price for each class, a
knapsack dynamic program finds the pattern that gains most at those prices, and it enters the basis until none gains.  The
solution is rounded down, the few items left are placed best-fit decreasing, and every pattern's places are dealt to
documents by their rank inside their class.  The program's size depends on ``grid`` alone, not on the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.common import batches, written

LENGTH = 2048
GRID = 8
END = 1

# ---------------------------------------------------------------- tokens

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"


class _Pieces(dict):
    """Ids of a pre-token as little-endian unsigned 32-bit bytes; kept up to ``most`` pre-tokens."""

    def __init__(self, encode, most: int = 300_000) -> None:
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        made = np.array(self.encode(piece), "<u4").tobytes()
        if len(self) < self.most:
            self[piece] = made
        return made


class Tokens:
    """Ids by the byte-level BPE of a vocabulary file, as bytes.

    Texts of common Latin letters, digits and ASCII are cut into pre-tokens by the tokenizer's own pattern and looked
    up; a new pre-token is merged by the same vocabulary's rank file if one is given.  Every other text, and any text with the
    start of a special token, goes through the tokenizer as a whole.  Both ways give the same ids.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None) -> None:
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        encode = lambda piece: self.whole.encode(piece, add_special_tokens=False).ids
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.pieces = _Pieces(encode)
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+").findall
        self.common = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*").fullmatch

    def __call__(self, text: str) -> bytes:
        if not self.common(text) or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---------------------------------------------------------------- the linear program


class Plan(NamedTuple):
    """Patterns (counts by class, from class 1 at index 0) and how often each is used."""

    patterns: np.ndarray
    times: np.ndarray


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack of the classes' prices, by dynamic programming over the room."""
    gain, last = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        gain[w] = gain[w - 1]
        if n := upto[w]:
            total = gain[w - sizes[:n]] + prices[:n]
            k = int(total.argmax())
            if total[k] > gain[w] + 1e-12:
                gain[w], last[w] = total[k], k
    counts, w = np.zeros(len(sizes)), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            counts[last[w]] += 1
            w -= sizes[last[w]]
    return float(gain[room]), counts


def cutting_stock(demand: np.ndarray, room: int, most_rounds: int = 20_000) -> Plan:
    """Patterns that hold exactly ``demand[c]`` items of size c + 1, in close to the fewest sequences of ``room``."""
    classes = np.flatnonzero(demand)
    if not len(classes):
        return Plan(np.zeros((0, len(demand)), np.int64), np.zeros(0, np.int64))
    sizes, want = classes + 1, demand[classes].astype(float)
    want = want + 1e-3 * np.random.default_rng(3).random(len(want))  # breaks ties between pivots, so the basis can't cycle
    basis = np.diag((room // sizes).astype(float))
    inverse, x = np.diag(1 / np.diag(basis)), want / np.diag(basis)
    for _ in range(most_rounds):
        gain, column = best_pattern(inverse.sum(0), sizes, room)
        total = x.sum()
        if gain <= 1 + 1e-9 or total - total / gain < max(0.3, 1e-5 * total):  # total / gain is a bound from below
            break
        held = np.flatnonzero(column)
        d = (inverse[:, held] * column[held]).sum(1)
        ok = d > 1e-9
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * d
        x[out] = step
        np.maximum(x, 0, out=x)
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        basis[:, out] = column
    times = np.floor(x + 1e-6).astype(np.int64)
    patterns = np.rint(basis.T).astype(np.int64)
    left = demand[classes].astype(np.int64) - times @ patterns
    for k in np.flatnonzero(times):  # rounding up by mistake is undone
        while (left < 0).any() and times[k] and (patterns[k][left < 0] > 0).any():
            times[k] -= 1
            left += patterns[k]
    used = times > 0
    patterns, times = list(patterns[used]), list(times[used])
    bins: list[tuple[int, np.ndarray]] = []
    for c in range(len(sizes) - 1, -1, -1):  # what rounding left, best fit by falling size
        for _ in range(int(left[c])):
            free = [(room_left, k) for k, (room_left, _) in enumerate(bins) if room_left >= sizes[c]]
            if free:
                room_left, k = min(free)
            else:
                room_left, k = room, len(bins)
                bins.append((room, np.zeros(len(sizes), np.int64)))
            bins[k][1][c] += 1
            bins[k] = (room_left - int(sizes[c]), bins[k][1])
    patterns += [b for _, b in bins]
    times += [1] * len(bins)
    whole = np.zeros((len(patterns), len(demand)), np.int64)
    whole[:, classes] = np.array(patterns)
    return Plan(whole, np.array(times, np.int64))


class Places:
    """The plan as a lookup: (class, rank inside the class) -> (sequence, slot)."""

    def __init__(self, plan: Plan) -> None:
        bases = np.concatenate(([0], np.cumsum(plan.times)))
        self.sequences = int(bases[-1])
        slots = np.cumsum(plan.patterns, 1) - plan.patterns
        self.of: dict[int, tuple[np.ndarray, ...]] = {}
        for c in np.flatnonzero(plan.patterns.sum(0)):
            p = np.flatnonzero(plan.patterns[:, c])
            each = plan.patterns[p, c]
            self.of[int(c) + 1] = (np.concatenate(([0], np.cumsum(each * plan.times[p])[:-1])), each, bases[p], slots[p, c])

    def __call__(self, c: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, each, bases, slots = self.of[c]
        k = np.searchsorted(starts, rank, "right") - 1
        inside = rank - starts[k]
        return bases[k] + inside // each[k], slots[k] + inside % each[k]


# ---------------------------------------------------------------- Spark


def pieces(docs: DataFrame, length: int = LENGTH, grid: int = GRID, with_ids: bool = False, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, class, part, at[, ids]): the cuts of each row of docs.

    class 0 is a whole cut; ``at`` counts a class's pieces inside a part.  A null text counts as empty: one piece with the end id.
    Bytes that are no UTF-8 become U+FFFD.
    """
    if vocabulary is None:
        vocabulary, ranks = vocabulary_files()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, at long" + ", ids binary" * with_ids

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens, seen = Tokens(vocabulary, ranks), np.zeros(length // grid + 2, np.int64)
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * with_ids
        names = [x.split()[0] for x in schema.split(", ")]
        end = np.array([END], "<u4").tobytes()
        for keys, texts in batches(rows):
            out = []
            for key, text in zip(keys, texts, strict=True):
                ids = memoryview(tokens((text or b"").decode(errors="replace")) + end)
                n = len(ids) // 4
                for start in range(0, n, length):
                    size = min(length, n - start)
                    body = ids[4 * start : 4 * (start + size)]
                    c = 0 if size == length else -(-size // grid)
                    out.append((key, start, size, zlib.crc32(body), n, c, part, int(seen[c]), *([bytes(body)] if with_ids else [])))
                    seen[c] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def packed(docs: DataFrame, length: int = LENGTH, grid: int = GRID, with_ids: bool = False, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): where each piece of each document stands.

    A sequence holds at most ``length`` ids, its offsets are gapless from 0.  ``with_ids`` adds the piece's ids (little-endian
    unsigned 32-bit).  Rows that repeat a document are packed each.  Rank: a part's pieces keep their order, parts follow
    one another; the parts are files of a table in the shared folder, so a lost executor changes no rank.
    """
    if length % grid:
        raise ValueError("grid must divide length")
    spark = docs.sparkSession
    made = written(pieces(docs, length, grid, with_ids, vocabulary, ranks), "pieces")
    sizes = made.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = written(sizes.withColumn("before", before), "ranks")
    demand = np.zeros(length // grid, np.int64)
    for r in offsets.groupBy("class").agg(F.sum("n").alias("n")).filter("class > 0").collect():  # at most length / grid rows
        demand[r["class"] - 1] = r["n"]
    places = Places(cutting_stock(demand, length // grid))
    held = spark.sparkContext.broadcast(places)
    ranked = made.join(offsets.select("class", "part", "before"), ["class", "part"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in rows:
            c, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            sequence, slot = held.value.sequences + rank, np.zeros(len(rank), np.int64)
            for one in np.unique(c[c > 0]):
                mine = c == one
                sequence[mine], slot[mine] = held.value(int(one), rank[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"])

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + "ids binary, " * with_ids + "sequence_id long, slot long"
    placed = ranked.select("class", (F.col("before") + F.col("at")).alias("rank"), *names).mapInArrow(run, kinds)
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
