"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

1. Map.  The rolling hash of each window (a polynomial over the words' 64-bit hashes modulo 2**64) is computed for a
   whole chunk of documents at once.  Inside the chunk only the earliest window of each hash goes on; the later ones
   are repeats already.  So a window that a third of all rows share leaves a chunk once.
2. Shuffle.  Windows travel in blobs, one for each (chunk, bucket): 8 bytes of hash and about 2 bytes of place.
   The bucket comes from a second, independent hash, so windows are held equal on 64 bits and the bucket's bits.
3. Count.  A bucket's task sorts its hashes and returns every window which has an earlier equal.
4. Merge.  A document's repeated windows become maximal intervals of words, and the document is cut.

With B buckets and n windows about n**2 / (B * 2**65) pairs of different windows are taken for equal: 2e-5 at 1e8
windows.  ``wide`` adds the second hash to what is compared (126 bits and more; 8 further bytes a window) for corpora of
over 1e11 windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import batches, buckets_for, mixed, word_hashes

WINDOW = 20
_MULTIPLIERS = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F)


def window_hashes(hashes: np.ndarray, window: int, multiplier: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each run of ``window`` values, by doubling: O(n log window) array steps."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    parts, length, power = hashes, 1, np.uint64(multiplier)
    out, done = np.zeros(n, np.uint64), 0
    left = window
    while left:
        if left & 1:  # append the run of this length that starts at ``done``
            out = out * power + parts[done : done + n]
            done += length
        left >>= 1
        if left:
            parts = parts[:-length] * power + parts[length:]
            length, power = 2 * length, power * power
    return mixed(out)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _chunk_rows(ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray, window: int, buckets: int, wide: bool):
    """(bucket, kind, doc places, window starts, hashes) rows of one chunk; kind 0: to compare, 1: known repeats."""
    ends = np.cumsum(counts)
    total = len(hashes)
    if total < window:
        return
    doc_of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    inside = doc_of[: total - window + 1] == doc_of[window - 1 :]
    at = np.flatnonzero(inside).astype(np.int32)
    if not len(at):
        return
    first = window_hashes(hashes, window, _MULTIPLIERS[0])[at]
    second = window_hashes(hashes, window, _MULTIPLIERS[1])[at]
    doc, start = doc_of[at], at - (ends - counts)[doc_of[at]].astype(np.int32)
    place = np.unique(ids, return_inverse=True)[1]  # documents in order of id; rows that repeat an id share a place
    order = np.argsort(first, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = first[order[1:]] == first[order[:-1]]
    repeat = np.zeros(len(order), bool)
    if same.any():
        bounds = np.flatnonzero(~same)
        rows = np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, len(order))))
        key = place[doc[order]].astype(np.int64) << 32 | start[order]
        repeat[order] = key > np.minimum.reduceat(key, bounds)[rows]
        # windows that agree on the first hash alone are compared on the second in the bucket
        odd = second[order] != second[order[bounds]][rows]
        if odd.any():
            bad = np.isin(rows, rows[odd])
            repeat[order[bad]] = False
    bucket = (second % np.uint64(buckets)).astype(np.int32)
    for kind, chosen in ((0, np.flatnonzero(~repeat)), (1, np.flatnonzero(repeat))):
        if not len(chosen):
            continue
        b = bucket[chosen] if kind == 0 else (ids[doc[chosen]] % buckets).astype(np.int32)
        chosen = chosen[np.argsort(b, kind="stable")]
        b = np.sort(b, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        for i, j in zip(cut, np.append(cut[1:], len(b)), strict=True):
            mine = chosen[i:j]
            heads = np.flatnonzero(np.concatenate(([True], doc[mine][1:] != doc[mine][:-1])))
            blob = b""
            if kind == 0:
                blob = first[mine].tobytes() + (second[mine].tobytes() if wide else b"")
            steps = np.diff(start[mine], prepend=np.int32(0)).astype(np.int32)
            yield int(b[i]), kind, _packed(np.diff(ids[doc[mine][heads]], prepend=np.int64(0))), _packed(np.diff(np.append(heads, j - i)).astype(np.int32)), _packed(steps), blob


def repeated_windows(docs: DataFrame, window: int = WINDOW, buckets: int | None = None, wide: bool = False, chunk_words: int = 1_500_000) -> DataFrame:
    """(doc_id, starts binary): zstd int32 starts of windows with an earlier equal (smaller doc_id, or earlier start).

    Several rows may name one document.  Documents with a null id count as the smallest id.  Rows that repeat a doc_id
    share its places: their equal windows at equal starts are one.
    """
    buckets = buckets or buckets_for(docs)

    def spread(rows: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["bucket", "kind", "ids", "counts", "starts", "hashes"]
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        words = 0

        def flush():
            ids, hashes, counts = (np.concatenate([h[k] for h in held]) for k in range(3))
            out = list(_chunk_rows(ids, hashes, counts, window, buckets, wide))
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64], strict=True), kinds, strict=True)], names)

        for ids, texts in batches(rows, most=1 << 20):
            hashes, counts = word_hashes([t or b"" for t in texts])
            low = np.iinfo(np.int64).min
            held.append((np.array([low if i is None else i for i in ids], np.int64), hashes, counts))
            words += len(hashes)
            if words >= chunk_words:
                yield from flush()
                held, words = [], 0
        if held:
            yield from flush()

    def count(key, table):
        import pyarrow as pa

        ids, starts, first, second = [], [], [], []
        known_ids, known_starts = [], []
        for kind, i, c, s, h in zip(*(table.column(n).to_pylist() for n in ("kind", "ids", "counts", "starts", "hashes")), strict=True):
            c = _unpacked(c, np.int32)
            who, where = np.repeat(np.cumsum(_unpacked(i, np.int64)), c), np.cumsum(_unpacked(s, np.int32), dtype=np.int32)
            if kind:
                known_ids.append(who)
                known_starts.append(where)
            else:
                h = np.frombuffer(h, np.uint64)
                ids.append(who)
                starts.append(where)
                first.append(h[: len(where)])
                second.append(h[len(where) :])
        if ids:
            who, where, h = np.concatenate(ids), np.concatenate(starts), np.concatenate(first)
            del ids, starts, first
            order = np.lexsort((np.concatenate(second), h)) if wide else np.argsort(h, kind="stable")
            h = h[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            if wide:
                g = np.concatenate(second)[order]
                new[1:] |= g[1:] != g[:-1]
            bounds = np.flatnonzero(new)
            many = np.flatnonzero(np.diff(np.append(bounds, len(h))) > 1)
            inside = np.zeros(len(h), bool)
            group = np.cumsum(new) - 1
            inside[np.isin(group, many, assume_unique=False)] = True
            picked = order[inside]
            rows = group[inside]
            who, where = who[picked], where[picked]
            best = np.lexsort((where, who, rows))
            who, where, rows = who[best], where[best], rows[best]
            lead = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.empty(0, np.int64)
            leader = np.repeat(lead, np.diff(np.append(lead, len(rows))))
            later = (who != who[leader]) | (where != where[leader])
            known_ids.append(who[later])
            known_starts.append(where[later])
        who = np.concatenate(known_ids) if known_ids else np.empty(0, np.int64)
        where = np.concatenate(known_starts) if known_starts else np.empty(0, np.int32)
        order = np.lexsort((where, who))
        who, where = who[order], where[order]
        cut = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.empty(0, np.int64)
        blobs = [where[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(who)), strict=False)]
        return pa.table({"doc_id": pa.array(who[cut], pa.int64()), "starts": pa.array(blobs, pa.binary())})

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spread_out = picked.mapInArrow(spread, "bucket int, kind int, ids binary, counts binary, starts binary, hashes binary")
    return spread_out.groupBy("bucket").applyInArrow(count, "doc_id long, starts binary")


def covered(starts: np.ndarray, n_words: int, window: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(mask of words that the windows cover, the maximal intervals)."""
    mask = np.zeros(n_words + 1, np.int32)
    starts = np.unique(starts)
    starts = starts[starts + window <= n_words]
    np.add.at(mask, starts, 1)
    np.add.at(mask, starts + window, -1)
    on = np.cumsum(mask)[:n_words] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
    return on, list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text binary): texts under zstd, null for null and empty ones; less to shuffle than what Spark's codec makes."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        pack = zstandard.ZstdCompressor(level=1).compress
        for ids, texts in batches(rows):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([pack(t) if t else None for t in texts], pa.binary())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text binary")


def removed(docs: DataFrame, window: int = WINDOW, buckets: int | None = None, wide: bool = False) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_sha256, spans): one row for each row of docs.

    text is the kept words joined by one blank, spans the maximal removed intervals of word numbers [from, to).  A null
    or blank text has no words and the digest of the empty text.
    """
    found = repeated_windows(docs, window, buckets, wide)
    gathered = found.groupBy("doc_id").agg(F.collect_list("starts").alias("starts"))
    low = -(1 << 63)
    texts = packed_texts(docs)
    joined = texts.withColumn("_key", F.coalesce("doc_id", F.lit(low))).join(gathered.withColumnRenamed("doc_id", "_key"), "_key", "left").select("doc_id", "text", "starts")

    def cut(rows: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "text", "n_words", "n_removed", "kept_sha256", "spans"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
        unpack = zstandard.ZstdDecompressor().decompress
        for ids, texts, starts in batches(rows, 3, most=1 << 20):
            out = []
            for key, text, places in zip(ids, texts, starts, strict=True):
                words = unpack(text).split() if text else []
                n, gone, spans = len(words), 0, []
                if places:
                    on, spans = covered(np.concatenate([np.frombuffer(p, np.int32) for p in places]), n, window)
                    gone = int(on.sum())
                    words = [w for w, x in zip(words, on.tolist(), strict=True) if not x]
                kept = b" ".join(words)
                out.append((key, kept, n, gone, hashlib.sha256(kept).hexdigest(), [{"from": a, "to": b} for a, b in spans]))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if n != "text" else pa.array(c, pa.binary()).cast(pa.string()) for c, t, n in zip(columns, kinds, names, strict=True)], names)

    return joined.mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string, spans array<struct<`from`:bigint,`to`:bigint>>")
