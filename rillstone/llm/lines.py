"""Line dedup by content-defined chunks of lines.

Lines are those that aren't blank; a blank line goes or stays with the line above it.  A rolling hash over the last
``WINDOW`` line hashes ends a chunk unless it is 0 modulo ``DIVISOR``, so boundaries depend on nearby lines only and return
to step after an insertion.  A chunk reaches back to the boundary before it and has at least ``WINDOW`` lines, so that its
end is decided by its own lines.  Chunks and their tails of at least ``WINDOW`` lines meet by hash; inside a hash they are
compared byte for byte, the earliest (smallest doc_id, then smallest place) stays and the others go: of each chunk its
longest tail that has an earlier equal.  All are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.llm.common import batches, buckets_for, mixed

WINDOW = 2
DIVISOR = 4
#: A chunk without a boundary for this many lines (mostly one line repeated) ends there.
LONGEST = 8
_LOW = -(1 << 63)


def chunk_bounds(lines: list[bytes], window: int = WINDOW, divisor: int = DIVISOR, longest: int = LONGEST) -> list[tuple[int, int]]:
    """The content-defined chunks [from, to) of a document's lines; neighbours share lines where boundaries stand closer than ``window``."""
    import xxhash

    n = len(lines)
    if n < window:
        return []
    h = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)
    rolling = np.zeros(n, np.uint64)
    for back in range(window):
        rolling[back:] = rolling[back:] + mixed(h[: n - back] + np.uint64(back + 1))
    own = (np.flatnonzero(mixed(rolling)[window - 1 :] % np.uint64(divisor) != 0) + window).tolist()
    out, before = [], 0
    for end in own if own and own[-1] == n else [*own, n]:
        while end - before > longest:
            out.append((before, before + longest))
            before += longest
        out.append((max(0, min(before, end - window)), end))
        before = end
    return out


def _lines(text: bytes | None) -> list[bytes]:
    return [x for x in text.split(b"\n") if x.strip()] if text else []


def _digest(body: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(body) - (1 << 63)


def _pack(values: list[int] | list[bytes]) -> bytes:
    raw = b"".join(values) if isinstance(values[0], bytes) else np.array(values, np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def repeated_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, buckets: int | None = None, together: int = 24 << 20, most: int = 1 << 18) -> DataFrame:
    """(doc_id, found binary): int64 triples (end line, lines, hash of the bytes) of chunks and tails that have an earlier equal.

    Rows that repeat a doc_id share its places; the hash tells their texts apart.  A chunk that many documents share
    leaves a batch of about ``together`` text bytes once, and its bucket's task reads these as a stream: it holds each
    different chunk once and about ``most`` results.
    """
    buckets = buckets or buckets_for(docs)

    def spread(rows: Iterator) -> Iterator:
        names, kinds = ["bucket", "kind", "ids", "ends", "sizes", "bodies"], [pa.int32(), pa.int32()] + [pa.binary()] * 4
        seen: dict[bytes, list[tuple[int, int]]] = {}
        size = 0

        def flush():
            out: dict[tuple[int, int], list] = {}
            for body, places in seen.items():
                first, mark = min(places), _digest(body)
                out.setdefault((mark % buckets, 0), []).append((*first, len(body), body))
                for p in places:
                    if p != first:
                        out.setdefault((p[0] % buckets, 1), []).append((*p, body.count(b"\n") + 1, mark))
            made = [(b, kind, *(_pack(list(x)) for x in zip(*v, strict=True))) for (b, kind), v in out.items()]
            for k in range(0, len(made), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[k : k + 64], strict=True), kinds, strict=True)], names)

        for ids, texts in batches(rows):
            for key, text in zip(ids, texts, strict=True):
                lines = _lines(text)
                for a, b in chunk_bounds(lines, window, divisor):
                    for start in range(a, b - window + 1):
                        body = b"\n".join(lines[start:b])
                        seen.setdefault(body, []).append((_LOW if key is None else key, b))
                        size += len(body)
            if size >= together:
                yield from flush()
                seen, size = {}, 0
        yield from flush()

    def compare(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int]] = {}  # a dict compares the bytes themselves
        gone: dict[int, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(gone), pa.int64()), pa.array([np.array(v, np.int64).tobytes() for v in gone.values()], pa.binary())], ["doc_id", "found"])

        held = 0
        for batch in arrived:
            for kind, ids, ends, sizes, bodies in zip(*(batch.column(n).to_pylist() for n in ("kind", "ids", "ends", "sizes", "bodies")), strict=True):
                ids, ends, sizes = (np.frombuffer(_unpack(x), np.int64).tolist() for x in (ids, ends, sizes))
                raw, at = _unpack(bodies), 0
                if kind:
                    for i, e, n, mark in zip(ids, ends, sizes, np.frombuffer(raw, np.int64).tolist(), strict=True):
                        gone.setdefault(i, []).extend((e, n, mark))
                    held += len(ids)
                else:
                    for place, n in zip(zip(ids, ends, strict=True), sizes, strict=True):
                        body = raw[at : at + n]
                        at += n
                        known = first.setdefault(body, place)
                        if known != place:
                            if place < known:
                                first[body] = place
                            i, e = max(known, place)
                            gone.setdefault(i, []).extend((e, body.count(b"\n") + 1, _digest(body)))
                            held += 1
                if held >= most:
                    yield out()
                    gone, held = {}, 0
        yield out()

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(spread, "bucket int, kind int, ids binary, ends binary, sizes binary, bodies binary").groupBy("bucket").applyInArrow(compare, "doc_id long, found binary")


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    """The text without its gone lines; a blank line shares the fate of the line above it."""
    out, at, away = [], 0, False
    for line in text.split(b"\n"):
        if line.strip():
            away = bool(gone[at])
            at += 1
        if not away:
            out.append(line)
    return b"\n".join(out)


def _cut(docs: DataFrame, report: bool, window: int, divisor: int, buckets: int | None) -> DataFrame:
    names = docs.columns
    found = repeated_chunks(docs, window, divisor, buckets).groupBy("doc_id").agg(F.collect_list("found").alias("found"))
    # docs' columns travel as one value, so their names can't clash; the rows below are read by place
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = own.join(found, own["key"] == found["doc_id"], "left").select(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(names)], found["found"])
    fields = [T.StructField(c.name, T.StringType() if c.name == "text" else c.dataType) for c in docs.schema.fields]
    counts = [T.StructField(n, T.LongType()) for n in ("n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks")] if report else []
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(rows: Iterator) -> Iterator:
        for batch in rows:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            marks = batch.column(len(names)).to_pylist()
            totals, changed = [], []
            for k, (text, found) in enumerate(zip(texts, marks, strict=True)):
                if not report and not found:
                    continue
                lines = _lines(text)
                gone, ends = np.zeros(len(lines), bool), set()
                for e, n, mark in (t for x in found or () for t in np.frombuffer(x, np.int64).reshape(-1, 3).tolist()):
                    if n <= e <= len(lines) and _digest(b"\n".join(lines[e - n : e])) == mark:
                        gone[e - n : e] = True
                        ends.add(e)
                if report:
                    totals.append((len(lines), len(chunk_bounds(lines, window, divisor)), int(gone.sum()), len(ends)))
                if ends:
                    texts[k] = _kept(text, gone)
                    changed.append(k)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.binary()).view(pa.string())
            if length is not None and changed:
                old = columns[length].to_pylist()
                for k in changed:
                    old[k] = len(texts[k].decode(errors="replace"))
                columns[length] = pa.array(old, columns[length].type)
            extra = [pa.array(x, pa.int64()) for x in (zip(*totals, strict=True) if totals else [()] * 4)] if report else []
            yield pa.RecordBatch.from_arrays([*columns, *extra], [*names, *(c.name for c in counts)])

    return joined.mapInArrow(run, T.StructType([*fields, *counts]))


def without_repeats(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, buckets: int | None = None) -> DataFrame:
    """docs with repeated chunks of lines cut from text; every row stays, with docs' columns.

    A null text stays null; a text whose lines all go becomes empty; a text of fewer than ``window`` lines stays.  n_chars, where docs have it as a number, follows
    the new text.  A null doc_id counts as the smallest; bytes that are no UTF-8 stay as they are.
    """
    return _cut(docs, False, window, divisor, buckets)


def line_report(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_chunks, n_removed_lines, n_removed_chunks, kept_sha256): one row for each row of docs.

    Lines are those that aren't blank; n_removed_chunks counts chunks that lose a line.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _cut(base, True, window, divisor, buckets).select("doc_id", "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
