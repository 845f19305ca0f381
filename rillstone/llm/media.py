"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every known magic byte string of a value in one pass; a validator of each format then
walks the format's own structure (chunk lengths, checksums, end marks) and confirms or refuses the hit.  Confirmed hits
correct a wrong declared type and are carved: the exact bytes of the embedded file come out, with offset and length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import batches

FRAME = 192
#: Magic byte strings of the formats.
MAGIC = {
    "audio/wav": b"RIFF",
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/gif": b"GIF8",
    "image/jpeg": b"\xff\xd8\xff",
    "image/bmp": b"BM",
    "application/gzip": b"\x1f\x8b\x08",
    "application/zip": b"PK\x03\x04",
    "application/pdf": b"%PDF-",
}


class Found(NamedTuple):
    type: str
    offset: int
    length: int


def _wav(b: bytes, at: int) -> int:
    if len(b) < at + 44 or b[at + 8 : at + 16] != b"WAVEfmt ":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    k, data = at + 12, False
    while k + 8 <= end:
        n = struct.unpack_from("<I", b, k + 4)[0]
        data |= b[k : k + 4] == b"data"
        k += 8 + n + (n & 1)
    return end - at if data and k in (end, end + 1) else 0


def _png(b: bytes, at: int) -> int:
    k, first = at + 8, True
    while k + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, k)
        if k + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(b[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
            return 0
        k, first = k + 12 + n, False
        if kind == b"IEND":
            return k - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 14 or b[at + 4 : at + 6] not in (b"7a", b"9a"):
        return 0
    flags = b[at + 10]
    k = at + 13 + (3 * 2 ** ((flags & 7) + 1) if flags & 0x80 else 0)
    while k < len(b):
        if b[k] == 0x3B:
            return k + 1 - at
        if b[k] == 0x21:
            k += 2
        elif b[k] == 0x2C and k + 10 < len(b):
            f = b[k + 9]
            k += 11 + (3 * 2 ** ((f & 7) + 1) if f & 0x80 else 0)
        else:
            return 0
        while k < len(b) and b[k]:
            k += b[k] + 1
        k += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        kind = b[k + 1]
        if kind == 0xD9:
            return k + 2 - at
        n = struct.unpack_from(">H", b, k + 2)[0]
        if n < 2:
            return 0
        k += 2 + n
        if kind == 0xDA:
            while True:
                k = b.find(b"\xff", k)
                if k < 0 or k + 1 >= len(b):
                    return 0
                if b[k + 1] == 0 or 0xD0 <= b[k + 1] <= 0xD7:
                    k += 2
                    continue
                break
    return k + 2 - at if b[k : k + 2] == b"\xff\xd9" else 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    n, reserved, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if reserved or head < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or start < 14 + head or n < start:
        return 0
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return n if width > 0 and rows and start + rows <= n and at + n <= len(b) else 0


def _gzip(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        rest = b[at:]
        for k in range(0, len(rest), 1 << 16):
            d.decompress(rest[k : k + (1 << 16)])
            if d.eof:
                return min(len(rest), k + (1 << 16)) - len(d.unused_data)
    except zlib.error:
        pass
    return 0


def _zip(b: bytes, at: int) -> int:
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        if at + start + size == end and end + 22 + note <= len(b) and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            return end + 22 + note - at
        end = b.find(b"PK\x05\x06", end + 4)
    return 0


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 6].isdigit() or b.find(b"startxref", at) < 0:
        return 0
    end = b.find(b"%%EOF", b.find(b"startxref", at))
    return end + 5 - at if end >= 0 else 0


_VALID = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/gzip": _gzip, "application/zip": _zip, "application/pdf": _pdf}
_automaton = None


def _searcher():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, magic in MAGIC.items():
            a.add_word(magic.decode("latin-1"), (kind, len(magic)))
        a.make_automaton()
        _automaton = a
    return _automaton


def sniff(data: bytes) -> tuple[list[Found], int]:
    """(outermost valid embedded files in order of offset, number of magic strings seen).

    Hits inside a confirmed file belong to that file and aren't tried again; a hit whose structure does not hold is
    only counted.
    """
    found: list[Found] = []
    hits, reached = 0, 0
    for last, (kind, n) in _searcher().iter(data.decode("latin-1")):
        hits += 1
        at = last - n + 1
        if at >= reached and (length := _VALID[kind](data, at)):
            found.append(Found(kind, at, length))
            reached = at + length
    return found, hits


def detected_type(data: bytes, declared: str | None = None) -> str:
    """The type of the file that starts at byte 0; else the declared type unless a magic type was declared wrongly."""
    found, _ = sniff(data)
    if found and found[0].offset == 0:
        return found[0].type
    return "application/octet-stream" if declared is None or declared in MAGIC else declared


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """Mono PCM of unsigned 8-bit samples, one per byte; an odd payload gets RIFF's pad byte."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVEfmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_samples(data: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    k = 12
    while k + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, k)
        if kind == b"data":
            return data[k + 8 : k + 8 + n]
        k += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def sniff_column(df: DataFrame, id_col: str, data_col: str, declared_col: str) -> DataFrame:
    """One row for each carved file: id, declared_type, detected_type (of the whole value), type, offset, length, data.

    A value without any valid file gives one row with null type, offset, length and data; a null value counts as empty.
    Columns beside the three named are not read, so their names can't clash.
    """
    schema = "id string, declared_type string, detected_type string, type string, offset long, length long, data binary"

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        for batch in rows:
            out: list[tuple] = []
            for key, data, declared in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = data or b""
                found, _ = sniff(data)
                whole = found[0].type if found and found[0].offset == 0 else ("application/octet-stream" if declared is None or declared in MAGIC else declared)
                out += [(key, declared, whole, f.type, f.offset, f.length, data[f.offset : f.offset + f.length]) for f in found] or [(key, declared, whole, None, None, None, None)]
            kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names)

    picked = df.select(F.col(id_col).cast("string").alias("id"), F.col(data_col).cast("binary").alias("data"), F.col(declared_col).cast("string").alias("declared"))
    return picked.mapInArrow(run, schema)


def stored_texts(docs: DataFrame) -> DataFrame:
    """Each document's text stored as 8-bit samples of a WAV file, sniffed and read back.

    Only the file just built is sniffed: its hit at 0 covers the whole value, so magic bytes in the samples are counted and
    neither validated nor carved, and no type is declared.  ``detected_type`` and ``sniff_column`` do that work.
    A null text counts as empty, and an empty text becomes one frame of 192 blanks.  Repeated rows give repeated rows.
    The payload digests are taken from the carved bytes, never from the text.  Reads doc_id and text only.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string"

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]
        for ids, texts in batches(rows):
            out = []
            for key, text in zip(ids, texts, strict=True):
                text = text or b""
                size = max(FRAME, -(-len(text) // FRAME) * FRAME)
                stored = to_wav(text.ljust(size))
                found, hits = sniff(stored)
                if not found or found[0] != ("audio/wav", 0, len(stored)):
                    raise ValueError("a stored value was not recognised")
                media = stored[found[0].offset : found[0].offset + found[0].length]
                payload = wav_samples(media)
                samples = np.frombuffer(payload, np.uint8)
                level = int(samples.sum(dtype=np.int64)) * 1000 // len(samples)
                turns = int(np.count_nonzero(np.diff(samples >= 128)))
                top = int(np.bincount(samples, minlength=256).argmax())
                feature = f"wav8:frames={len(samples) // FRAME};mean={level};crossings={turns};mode={top};magic={hits};carved={len(found)}"
                out.append((key, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, found[0].type))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
