"""Plain definitions that the operators are held against; quadratic or worse, for small inputs."""

from __future__ import annotations

import hashlib

import xxhash


def substring_dedup(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    words = {i: (t or "").encode().split() for i, t in docs}
    seen: set[tuple] = set()
    gone: dict[int, set[int]] = {i: set() for i in words}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[i].update(range(k, k + window))
            seen.add(key)
    return {i: (len(w), len(gone[i]), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone[i])).hexdigest()) for i, w in words.items()}


def simhash(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids: list[int], prints: list[int], bits: int) -> dict[int, int]:
    parent = {i: i for i in ids}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def similar(texts: dict[int, str | None], shingle: int = 5, similarity: float = 0.8) -> dict[int, int]:
    """Each document's smallest id reachable through links of this Jaccard similarity over word shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    parent = {i: i for i in texts}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= (similarity - 1e-9) * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def top_k(vectors: dict[int, list | None], queries: list[int], k: int, scale: int = 256) -> list[tuple[int, int, int, int]]:
    from math import floor, isfinite

    usable = {i: [floor(scale * x) for x in v] for i, v in vectors.items() if v and all(x is not None and isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in usable:
            scores = [(-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def chunk_ends(lines: list[bytes]) -> list[tuple[int, int]]:
    """Chunks [from, to): one ends after a line unless the mixed sum of its mixed hash and the mixed next-lower one's is 0 modulo 4, after 8 lines, and at the end."""

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    h = [xxhash.xxh64_intdigest(x) for x in lines]
    out, before = [], 0
    for i in range(1, len(lines)):
        own = mix((mix((h[i] + 1) % 2**64) + mix((h[i - 1] + 2) % 2**64)) % 2**64) % 4 != 0
        if own or i + 1 == len(lines) or i + 1 - before == 8:
            out.append((min(before, i - 1), i + 1))
            before = i + 1
    return out


def line_dedup(docs: list[tuple[int, str | None]]) -> dict[int, str]:
    """Each text without the lines of chunks, and of their tails of two or more lines, that stand as such in an earlier place."""
    texts = {i: [x for x in (t or "").encode().split(b"\n") if x.strip()] for i, t in docs}
    seen, gone = set(), {i: set() for i in texts}
    for i in sorted(texts):
        for a, b in chunk_ends(texts[i]):
            for start in range(a, b - 1):
                block = tuple(texts[i][start:b])
                if block in seen:
                    gone[i].update(range(start, b))
                seen.add(block)
    out = {}
    for i, t in docs:
        kept, at, away = [], -1, False
        for line in (t or "").encode().split(b"\n"):
            if line.strip():
                at += 1
                away = at in gone[i]
            kept += [] if away else [line]
        out[i] = b"\n".join(kept).decode()
    return out


def unigram(docs: list[tuple[int, str | None]]) -> dict[int, tuple[bool, int, int, int, float]]:
    import zlib
    from collections import Counter
    from math import log10

    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}
