"""SimHash near-duplicates with pivot distance tables.

Fingerprints that differ in few bits are found without comparing all pairs:

1. Equal fingerprints are merged first, so a group of copies of any size is one fingerprint.
2. The pivot distance table holds each fingerprint's Hamming distances to many fixed reference fingerprints, kept apart for
   each of ``blocks`` blocks of bits; the full distance to a reference is the sum of its blocks.
3. Dealing.  By the triangle inequality a block's distances to all references differ by no more than the block's own differing
   bits.  Two fingerprints within ``bits`` bits therefore have all coordinates equal on some ``blocks - bits`` blocks, and their
   full distances to the first reference differ by ``bits`` at most.  A cell is a choice of such blocks, the coordinates there,
   and a band of the first reference's distance; a fingerprint goes to its own cells and to the band below where its
   distance is within ``bits`` of it.  This is exact.
4. Inside a cell pairs are discarded by the maximum coordinate difference: the sum over the blocks of the largest difference
   to any reference is a bound from below.  Survivors are verified by XOR and bit count.
5. Each cell returns a spanning forest of its links (at most n - 1), never its pairs; components are joined in Spark.

Full distances alone would deal badly: they lie within about 4 of 32, so a reference's band halves the pairs at best.

``keep_one`` drops near copies by five-word shingles and a Jaccard similarity of 0.8, see there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import about, batches, drop, mixed, written
from rillstone.llm.components import component_labels

PIVOTS = 24
BAND = 8


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the shingles' XXH64; fewer words than a shingle: their whole sequence; no words: 0."""
    import xxhash

    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def _fingerprints(texts: list[bytes | None], shingle: int, seed: int) -> np.ndarray:
    """As ``fingerprint`` for each text, with the bits of all shingles counted in arrays."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.lower().split() if t else []
        if not words:
            continue
        if len(words) <= shingle:
            hashes.append(digest(b" ".join(words), seed))
            counts[i] = 1
        else:
            before = len(hashes)
            hashes.extend(map(digest, map(b" ".join, zip(*(words[k:] for k in range(shingle)))), repeat(seed)))
            counts[i] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        raw = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        ends = np.cumsum(counts[full])
        sums = np.empty((len(full), 64), np.int64)
        for k, (end, n) in enumerate(zip(ends, counts[full], strict=True)):
            sums[k] = np.unpackbits(raw[end - n : end], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        over = (2 * sums > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): one row for each row of docs.  Null and blank texts have fp 0.  Reads doc_id and text only."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, texts in batches(rows):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_fingerprints(texts, shingle, seed).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


REFERENCES = np.random.default_rng(64).integers(0, 1 << 64, PIVOTS, np.uint64)


def pivot_table(fps: np.ndarray, blocks: int = 6) -> np.ndarray:
    """Hamming distances to the reference fingerprints: (fingerprints, blocks, references)."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = np.array([((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)], np.uint64)
    return np.bitwise_count((fps[:, None, None] ^ REFERENCES) & masks[:, None]).astype(np.int8)


def cells(fps: np.ndarray, bits: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of a fingerprint, cell) of every place it goes to; a cell's number is a hash of what names it."""
    table = pivot_table(fps, blocks)
    names = np.zeros((len(fps), blocks), np.uint64)
    for j in range(PIVOTS):
        names = mixed(names + table[:, :, j].astype(np.uint64) + np.uint64(j + 1))
    first = table[:, :, 0].sum(1, dtype=np.int64)
    below = np.flatnonzero((first % BAND < bits) & (first >= BAND))
    rows = np.concatenate((np.arange(len(fps)), below))
    band = np.concatenate((first // BAND, first[below] // BAND - 1)).astype(np.uint64)
    out = []
    for number, kept in enumerate(combinations(range(blocks), blocks - bits)):
        key = band + np.uint64(number << 8)
        for k in kept:
            key = mixed(key + names[rows, k])
        out.append(key)
    return np.tile(rows, len(out)), np.concatenate(out)


def discarded(a: np.ndarray, b: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of table rows are more than ``bits`` apart by their coordinates: block by block, the rest of a pair is left out early."""
    out = np.zeros(len(a), bool)
    bound, left = np.zeros(len(a), np.int16), np.arange(len(a))
    for k in range(table.shape[1]):
        bound[left] += np.abs(table[a[left], k] - table[b[left], k]).max(1).astype(np.int16)
        far = bound[left] > bits
        out[left[far]] = True
        left = left[~far]
    return out


def links(fps: np.ndarray, bits: int, blocks: int = 6, least_step: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
    """(index pairs of a spanning forest of the links among distinct fingerprints, pairs the pivot table discarded).

    Rows are swept in order of the first reference's distance, in steps; a step meets only rows whose distance is within
    ``bits``.  Memory is bounded by the step, whatever the cell's size.
    """
    n = len(fps)
    table = pivot_table(fps, blocks)
    first = table[:, :, 0].sum(1, dtype=np.int16)
    order = np.argsort(first, kind="stable")
    table, sorted_fps, first = table[order], fps[order], first[order]
    second = table[:, :, 1].sum(1, dtype=np.int16)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []
    gone = 0
    ends = np.searchsorted(first, first + bits, "right")
    step = max(1, min(least_step, n))
    for start in range(0, n, step):
        stop = min(n, start + step)
        for left in range(start, int(ends[stop - 1]), 4096):
            right = min(int(ends[stop - 1]), left + 4096)
            a, b = np.nonzero(np.abs(second[start:stop, None] - second[None, left:right]) <= bits)
            a, b = a + start, b + left
            upper = a < b
            a, b = a[upper], b[upper]
            far = discarded(a, b, table, bits)
            gone += int(far.sum())
            a, b = a[~far], b[~far]
            near = np.bitwise_count(sorted_fps[a] ^ sorted_fps[b]) <= bits
            for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((i, j))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return order[pairs[:, 0]], order[pairs[:, 1]], gone


def cell_links(fps: np.ndarray, keys: np.ndarray, bits: int, blocks: int, small: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``links`` for many cells, rows in order of ``keys``: cells of at most ``small`` rows together, each larger one by itself."""
    cut = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    sizes = np.diff(cut)
    together = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    parts, gone = [], 0
    if len(together):
        f, k = fps[together], keys[together]
        table = pivot_table(f, blocks)
        for step in range(1, small):
            a = np.flatnonzero(k[step:] == k[:-step]) if step < len(k) else np.empty(0, np.int64)
            if not len(a):
                break
            far = discarded(a, a + step, table, bits)
            gone += int(far.sum())
            a = a[~far]
            a = a[np.bitwise_count(f[a] ^ f[a + step]) <= bits]
            parts.append((f[a], f[a + step]))
    for c in np.flatnonzero(sizes > small):
        group = np.unique(fps[cut[c] : cut[c + 1]])
        i, j, n = links(group, bits, blocks)
        gone += n
        parts.append((group[i], group[j]))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), gone
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]), gone


def fingerprint_links(distinct: DataFrame, bits: int = 3, blocks: int = 6) -> DataFrame:
    """distinct(fp long) -> edges(a, b): forests that connect exactly what links of at most ``bits`` bits connect."""
    if not 0 <= bits < min(blocks, BAND + 1) or blocks > 64:
        raise ValueError("bits must be less than blocks and at most the band's width, and blocks at most 64")

    def spread(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in rows:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(fps), 4096):
                some = fps[start : start + 4096]
                at, key = cells(some.view(np.uint64), bits, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(some[at]), pa.array(key.view(np.int64))], ["fp", "key"])

    dealt = distinct.select("fp").mapInArrow(spread, "fp long, key long").repartition("key").sortWithinPartitions("key")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        rest: list[tuple[np.ndarray, np.ndarray]] = []

        def edges():
            fps, keys = (np.concatenate([r[k] for r in rest]) for k in (0, 1))
            a, b, _ = cell_links(fps.view(np.uint64), keys, bits, blocks)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in rows:
            fps, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if rest and (last or rest[-1][1][-1] != keys[0]):  # a cell over several batches is put together once
                rest.append((fps[:last], keys[:last]))
                yield edges()
                rest = [(fps[last:], keys[last:])]
            elif last:
                rest = [(fps[:last], keys[:last])]
                yield edges()
                rest = [(fps[last:], keys[last:])]
            else:
                rest.append((fps, keys))
        if rest:
            yield edges()

    return dealt.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, bits: int = 3, blocks: int = 6, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    component_id is the smallest doc_id reachable through links of at most ``bits`` differing bits, the document's own
    included.  Documents without words have fingerprint zero and link like any other.  Rows with a null doc_id take
    part but can't name a component; where all ids are null, so is component_id.
    """
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    merged = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = component_labels(fingerprint_links(merged.select("fp"), bits, blocks))
    of = merged.join(labels.select(F.col("a").alias("fp"), F.col("b").alias("label")), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = of.join(of.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by Jaccard similarity


def shingle_hashes(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 of a text's shingles, ascending; fewer words than a shingle: their whole sequence; none: empty."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    parts = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64))


def prefix_length(n: int, similarity: float) -> int:
    """How many of a set's first elements must be looked at: two sets of at least this Jaccard similarity share one of them."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _common(docs: DataFrame, shingle: int, sample: int) -> np.ndarray:
    """Shingles that stand in at least 4 of about ``sample`` documents, most frequent first, at most 2**18 of them: only an order is made of them."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for _, texts in batches(rows):
            for t in texts:
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t, shingle).view(np.int64))], ["h"])

    total = docs.count()
    some = about(docs, "doc_id", sample, total).mapInArrow(run, "h long").groupBy("h").count().filter("count > 3")
    rows = some.orderBy(F.desc("count"), "h").limit(1 << 18).select("h").toArrow().column(0).to_numpy()
    return np.sort(rows.view(np.uint64))


def parity_bits(h: np.ndarray, width: int = 1024) -> bytes:
    """Which of ``width`` bits (a power of two) an odd number of the hashes falls on: two sets' bits differ in at most as many places as the sets do."""
    at = (h >> np.uint64(32)).astype(np.int64) % width
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bits: list[bytes]) -> np.ndarray:
    """Parity bits of several widths at the least of them, as rows of 64-bit words: the halves of a wider row are added."""
    width = min(map(len, bits))
    return np.array([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in bits])


def possible_pairs(n: np.ndarray, bits: np.ndarray, mark: np.ndarray, similarity: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with unequal ``mark`` that sizes ``n`` and parity ``bits`` (rows of 64-bit words) do not show to be less similar; loses none.

    Sets of similarity t differ in at most (1 - t) / (1 + t) of their sizes' sum.  Rows are swept in order of size; memory is bounded by the step.
    """
    order = np.argsort(n, kind="stable")
    n, bits, mark = n[order], bits[order], mark[order]
    ends = np.searchsorted(n, n / (similarity - 1e-9), "right")
    found = [np.empty((2, 0), np.int64)]
    for start in range(0, len(n), step):
        stop = min(len(n), start + step)
        for left in range(start, int(ends[stop - 1]), 4096):
            right = min(int(ends[stop - 1]), left + 4096)
            a, b = np.nonzero(mark[start:stop, None] != mark[None, left:right])
            a, b = a + start, b + left
            near = (a < b) & (b < ends[a])
            a, b = a[near], b[near]
            most = (n[a] + n[b]) * ((1 - similarity) / (1 + similarity) + 1e-9)
            differ = np.zeros(len(a), np.int64)
            k = 0
            while k < bits.shape[1] and len(a):  # most pairs are out after the first words; about 2**22 words are met at a time
                words = max(1, (1 << 22) // len(a))
                differ += np.bitwise_count(bits[a, k : k + words] ^ bits[b, k : k + words]).sum(1, dtype=np.int64)
                k += words
                near = differ <= most
                a, b, most, differ = a[near], b[near], most[near], differ[near]
            found.append(np.stack((order[a], order[b])))
    a, b = np.concatenate(found, axis=1)
    return a, b


def _across(shared: DataFrame, reps: DataFrame, labels: DataFrame, together: int, similarity: float, block: int) -> DataFrame:
    """pairs(a, b) of documents that share a key of over ``together`` documents, are not connected yet and may be similar.

    A key whose documents are all connected has none, which is every family its hub holds together; of keys with the same documents one is
    taken.  The rest is dealt by key and class of size (a factor of 1 / similarity; each document also goes to the class below), and a
    cell of over ``block`` documents, or 128 times as many bytes of parity bits, into pairs of blocks, so that a task's memory is
    bounded; pairs inside a component are never looked at.
    """
    own = shared.filter(F.col("m") > together).select("key", "id", "n").join(labels.select(F.col("a").alias("id"), F.col("b").alias("label")), "id", "left")
    own = own.select("key", "id", "n", F.coalesce("label", "id").alias("label"))
    marks = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")]
    open_keys = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), *marks).filter("low < high")
    size = F.floor(F.log("n") / -math.log(similarity * 0.999)).cast("int")  # a little wide, so that rounding parts no pair
    cell = F.explode(F.array(F.xxhash64("key", size), F.xxhash64("key", size - 1))).alias("cell")
    rows = written(own.join(open_keys.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key"), "key").select("id", "n", "label", cell), "open")
    weight = F.greatest(F.lit(1), F.col("n") / 512)  # of a document's parity bits, in units of 128 bytes
    cells_ = rows.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.sum(weight) / block).cast("int").alias("blocks"), *marks)
    cells_ = cells_.filter("low < high").groupBy("m", "x", "y", "blocks").agg(F.min("cell").alias("cell"))
    dealt = rows.join(cells_.select("cell", "blocks"), "cell").withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "label")
    dealt = dealt.join(reps.select("id", "bits"), "id")

    def sweep(key, table):
        import pyarrow as pa

        ids, n, label = (table.column(c).to_numpy() for c in ("id", "n", "label"))
        a, b = possible_pairs(n, folded(table.column("bits").to_pylist()), label, similarity)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    pairs = dealt.groupBy("cell", "i", "j").applyInArrow(sweep, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(shared: DataFrame, together: int) -> DataFrame:
    """shared(id, n, fp, key, m) -> pairs that share a key: all pairs of up to ``together`` documents, else each with the key's hub."""
    few = shared.filter(F.col("m") <= together)
    left, right = (few.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "fp")]) for side in "ab")
    pairs = left.join(right, "key").filter("id_a < id_b")
    # the hub: of the documents with the largest share of shared keys the smallest, as an original shares them all and its copies do not
    weight = shared.groupBy("id").agg(F.count("*").alias("c"), F.first("n").alias("size")).select("id", (F.col("c") / F.col("size")).alias("share"))
    many = shared.filter(F.col("m") > together).join(weight, "id")
    hub = many.groupBy("key").agg(F.max(F.struct("share", (-F.col("id")).alias("minus"), "n", "fp")).alias("hub"))
    star = many.join(hub, "key").select("id", "n", "fp", F.col("hub.n").alias("n_b"), F.col("hub.fp").alias("fp_b"), (-F.col("hub.minus")).alias("id_b")).filter("id <> id_b")
    names = ["id_a", "n_a", "fp_a", "id_b", "n_b", "fp_b"]
    return pairs.select(*names).unionByName(star.withColumnsRenamed({"id": "id_a", "n": "n_a", "fp": "fp_a"}).select(*names)).distinct()


def similar_groups(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, reach: int = 24, together: int = 64, sample: int = 4096, block: int = 1 << 15
) -> tuple[DataFrame, DataFrame]:
    """(groups, labels) of docs(doc_id, text) without null ids: groups(doc_id, id) names each document's least equal, labels(a, b) an id's least connected one.

    Documents with the same set of shingles are one.  Two sets of Jaccard similarity 0.8 or more share one of the first
    fifth of their elements in any common order; the order puts shingles that are common in a sample last, so the
    keys are rare ones and a passage in many documents makes no large group.  Pairs that share a key, and pairs of fingerprints
    within 3 bits, are discarded by size, by the pivot table and by XOR beyond ``reach`` bits (pairs of similarity 0.8 differ in 9.7,
    standard deviation 2.9); the survivors' shingles are compared.

    A key of over ``together`` documents first gives one pair for each of them, with the key's hub, and not all pairs: such groups are
    families of near copies.  What the hubs leave unconnected is swept in blocks (``_across``), past sizes and parity bits that
    lose no pair, and its survivors' shingles are compared too.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mark = F.xxhash64("text")  # of rows that repeat a doc_id the one with the least mark counts
    common = spark.sparkContext.broadcast(_common(base, shingle, sample))

    def describe(rows: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        late = common.value
        for ids, texts, marks in batches(rows, 3):
            prints = _fingerprints(texts, shingle, 42).view(np.int64)
            out = []
            for t in texts:
                h = shingle_hashes(t, shingle)
                is_late = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h if len(late) else np.zeros(len(h), bool)
                first = h[np.argsort(is_late, kind="stable")][: prefix_length(len(h), similarity)]
                out.append((xxhash.xxh3_128_digest(h.tobytes()), len(h), first.view(np.int64), parity_bits(h, 1 << max(10, (2 * len(h) - 1).bit_length()))))
            digest, n, keys, bits = zip(*out, strict=True)
            columns = [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(prints), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "digest", "n", "fp", "keys", "bits"])

    described = written(base.select("doc_id", "text", mark.alias("mark")).mapInArrow(describe, "doc_id long, mark long, digest binary, n long, fp long, keys array<long>, bits binary"), "described")
    named = described.groupBy("doc_id").agg(F.min(F.struct("mark", "digest")).alias("first")).select("doc_id", "first.digest")
    least = written(named.groupBy("digest").agg(F.min("doc_id").alias("id")), "least")
    reps = described.join(least, (described["digest"] == least["digest"]) & (described["doc_id"] == least["id"])).select("id", "n", "fp", "keys", "bits").dropDuplicates(["id"])
    reps = written(reps, "reps")
    keyed = reps.select("id", "n", "fp", F.explode("keys").alias("key"))
    shared = written(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key"), "shared")
    near = fingerprint_links(reps.select("fp").distinct())
    of = reps.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("r")).select("fp", "r.id", "r.n")
    side = lambda x, y: of.select(*[F.col(c).alias(f"{c}_{y}") for c in ("id", "n", "fp")]).withColumn(x, F.col(f"fp_{y}"))
    forest = near.join(side("a", "a"), "a").join(side("b", "b"), "b").select("id_a", "n_a", "fp_a", "id_b", "n_b", "fp_b")
    equal = reps.join(of.select("fp", F.col("id").alias("id_b"), F.col("n").alias("n_b")), "fp").filter("id <> id_b")
    equal = equal.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("fp").alias("fp_a"), "id_b", "n_b", F.col("fp").alias("fp_b"))
    pairs = _candidates(shared, together).unionByName(forest).unionByName(equal).filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (similarity - 1e-9))

    def sift(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in rows:
            a, b, x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            x, y, at = x.view(np.uint64), y.view(np.uint64), np.arange(len(a))
            ok = ~discarded(at, at + len(a), pivot_table(np.concatenate((x, y))), reach)
            ok &= np.bitwise_count(x ^ y) <= reach
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    def verify(rows: Iterator) -> Iterator:
        import pyarrow as pa

        held: tuple = (None, None)  # the hub's shingles, for the pairs that follow
        for batch in rows:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            x, y = (batch.column(k).cast(pa.binary()) for k in (2, 3))
            keep = []
            for k in range(len(a)):
                if held[0] != b[k]:
                    held = (b[k], shingle_hashes(y[k].as_py(), shingle))
                own = shingle_hashes(x[k].as_py(), shingle)
                both = len(np.intersect1d(own, held[1], assume_unique=True))
                keep.append(both >= (similarity - 1e-9) * (len(own) + len(held[1]) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(some: DataFrame) -> DataFrame:
        ids = some.select(F.col("a").alias("id")).union(some.select("b")).distinct()
        texts = base.join(ids, F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.min_by("text", F.struct(mark, "text")).alias("text"))
        texts = written(texts, "texts")
        spare.append(texts)
        first = some.join(texts.withColumnsRenamed({"doc_id": "a", "text": "x"}), "a")
        return first.join(texts.withColumnsRenamed({"doc_id": "b", "text": "y"}), "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")

    spare: list[DataFrame] = []  # tables that the labels, a table of their own, no longer need
    sifted = written(pairs.select("id_a", "id_b", "fp_a", "fp_b").mapInArrow(sift, "a long, b long").distinct(), "pairs")
    labels = component_labels(verified(sifted))
    spare.append(sifted)
    while spare:
        drop(spare.pop())
    rest = written(_across(shared, reps, labels, together, similarity, block), "rest")
    spare += [rest, shared, reps]
    if not rest.isEmpty():
        labels = component_labels(labels.unionByName(verified(rest)))
    while spare:
        drop(spare.pop())
    return named.join(least, "digest").select("doc_id", "id"), labels


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, **options) -> DataFrame:
    """Rows of docs without near copies: of documents that links of Jaccard similarity ``similarity`` or more over word shingles
    connect, the one with the smallest doc_id stays; of rows that repeat a doc_id, one.

    Documents without words are equal.  Rows with a null doc_id can't be told apart and stay.  Columns and their order are those
    of docs, whatever they are called.
    """
    named = docs.filter("doc_id is not null")
    groups, labels = similar_groups(named.select("doc_id", "text"), shingle, similarity, **options)
    ids = groups.select(F.col("id").alias("kept")).distinct().join(labels.select(F.col("a").alias("kept")), "kept", "left_anti")
    row = F.struct(F.xxhash64(F.col("text").cast("string")).alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = named.select(F.col("doc_id").cast("long").alias("key"), row.alias("marked"))
    one = whole.join(ids, F.col("key") == F.col("kept"), "left_semi").groupBy("key").agg(F.min("marked").alias("marked"))
    return one.select(*[F.col("marked.row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.filter("doc_id is null"))


__all__ = ["cell_links", "cells", "discarded", "fingerprint", "fingerprint_links", "fingerprints", "keep_one", "links", "near_duplicates", "pivot_table", "possible_pairs", "similar_groups"]
