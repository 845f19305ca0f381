"""Language-model scoring: a gated recurrent network in numpy with a class-factored output softmax.

Counts of all training documents' tokens are aggregated in Spark.  The most frequent words are the network's own
vocabulary, in classes of equal size by frequency; every other word is one further class, inside which its chance is
(c + 1) / (N_rest + V_rest + 1) from the counts.  So a token's log-probability is class plus word in class, and the whole
is a distribution over known words and one unknown.  The network learns by truncated backpropagation through time from all
training documents; it scores whole documents, its state carried from window to window.

Training deals the documents by hash to shards of about ``Settings.shard_tokens`` tokens, so their number grows with the
input and a shard's size doesn't.  Rounds of 1, 2, 4, 8, ... shards take each shard once: the shards of a round learn side by
side from the same network, and the next round starts from the mean of theirs, weighted by tokens.

The rest's counts don't fit a broadcast, so scoring sends (word hash, document) pairs to the hash's bucket, where they
meet the counts; back come sums for each document, in blobs by chunk of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import batches, buckets_for, drop, id_crc32, mixed, word_hashes, written


@dataclass(frozen=True)
class Settings:
    """classes x words: the network's vocabulary; hidden: its width; known: words whose counts are broadcast.

    shard_tokens: about how many tokens one task learns in a row; a document over a sixteenth of it is dealt in pieces.
    """

    classes: int = 64
    words: int = 64
    hidden: int = 32
    known: int = 65_536
    window: int = 16
    streams: int = 48
    rate: float = 0.08
    shard_tokens: int = 1 << 20
    chunk_words: int = 800_000


#: The hash that stands for a document's end; word hashes never take it (see ``_tokens``).
END_HASH = np.uint64(0)


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all lower-cased texts without ends, words of each text)."""
    hashes, counts = word_hashes([(t or b"").lower() for t in texts])
    hashes[hashes == END_HASH] = np.uint64(1)
    return hashes, counts


class Places:
    """Finds places in an array of different hashes by their upper bits: one look for nearly every word, no binary search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.count, self.hashes = len(hashes), np.append(hashes, np.uint64(0))  # the last stands for none
        self.shift = np.uint64(64 - min(20, max(8, (self.count * 16).bit_length())))
        slots, self.tables, left = (hashes >> self.shift).astype(np.int64), [], np.arange(self.count)
        while not self.tables or len(left):  # a table for each further hash of a slot
            table = np.full(1 << int(np.uint64(64) - self.shift), self.count, np.int32)
            table[slots[left]] = left
            self.tables.append(table)
            left = left[table[slots[left]] != left]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place, ``count`` for others."""
        slot = (h >> self.shift).view(np.int64)
        at = self.tables[0][slot]
        other = np.flatnonzero(self.hashes[at] != h)
        at[other] = self.count
        for table in self.tables[1:]:
            found = table[slot[other]]
            hit = (self.hashes[found] == h[other]) & (found < self.count)
            at[other[hit]] = found[hit]
        return at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x's exponentials, in its own place: (log-probability of column ``at`` of each row, sum of each row's exponentials).

    The rows' largest values are taken off only where an exponential could leave float32's range.
    """
    if x.size and (np.maximum.reduce(x, None) > 80 or np.minimum.reduce(x, None) < -80):
        x -= x.max(1, keepdims=True)
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    return own - np.log(sums), sums


def _by_value(x: np.ndarray, below: int) -> np.ndarray:
    """Stable order of whole numbers from 0 to under ``below``; sixteen bits are sorted in linear time."""
    return np.argsort(x.astype(np.uint16) if below <= 1 << 16 else x, kind="stable")


def _row_sums(x: np.ndarray, ids: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(different ids, sums of their rows of x): all ids' second rows are added at once, then all third ones; what few ids have left, id by id."""
    order = _by_value(ids, below)
    ids = ids[order]
    edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
    first, times = edges[:-1], edges[1:] - edges[:-1]
    by = _by_value(len(ids) - times, len(ids))
    first, times = first[by], times[by]
    more = np.searchsorted(-times, -np.arange(1, times[0] + 1)).tolist()  # ids with over 1, 2, ... rows
    out, done = x[order[first]], 1
    while more[done - 1] > 4:
        k = more[done - 1]
        out[:k] += x[order[first[:k] + done]]
        done += 1
    for i in range(more[done - 1]):
        out[i] += np.ones(times[i] - done, x.dtype) @ x[order[first[i] + done : first[i] + times[i]]]
    return ids[first], out


class Network:
    """Gated recurrent unit over token ids 0..K (K: any other word; id 0: the end) with a two-level output."""

    def __init__(self, s: Settings, counts: np.ndarray, rest: float, seed: int = 7) -> None:
        r, h = np.random.default_rng(seed), s.hidden
        self.s, self.k = s, s.classes * s.words
        c = np.zeros(self.k)
        c[: len(counts)] = counts
        c += 0.1
        c = c.reshape(s.classes, s.words)
        mass = np.append(c.sum(1), rest + 0.1)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "x": f(self.k + 1, 3 * h, scale=0.1), "u": f(h, 3 * h, scale=1 / np.sqrt(h)), "b": np.zeros(3 * h, np.float32),
            "wc": f(h, s.classes + 1, scale=0.05), "bc": np.log(mass / mass.sum()).astype(np.float32),
            "ww": f(s.classes, h, s.words, scale=0.05), "bw": np.log(c / c.sum(1, keepdims=True)).astype(np.float32),
        }
        self.g = {k: np.full_like(v, 1e-4) for k, v in self.p.items()}

    def step(self, inputs: np.ndarray, h: np.ndarray):
        n, p = self.s.hidden, self.p
        x = p["x"][inputs] + p["b"]
        gates = _sigmoid(x[:, : 2 * n] + h @ p["u"][:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        rh = r * h
        new = np.tanh(x[:, 2 * n :] + rh @ p["u"][:, 2 * n :])
        return h + z * (new - h), (z, r, rh, new)

    def gates(self) -> np.ndarray:
        """Half the recurrent weights, gate by gate (update, reset, new).

        A sigmoid is (tanh(x / 2) + 1) / 2; the reset gate is used without its last halving, so the new state's weights have it.
        """
        n = self.s.hidden
        return np.multiply(self.p["u"].reshape(n, 3, n).transpose(1, 0, 2), 0.5, order="C")

    def outputs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural-log probability of each target (of the class alone for other words)."""
        p, s = self.p, self.s
        cls = np.minimum(targets // s.words, s.classes)
        out = np.empty(len(targets))
        for a in range(0, len(targets), 2048):  # small enough for the cache
            x = states[a : a + 2048] @ p["wc"]
            x += p["bc"]
            out[a : a + 2048] = _softmax(x, cls[a : a + 2048])[0]
        order = _by_value(cls, s.classes + 1)
        cut = np.searchsorted(cls[order], np.arange(s.classes + 1)).tolist()
        order = order[: cut[-1]]  # by class, without other words
        by, of = states[order], cls[order]
        own, inside = targets[order] - of * s.words, np.empty(len(order))
        c = 0
        while c < s.classes:
            first = last = c  # classes whose words fit the cache together
            while last < s.classes and (last == first or cut[last + 1] - cut[first] <= 2048):
                last += 1
            a, b = cut[first], cut[last]
            if b > a:
                x = np.empty((b - a, s.words), np.result_type(by, p["ww"]))
                for c in range(first, last):
                    if cut[c + 1] > cut[c]:
                        part = x[cut[c] - a : cut[c + 1] - a]
                        np.matmul(by[cut[c] : cut[c + 1]], p["ww"][c], out=part)
                        part += p["bw"][c]
                inside[a:b] = _softmax(x, own[a:b])[0]
            c = last
        out[order] += inside
        return out

    def _spans(self, cut: list[int]):
        """Runs of classes that are multiplied together: (first class, end, rows kept for each class).

        Later classes are rarer and go together, each filled up to the run's largest; where that would be mostly filling, they go alone.
        """
        a, classes = 0, self.s.classes
        while a < classes:
            b = min(classes, 4 * a or 1)
            most = max(cut[c + 1] - cut[c] for c in range(a, b))
            if b - a > 1 and (b - a) * most > 4 * (cut[b] - cut[a]) + 8 * (b - a):
                yield from ((c, c + 1, cut[c + 1] - cut[c]) for c in range(a, b) if cut[c + 1] > cut[c])
            elif most:
                yield a, b, most
            a = b

    def learn(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """One truncated window (time x streams): (last state, mean log-probability before the update).

        A stream whose input is the end starts a document: its state is cleared.
        """
        h, means = learn([self], inputs[None], targets[None], h[None])
        return h[0], means[0]

    def learn_outputs(self, flat: np.ndarray, goal: np.ndarray, scale: np.float32) -> tuple[np.ndarray, float]:
        """Learns the output's part of a window: (gradient of the states, sum of log-probabilities before the update)."""
        p, s = self.p, self.s
        cls, rows = np.minimum(goal // s.words, s.classes), np.arange(len(goal))
        d = flat @ p["wc"]
        d += p["bc"]
        logs, sums = _softmax(d, cls)
        total = float(logs.sum())
        d *= (scale / sums)[:, None]
        d[rows, cls] -= scale
        dh = d @ p["wc"].T
        self._move("wc", flat.T @ d)
        self._move("bc", np.ones(len(d), d.dtype) @ d)
        order = _by_value(cls, s.classes + 1)
        cut = np.searchsorted(cls[order], np.arange(s.classes + 1))
        order = order[: cut[-1]]  # by class, without other words
        by, of = flat[order], cls[order]
        own, rank, cut = goal[order] - of * s.words, rows[: len(order)] - cut[of], cut.tolist()
        d, spans = p["bw"][of], []
        for a, b, most in self._spans(cut):
            at, slot, held = slice(cut[a], cut[b]), None, by[cut[a] : cut[b]]
            if b == a + 1:
                d[at] += held @ p["ww"][a]
            else:
                slot = (of[at] - a) * most + rank[at]
                wide = np.zeros(((b - a) * most, s.hidden), by.dtype)
                wide[slot] = held
                held = wide.reshape(b - a, most, s.hidden)
                d[at] += (held @ p["ww"][a:b]).reshape(-1, s.words)[slot]
            spans.append((a, b, most, at, slot, held))
        logs, sums = _softmax(d, own)
        total += float(logs.sum())
        d *= (scale / sums)[:, None]
        d[rows[: len(own)], own] -= scale
        down, bw = np.empty_like(by), np.zeros_like(p["bw"])
        for a, b, most, at, slot, held in spans:
            if slot is None:
                np.matmul(d[at], p["ww"][a].T, out=down[at])
                bw[a] = np.ones(most, d.dtype) @ d[at]
                self._move("ww", held.T @ d[at], a, most * scale <= 1)
            else:
                wide = np.zeros(((b - a) * most, s.words), d.dtype)
                wide[slot] = d[at]
                wide = wide.reshape(b - a, most, s.words)
                down[at] = (wide @ p["ww"][a:b].transpose(0, 2, 1)).reshape(-1, s.hidden)[slot]
                bw[a:b] = np.ones(most, d.dtype) @ wide
                # states lie within -1 and 1 and errors within the scale, so no gradient of so few tokens is cut
                self._move("ww", held.transpose(0, 2, 1) @ wide, slice(a, b), most * scale <= 1)
        self._move("bw", bw)
        dh[order] += down
        return dh, total

    def _move(self, name: str, v: np.ndarray, at=slice(None), within: bool = False) -> None:
        """One step of weights against their gradient v, which is used up; ``g`` holds the sums of gradients' squares.

        ``within``: v is known to lie within -1 and 1, where gradients are cut.
        """
        values, squares = self.p[name][at], self.g[name][at]
        if not within:
            np.clip(v, -1, 1, out=v)
        step = v * v
        squares += step
        np.sqrt(squares, out=step)
        np.divide(v, step, out=step)
        step *= self.s.rate
        values -= step

    def _move_rows(self, rows: np.ndarray, v: np.ndarray) -> None:
        """``_move`` for some inputs' rows of "x"."""
        np.clip(v, -1, 1, out=v)
        step = v * v
        step += np.take(self.g["x"], rows, axis=0)
        self.g["x"][rows] = step
        np.sqrt(step, out=step)
        np.divide(v, step, out=step)
        step *= self.s.rate
        self.p["x"][rows] = np.subtract(np.take(self.p["x"], rows, axis=0), step, out=step)


def learn(nets: list[Network], inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """One truncated window of networks that learn apart from each other (network x time x streams): (last states, means as ``Network.learn``).

    They share the loops over time only, whose single operations are too small to be worth a call each.  Arrays are kept by
    time and gate, so these operations meet contiguous memory.  Gradients are those of the mean over streams from the start.
    """
    n, kind = nets[0].s.hidden, nets[0].p["x"].dtype
    size, steps, streams = inputs.shape
    m, scale = steps * streams, np.float32(1 / streams)
    fed, goal = (np.ascontiguousarray(x, np.int64).reshape(size, m) for x in (inputs, targets))
    u = np.stack([net.gates() for net in nets], 1)
    u2, un = u[:2], u[2]
    given = np.empty((steps, 3, size, streams, n), kind)  # what the inputs add to the gates; then the gates, update and reset doubled
    for i, net in enumerate(nets):
        x = np.take(net.p["x"], fed[i], axis=0)
        x += net.p["b"]
        x = x.reshape(steps, streams, 3, n).transpose(0, 2, 1, 3)
        np.multiply(x[:, :2], 0.5, out=given[:, :2, i])
        given[:, 2, i] = x[:, 2]
    starts = inputs.transpose(1, 0, 2) == 0
    some = starts.any((1, 2)).tolist()
    before, after = np.empty((steps, size, streams, n), kind), np.empty((steps, size, streams, n), kind)
    for t in range(steps):
        held, gate, new = before[t], given[t, :2], given[t, 2]
        np.copyto(held, h)
        if some[t]:
            held[starts[t]] = 0
        gate += held @ u2
        np.tanh(gate, out=gate)
        gate += 1
        new += (gate[1] * held) @ un
        np.tanh(new, out=new)
        h = np.subtract(new, held, out=after[t])
        h *= gate[0]
        h *= 0.5
        h += held
    dh, totals = np.empty_like(after), []
    for i, net in enumerate(nets):
        d, total = net.learn_outputs(after[:, i].reshape(m, n), goal[i], scale)
        dh[:, i] = d.reshape(steps, streams, n)
        totals.append(total / m)
    given[:, :2] *= 0.5
    gx, used, back = np.empty_like(given), np.empty_like(before), np.zeros(h.shape, kind)
    ut = np.stack([net.p["u"].reshape(n, 3, n).transpose(1, 2, 0) for net in nets], 1)
    ut2, unt = ut[:2], ut[2]
    for t in range(steps - 1, -1, -1):
        g, (z, r, new), held, (by_z, by_r, by_new) = dh[t], given[t], before[t], gx[t]
        g += back
        np.multiply(new, new, out=by_new)
        np.subtract(1, by_new, out=by_new)
        by_new *= z
        by_new *= g
        np.subtract(new, held, out=by_z)
        by_z *= z
        np.subtract(1, z, out=z)
        by_z *= z
        by_z *= g
        g *= z
        drh = by_new @ unt
        np.multiply(held, r, out=used[t])
        np.multiply(drh, used[t], out=by_r)
        drh *= r
        g += drh
        np.subtract(1, r, out=r)
        by_r *= r
        by_z, by_r = gx[t, :2] @ ut2
        g += by_z
        g += by_r
        if some[t]:
            g[starts[t]] = 0
        back = g
    for i, net in enumerate(nets):
        rows = gx[:, :, i].transpose(0, 2, 1, 3).reshape(m, 3 * n)
        net._move("u", np.concatenate((before[:, i].reshape(m, n).T @ rows[:, : 2 * n], used[:, i].reshape(m, n).T @ rows[:, 2 * n :]), 1))
        net._move("b", np.ones(m, kind) @ rows)
        net._move_rows(*_row_sums(rows, fed[i], net.k + 1))
    return h, totals


def train(s: Settings, documents: list[np.ndarray], counts: np.ndarray, rest: float, net: Network | None = None) -> Network:
    """A network (``net`` itself, if given) that has learned every token of documents of token ids, each with its end."""
    net = net or Network(s, counts, rest)
    train_apart([net], [documents])
    return net


def train_apart(nets: list[Network], documents: list[list[np.ndarray]]) -> None:
    """Each network learns every token of its own documents, as if it were alone; windows of equal shape go side by side."""
    s, work = nets[0].s, []
    for net, own in zip(nets, documents, strict=True):
        stream = np.concatenate(own) if own else np.empty(0, np.int64)
        if len(stream) < 2:
            continue
        width = min(s.streams, max(1, len(stream) // (2 * s.window)))
        length = -(-(len(stream) - 1) // width)
        # the last stream is filled up from the first tokens
        inputs, targets = (np.resize(x, width * length).reshape(width, length).T for x in (stream[:-1], stream[1:]))
        work.append([net, inputs, targets, np.zeros((width, s.hidden), np.float32)])
    for t in range(0, max((len(w[1]) for w in work), default=0), s.window):
        shapes: dict[tuple, list] = {}
        for w in work:
            if t < len(w[1]):
                shapes.setdefault(w[1][t : t + s.window].shape, []).append(w)
        for some in shapes.values():
            inputs, targets = (np.stack([w[k][t : t + s.window] for w in some]) for k in (1, 2))
            h, _ = learn([w[0] for w in some], inputs, targets, np.stack([w[3] for w in some]))
            for w, state in zip(some, h, strict=True):
                w[3] = state


#: So many shards of a round learn side by side in one task.
GANG = 4

#: A network travels in so many pieces of equal size, which are averaged apart.
PIECES = 512


def _flat(net: Network) -> np.ndarray:
    """Weights and step sizes in a row, filled up with zeros to ``PIECES`` equal pieces."""
    v = np.concatenate([x.ravel() for held in (net.p, net.g) for x in held.values()])
    return np.append(v, np.zeros(-len(v) % PIECES, np.float32)).reshape(PIECES, -1)


def _set_flat(net: Network, values: np.ndarray) -> None:
    values, at = values.ravel(), 0
    for held in (net.p, net.g):
        for k, x in held.items():
            held[k] = values[at : at + x.size].reshape(x.shape).copy()
            at += x.size


def trained(docs: DataFrame, s: Settings, to_ids, counts: np.ndarray, rest: float, n_tokens: int) -> Network:
    """A network that has learned from all of docs(doc_id, text), which have ``n_tokens`` tokens with their ends.

    The shard of a document, or of a piece of a long one, and its place there come from a hash of id and text, so the result
    depends on neither partitions nor files.
    """
    net = Network(s, counts, rest)
    if not n_tokens:
        return net
    shards, most = -(-n_tokens // s.shard_tokens), max(2, s.shard_tokens // 16)
    kind = np.uint16 if net.k < 1 << 16 else np.uint32

    def spread(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for marks, texts in batches(rows, most=1 << 20):
            h, n = _tokens(texts)
            ids, ends = to_ids(h).astype(kind), np.cumsum(n)
            out = []
            for mark, a, b in zip(marks, ends - n, ends, strict=True):
                own = np.append(ids[a:b], kind(0))
                for number, start in enumerate(range(0, len(own), most)):
                    place = mixed(np.array([mark, number], np.int64).view(np.uint64))
                    place = mixed(place[:1] + place[1:])[0]
                    shard = int(place % np.uint64(shards))
                    out.append(((shard + 1).bit_length() - 1, shard, int(place.view(np.int64)), own[start : start + most].tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["round", "shard", "place", "ids"])

    marked = docs.select(F.xxhash64("doc_id", "text").alias("mark"), "text")
    dealt = written(marked.mapInArrow(spread, "round int, shard long, place long, ids binary"), "tokens", "round")
    for number in range(shards.bit_length()):
        start = docs.sparkSession.sparkContext.broadcast(net)

        def learned(key, table):
            import pyarrow as pa

            parts: dict[int, list] = {}
            for shard, place, ids in zip(*(table.column(x).to_pylist() for x in ("shard", "place", "ids")), strict=True):
                parts.setdefault(shard, []).append((place, ids))
            nets, documents = [], []
            for shard in sorted(parts):
                own = Network.__new__(Network)
                own.s, own.k = s, start.value.k
                own.p, own.g = ({k: v.copy() for k, v in held.items()} for held in (start.value.p, start.value.g))
                nets.append(own)
                documents.append([np.zeros(1, kind), *(np.frombuffer(x, kind) for _, x in sorted(parts[shard]))])
            train_apart(nets, documents)
            data = [x.tobytes() for own in nets for x in _flat(own)]
            shard, n = ([x for x in of for _ in range(PIECES)] for of in (sorted(parts), [sum(map(len, x)) for x in documents]))
            return pa.table({"piece": pa.array(list(range(PIECES)) * len(nets), pa.int32()), "shard": pa.array(shard, pa.int64()), "n": pa.array(n, pa.int64()), "data": pa.array(data, pa.binary())})

        def mean(key, table):
            import pyarrow as pa

            total, sums = 0, 0.0
            for _, n, data in sorted(zip(*(table.column(x).to_pylist() for x in ("shard", "n", "data")), strict=True)):
                total, sums = total + n, sums + n * np.frombuffer(data, np.float32).astype(np.float64)
            return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([(sums / total).astype(np.float32).tobytes()], pa.binary())})

        gangs = -(-min(1 << number, shards + 1 - (1 << number)) // GANG)
        own = dealt.filter(F.col("round") == number).withColumn("gang", F.floor((F.col("shard") + 1) / GANG))
        own = own.repartition(4 * gangs, "gang")  # a fixed number: few bytes are much work here, so partitions must not be joined by size
        own = own.groupBy("gang").applyInArrow(learned, "piece int, shard long, n long, data binary")
        rows = own.groupBy("piece").applyInArrow(mean, "piece int, data binary").collect()  # one network
        if rows:
            _set_flat(net, np.stack([np.frombuffer(r["data"], np.float32) for r in sorted(rows, key=lambda r: r["piece"])]))
        start.destroy()
    drop(dealt)
    return net


def document_log_probs(net: Network, ids: np.ndarray, counts: np.ndarray, window: int = 4096, most: int = 1 << 12) -> np.ndarray:
    """Natural-log probability of each document: ids of all documents in a row, each ended by 0; counts with the ends.

    Documents advance side by side, longest first; the state of each is carried across windows to its end.  A window has at most
    ``window`` steps and about ``most`` tokens, which bounds its memory and fits the cache; the result doesn't depend on them.
    """
    n, u = net.s.hidden, net.gates()
    u2, un = u[:2], u[2]
    x = np.ascontiguousarray((net.p["x"] + net.p["b"]).reshape(-1, 3, n).transpose(1, 0, 2))
    x[:2] *= 0.5
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    total = np.zeros(len(counts))
    h = np.zeros((len(counts), n), np.float32)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")  # documents with more than t tokens
    begin = 0
    while begin < longest:
        width = int(active[begin])
        sizes = active[begin : begin + min(window, max(1, most // width))]
        there = np.arange(width) < sizes[:, None]
        who = np.broadcast_to(np.arange(width), there.shape)[there]
        at = (starts[:width] + np.arange(begin, begin + len(sizes))[:, None])[there]
        inputs = ids[at - 1]
        if not begin:
            inputs[:width] = 0
        given = np.take(x, inputs, axis=1)
        states, a = np.empty_like(given[2]), 0
        for k in sizes.tolist():
            held, gate, new, out = h[:k], given[:2, a : a + k], given[2, a : a + k], states[a : a + k]
            gate += held @ u2
            np.tanh(gate, out=gate)
            gate += 1
            new += (gate[1] * held) @ un
            np.tanh(new, out=new)
            h = np.subtract(new, held, out=out)
            h *= gate[0]
            h *= 0.5
            h += held
            a += k
        total += np.bincount(who, net.outputs(states, ids[at]), len(total))
        begin += len(sizes)
    out = np.empty(len(counts))
    out[order] = total
    return out


def _is_held_out(doc_id):
    return id_crc32(doc_id) % 7 == 2


def training_counts(docs: DataFrame) -> DataFrame:
    """(hash long, n long): occurrences of each word in docs, summed inside chunks before the shuffle; ends not included."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def flush():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

        for _, texts in batches(rows, most=1 << 20):
            h, _ = _tokens(texts)
            held.append(h)
            size += len(h)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs.

    Learns from documents whose crc32(doc_id) mod 7 is not 2.  A null or blank text is its end alone.  Without training
    documents nothing is known, N and V are 0, and both scores are still finite.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    may_learn = base.filter(~_is_held_out(F.col("doc_id")))
    counts = written(training_counts(may_learn), "counts")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_docs = may_learn.count()
    n_all, v_all = total["n"] + n_docs, total["v"] + (n_docs > 0)
    hashes, n_of = _most_frequent(counts, s.known)
    k = s.classes * s.words
    head = np.concatenate((np.array([END_HASH]), hashes[: k - 1]))
    head_n = np.concatenate(([n_docs], n_of[: k - 1]))
    rest_n, rest_v = n_all - int(head_n.sum()), v_all - len(head) + (n_docs == 0)
    in_head, in_known = Places(head), Places(hashes)
    # by place among the known words, which the network's own come first of
    known_ids = np.minimum(np.arange(1, len(hashes) + 2), k)
    known_ids[min(len(hashes), k - 1) :] = k
    known_logs = np.log10(np.append(n_of, 0) + 1.0)

    def to_ids(h: np.ndarray) -> np.ndarray:
        at = in_head(h).astype(np.int64)
        at[at == in_head.count] = k
        return at

    net = trained(may_learn, s, to_ids, head_n, rest_n, n_all)
    held = spark.sparkContext.broadcast((net.p, in_known, known_ids, known_logs))
    buckets = buckets_for(docs)

    def spread(rows: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        p, in_known, known_ids, known_logs = held.value
        net = Network.__new__(Network)
        net.s, net.p, net.k = s, p, k
        part, number = TaskContext.get().partitionId(), 0
        names = ["bucket", "kind", "chunk", "a", "b", "c", "d"]
        kinds = [pa.int32(), pa.int32(), pa.string()] + [pa.binary()] * 4
        held_rows: list[tuple] = []
        words = 0

        def flush():
            nonlocal number
            keys = [i for r in held_rows for i in r[0]]
            h, n = np.concatenate([r[1] for r in held_rows]), np.concatenate([r[2] for r in held_rows])
            chunk, number = f"{part}-{number}", number + 1
            where = in_known(h)
            ids, found = known_ids[where], where < in_known.count
            ends = np.cumsum(n)
            doc = np.repeat(np.arange(len(n)), n)
            with_ends = np.insert(ids, ends, 0)
            logs = document_log_probs(net, with_ends, n + 1) / np.log(10)
            log_c = known_logs[where]
            m = len(n)
            all_c = np.bincount(doc, log_c, m) + np.log10(n_docs + 1.0)
            other = ids == k
            rest_c = np.bincount(doc[other], log_c[other], m)
            facts = np.stack([logs, all_c, rest_c, np.bincount(doc[other], minlength=m), n + 1, np.bincount(doc[found], minlength=m) + (n_docs > 0)])
            nulls = np.array([i is None for i in keys])
            out = [(crc32(chunk.encode()) % buckets, 1, chunk, np.array([0 if i is None else i for i in keys], np.int64).tobytes(), nulls.tobytes(), facts.tobytes(), b"")]
            far = np.flatnonzero(~found)
            if len(far):
                b = (h[far] >> np.uint64(32)) % np.uint64(buckets)
                far = far[np.lexsort((h[far], doc[far], b))]
                b = ((h[far] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                new = np.concatenate(([True], (h[far][1:] != h[far][:-1]) | (doc[far][1:] != doc[far][:-1])))
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(far))).astype(np.uint32)
                far, b = far[first], b[first]
                cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
                for i, j in zip(cut, np.append(cut[1:], len(b)), strict=True):
                    out.append((int(b[i]), 0, chunk, h[far[i:j]].tobytes(), np.diff(doc[far[i:j]], prepend=0).astype(np.uint32).tobytes(), times[i:j].tobytes(), b""))
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 64], strict=True), kinds, strict=True)], names)

        for keys, texts in batches(rows, most=1 << 20):
            h, n = _tokens(texts)
            held_rows.append((keys, h, n))
            words += len(h) + len(n)
            if words >= s.chunk_words:
                yield from flush()
                held_rows, words = [], 0
        if held_rows:
            yield from flush()

    def look_up(key, table, of):
        import pyarrow as pa

        known, n = of.column("hash").to_numpy().view(np.uint64), of.column("n").to_numpy().astype(np.float64)
        order = np.argsort(known)
        known, n = known[order], n[order]
        out = []
        for kind, chunk, a, b, c in zip(*(table.column(x).to_pylist() for x in ("kind", "chunk", "a", "b", "c")), strict=True):
            if kind:
                out.append((1, chunk, a, b, c))
                continue
            h, doc, times = np.frombuffer(a, np.uint64), np.cumsum(np.frombuffer(b, np.uint32), dtype=np.int64), np.frombuffer(c, np.uint32)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            who, inverse = np.unique(doc[hit], return_inverse=True)
            out.append((0, chunk, who.astype(np.uint32).tobytes(), np.bincount(inverse, np.log10(n[at[hit]] + 1) * times[hit], len(who)).tobytes(), np.bincount(inverse, times[hit], len(who)).astype(np.uint32).tobytes()))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int32(), pa.string()] + [pa.binary()] * 3
        return pa.table({x: pa.array(v, t) for x, v, t in zip(("kind", "chunk", "a", "b", "c"), columns, kinds, strict=True)})

    def finish(key, table):
        import pyarrow as pa

        rows = list(zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True))
        ids = nulls = facts = None
        for kind, a, b, c in rows:
            if kind:
                ids, nulls = np.frombuffer(a, np.int64), np.frombuffer(b, bool)
                facts = np.frombuffer(c).reshape(6, -1).copy()
        for kind, a, b, c in rows:
            if not kind:
                at = np.frombuffer(a, np.uint32)
                facts[1, at] += np.frombuffer(b)
                facts[2, at] += np.frombuffer(b)
                facts[5, at] += np.frombuffer(c, np.uint32)
        logs, all_c, rest_c, others, tokens, known = facts
        return pa.table({
            "doc_id": pa.array(ids, mask=nulls), "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
            "base_score": pa.array(all_c - tokens * np.log10(n_all + v_all + 1.0)),
            "score": pa.array(logs + rest_c - others * np.log10(rest_n + rest_v + 1.0)),
        })

    sent = base.mapInArrow(spread, "bucket int, kind int, chunk string, a binary, b binary, c binary, d binary")
    bucket = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(buckets)).cast("int")
    sums = sent.groupBy("bucket").cogroup(counts.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(look_up, "kind int, chunk string, a binary, b binary, c binary")
    done = sums.groupBy("chunk").applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", _is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def _most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent words, at most ``most``, by falling count.

    A histogram of the counts' logarithms (64 steps to a doubling) gives the step from which up no more than ``most`` words lie.  The
    step below gives the places left, by falling hash: a second histogram, over the hash's upper bits, bounds what reaches the driver.
    """
    step = F.floor(F.log2("n") * 64).cast("int")
    steps = sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["s"])  # at most 64 * 63 rows
    total, wanted = 0, F.lit(False)
    for r in steps:
        if total + r["k"] > most:
            share = F.shiftrightunsigned("hash", 64 - 16)
            parts = sorted(counts.filter(step == r["s"]).groupBy(share.alias("h")).agg(F.count("*").alias("k")).collect(), key=lambda p: -p["h"])  # at most 65,536 rows
            room, least = most - total, None
            for p in parts:
                room -= p["k"]
                if room < 0:
                    break
                least = p["h"]
            if least is not None:
                wanted = wanted | ((step == r["s"]) & (share >= least))
            break
        total += r["k"]
        wanted = step >= r["s"]
    top = counts.filter(wanted).toArrow()
    h, n = top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((h, -n))
    return h[order], n[order]
