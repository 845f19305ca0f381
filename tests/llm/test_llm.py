"""Each training-data operator against its plain definition, and its edge cases."""

import hashlib
import math
import os
import random
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from rillstone.llm import catalog, chat, common, components, lines, lm, media, mixing, packing, simhash, substrings, topk, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def documents(seed=1, n=40):
    """Small documents with copies, near copies, shared passages, blanks, nulls and long words."""
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) for _ in range(40))
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.randrange(1, 30))) + "." for _ in range(r.randrange(1, 8)))
        if i % 5 == 0:
            text += "\n" + passage
        if i % 7 == 3 and rows:
            text = rows[r.randrange(len(rows))][1] or ""
        rows.append((i * 3 + 1, text))
    return [*rows, (1000, None), (1001, ""), (1002, " \t\n "), (1003, "x" * 30_000), (1004, "é ü ñ 漢字 \x1c word " * 30), (1005, rows[0][1]), (1006, passage + "\n" + passage)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 11 else None, 0, "clash", 1.5, b"x") for i, t in documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, starts binary").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_word_hashes():
    texts = [t.encode() for _, t in documents() if t is not None]
    h, n = common.word_hashes(texts, at_once=500)
    assert n.tolist() == [len(t.split()) for t in texts]
    words = [w for t in texts for w in t.split()]
    assert len(set(h.tolist())) == len(set(words)) and len(dict(zip(words, h.tolist()))) == len(set(words))
    assert len(common.word_hashes([])[0]) == 0


def thue_morse(n: int, flip: int = 0) -> str:
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


@pytest.mark.parametrize("n", [64, 65, 1024, 2048, 8192])
def test_long_words_of_equal_polynomial_differ(n):
    h, _ = common.word_hashes([thue_morse(n).encode(), thue_morse(n, 1).encode(), thue_morse(n).encode()])
    assert h[0] == h[2] != h[1]


def test_windows_of_long_words_that_differ_stay(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(19)) + " " + thue_morse(2048, k)) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(substrings.removed(df), "n_removed") == {0: (0,), 1: (0,)}


# ---------------------------------------------------------------- 1 chat


def test_template_is_reversible():
    r = random.Random(5)
    pieces = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "a", "assistant", "é", "<\\|"]
    for _ in range(300):
        turns = [("".join(r.choice(pieces) for _ in range(r.randrange(4))), "".join(r.choice(pieces) for _ in range(r.randrange(8)))) for _ in range(r.randrange(4))]
        text, spans = chat.formatted(turns, "a")
        assert chat.read_back(text) == turns
        assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "a"]


def test_reply_trees(spark):
    nodes = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "bad"), (1, 3, 1, 9.0, "assistant", "good"), (1, 4, 3, 8.0, "user", "more"), (1, 5, 4, None, "assistant", None), (2, 1, 99, 0.0, "user", "orphan")]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double, role string, text string")
    got = {(r["tree"], r["rank"]): (r["leaf"], r["n_turns"], r["text"]) for r in chat.conversations(df, per_root=2).collect()}
    assert got[1, 1][:2] == (5, 4) and got[1, 2][:2] == (2, 2) and got[2, 1][:2] == (1, 1)
    assert [t for _, t in chat.read_back(got[1, 1][2])] == ["q", "good", "more", ""]
    with pytest.raises(ValueError):
        chat.best_paths(spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], "tree long, node long, parent long, score double"))


def test_conversations(spark):
    rows = [(7, 2, "assistant", "<|im_end|>"), (7, 1, None, None), (None, None, "user", "x"), (7, 1, None, None), (8, 0, "assistant", "a" * 50_000)]
    rows += [(9, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.formatted_conversations(df).collect()}
    assert set(got) == {7, 8, 9, None} and got[7]["n_turns"] == 3 and got[7]["loss_chars"] == len("<|im_end|>")
    assert got[9]["loss_sha256"] == hashlib.sha256("".join(f"t{t}" for t in range(1, 70, 2)).encode()).hexdigest()
    assert chat.formatted_conversations(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 2 language model


def test_lm_scores(docs, nothing):
    s = lm.Settings(classes=4, words=4, hidden=6, known=8, chunk_words=200)
    want = brute.unigram(documents())
    got = by_id(lm.scored(docs, s), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][:4] == w[:4] and math.isclose(got[i][4], w[4], rel_tol=1e-9)
        assert math.isfinite(got[i][5]) and got[i][5] < 0
    assert lm.scored(nothing, s).count() == 0


def test_lm_learns_from_all_documents(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:5]
    held = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = random.Random(8)
    noise = [(i, " ".join(r.choice(WORDS[:4]) for _ in range(30))) for i in ids[1:]]
    rows = [(ids[0], " ".join(WORDS[:4] * 4_000)), *noise, (held, " ".join(WORDS[:4] * 50))]  # the long text is over 64 KiB
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (1 << 20, 4096):  # one shard; four shards in three rounds
        s = lm.Settings(classes=3, words=4, hidden=8, rate=0.1, window=8, streams=4, shard_tokens=shard)
        got = by_id(lm.scored(df, s), "base_score", "score")
        assert got[held][1] > 0.5 * got[held][0]  # in the log: chance of a word above its share
        again = by_id(lm.scored(df.repartition(4), s), "score")
        assert all(math.isclose(again[i][0], got[i][1], rel_tol=1e-4) for i in again)


def test_lm_is_a_distribution_and_learns():
    s = lm.Settings(classes=3, words=4, hidden=8, rate=0.1, window=8, streams=4)
    net = lm.Network(s, np.arange(12, 0, -1), 5.0)
    h = np.random.default_rng(0).standard_normal((1, 8)).astype(np.float32)
    assert abs(np.exp(net.outputs(np.repeat(h, 13, 0), np.arange(13))).sum() - 1) < 1e-5
    text = np.array([1, 2, 3, 4, 0] * 400)
    before, after = lm.Network(s, np.ones(12), 1.0), lm.train(s, [text], np.ones(12), 1.0)
    ids, n = np.array([1, 2, 3, 4, 0, 4, 3, 0]), np.array([5, 3])
    assert lm.document_log_probs(after, ids, n)[0] > lm.document_log_probs(before, ids, n)[0] + 3
    whole = lm.document_log_probs(after, np.append(np.tile([1, 2, 3, 4], 50), 0), np.array([201]), window=16)
    assert np.allclose(whole, lm.document_log_probs(after, np.append(np.tile([1, 2, 3, 4], 50), 0), np.array([201]), window=7), rtol=1e-4)


def test_lm_scores_by_plain_loops():
    """Document scores against the network's equations, a number at a time."""
    s = lm.Settings(classes=3, words=4, hidden=5)
    net = lm.train(s, [np.random.default_rng(3).integers(0, 13, 900)], np.ones(12), 2.0)
    p, n = {k: v.astype(float).tolist() for k, v in net.p.items()}, s.hidden
    squash = lambda x: 1 / (1 + math.exp(-x))

    def chance(logits, k):
        return math.exp(logits[k]) / sum(map(math.exp, logits))

    def plain(tokens):
        h, total, before = [0.0] * n, 0.0, 0
        for t in tokens:
            x = [a + b for a, b in zip(p["x"][before], p["b"])]
            rec = lambda v, j: sum(v[i] * p["u"][i][j] for i in range(n))  # noqa: E731, B023
            z, r = ([squash(x[o + j] + rec(h, o + j)) for j in range(n)] for o in (0, n))
            rh = [a * b for a, b in zip(r, h)]
            new = [math.tanh(x[2 * n + j] + rec(rh, 2 * n + j)) for j in range(n)]
            h = [a + c * (b - a) for a, b, c in zip(h, new, z)]
            c = min(t // s.words, s.classes)
            total += math.log(chance([p["bc"][k] + sum(h[i] * p["wc"][i][k] for i in range(n)) for k in range(s.classes + 1)], c))
            if c < s.classes:
                total += math.log(chance([p["bw"][c][k] + sum(h[i] * p["ww"][c][i][k] for i in range(n)) for k in range(s.words)], t - c * s.words))
            before = t
        return total

    r = np.random.default_rng(4)
    texts = [[*r.integers(1, 13, k).tolist(), 0] for k in (0, 1, 7, 40, 40)]
    got = lm.document_log_probs(net, np.concatenate(texts), np.array([len(t) for t in texts]), window=8)
    assert np.allclose(got, [plain(t) for t in texts], rtol=1e-4)


def test_lm_gradient():
    s = lm.Settings(classes=2, words=2, hidden=3, window=4)
    r = np.random.default_rng(1)
    x, y = r.integers(0, 5, (4, 2)), r.integers(0, 5, (4, 2))
    x[0] = 0

    def loss(net):
        h, total = np.zeros((2, 3), np.float32), 0.0
        for t in range(4):
            h = np.where((x[t] == 0)[:, None], np.float32(0), h)
            h, _ = net.step(x[t], h)
            total += net.outputs(h, y[t]).sum()
        return -total

    for name in ("u", "wc", "bw", "x"):
        net = lm.Network(s, np.ones(4), 1.0)
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        net.g = {k: np.full_like(v, 1e12) for k, v in net.p.items()}  # steps of rate * gradient / 1e6
        start = {k: v.copy() for k, v in net.p.items()}
        net.learn(x, y, np.zeros((2, 3)))
        step = (start[name] - net.p[name]).ravel() / s.rate * 1e6 * 2
        at = int(np.abs(step).argmax())
        for sign in (1,):
            up, down = (lm.Network(s, np.ones(4), 1.0) for _ in range(2))
            for other, d in ((up, 1e-4), (down, -1e-4)):
                other.p = {k: v.copy() for k, v in start.items()}
                other.p[name].ravel()[at] += sign * d
        assert math.isclose((loss(up) - loss(down)) / 2e-4, step[at], rel_tol=2e-2, abs_tol=1e-3)


def test_lm_networks_learn_side_by_side_as_alone():
    """Networks that share a task's loops end as each would alone, whatever their streams' lengths, in fewer calls."""
    s, r = lm.Settings(classes=20, words=3, hidden=6, window=8, streams=4), np.random.default_rng(5)
    own = [[np.zeros(1, np.uint16), np.minimum(r.zipf(1.3, n), 60).astype(np.uint16)] for n in (700, 700, 333, 40, 1, 0)]
    alone = [lm.train(s, d, np.ones(60), 1.0) for d in own]
    nets = [lm.Network(s, np.ones(60), 1.0) for _ in own]
    calls, learn = [], lm.learn
    lm.learn = lambda some, *rest: calls.append(len(some)) or learn(some, *rest)
    try:
        lm.train_apart(nets, own)
    finally:
        lm.learn = learn
    assert max(calls) == 3 and len(calls) < sum(calls)
    for a, b in zip(alone, nets, strict=True):
        assert all(np.allclose(a.p[k], b.p[k], atol=1e-5) and np.allclose(a.g[k], b.g[k], atol=1e-5) for k in a.p)
    assert not np.allclose(nets[0].p["x"], nets[1].p["x"], atol=1e-3)


def test_lm_gradient_of_rare_classes():
    """Classes multiplied together, filled up to their largest, against differences of the loss; in one window a rare class has most tokens."""
    s, r = lm.Settings(classes=20, words=3, hidden=4, window=12), np.random.default_rng(2)
    for most in (0, 50):
        x, y = r.integers(0, 61, (12, 6)), r.integers(0, 61, (12, 6))
        y.ravel()[:most] = 55
        new = lambda: lm.Network(s, np.ones(60), 1.0)
        net = new()
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        net.g = {k: np.full_like(v, 1e12) for k, v in net.p.items()}
        start = {k: v.copy() for k, v in net.p.items()}

        def loss(p):
            other = new()
            other.p = p
            h, total = np.zeros((6, 4)), 0.0
            for t in range(12):
                h, _ = other.step(x[t], np.where((x[t] == 0)[:, None], 0.0, h))
                total += other.outputs(h, y[t]).sum()
            return -total

        net.learn(x, y, np.zeros((6, 4)))
        for name in ("ww", "bw", "wc", "bc", "u", "b", "x"):
            step = (start[name] - net.p[name]).ravel() / s.rate * 1e6 * 6
            for at in np.argsort(-np.abs(step))[[0, 5, 11]] if step.size > 11 else [0]:
                ends = []
                for d in (1e-4, -1e-4):
                    p = {k: v.copy() for k, v in start.items()}
                    p[name].ravel()[at] += d
                    ends.append(loss(p))
                slope = max(-6.0, min(6.0, (ends[0] - ends[1]) / 2e-4))  # gradients of the mean over 6 streams are cut at 1
                assert math.isclose(slope, step[at], rel_tol=2e-2, abs_tol=2e-3), (most, name)


def test_lm_places_sums_and_large_logits():
    r = np.random.default_rng(6)
    for n in (0, 1, 5, 3000):
        keys = r.integers(1, 1 << 63, n).astype(np.uint64)
        if n > 2:
            keys[:3] = keys[2] + np.arange(3, dtype=np.uint64)  # one slot for three
            keys[4] = lm.END_HASH
        h = np.concatenate((keys, r.integers(1, 1 << 63, 500).astype(np.uint64), [np.uint64(0)]))
        where = {int(k): i for i, k in enumerate(keys)}
        assert lm.Places(keys)(h).tolist() == [where.get(int(x), n) for x in h]
    ids, x = np.minimum(r.zipf(1.4, 900), 80), r.standard_normal((900, 3))
    want = np.zeros((81, 3))
    np.add.at(want, ids, x)
    rows, sums = lm._row_sums(x, ids, 81)
    assert sorted(rows.tolist()) == np.unique(ids).tolist() and np.allclose(sums, want[rows])
    logits = np.array([[900.0, 880.0, 0.0], [-900.0, -901.0, -902.0]], np.float32)
    assert np.allclose(lm._softmax(logits, np.array([1, 0]))[0], [-20.0, -0.40760596], atol=1e-4)


# ---------------------------------------------------------------- 3 packing


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    vocabulary, ranks = packing.vocabulary_files()
    fast, slow = packing.Tokens(vocabulary, ranks), Tokenizer.from_file(vocabulary)
    for text in [t or "" for _, t in documents()] + ["it's we'll  x\n\n y\t 12½ ²", "<|endoftext|> a", "a​b", "...  !!", "Ελλάδα"]:
        assert np.frombuffer(fast(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids


def test_cutting_stock_is_close_to_the_bound():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 500, 20_000):
        demand = np.bincount(r.integers(1, 33, n), minlength=33)[1:]
        plan = packing.cutting_stock(demand, 32)
        assert (plan.patterns.T @ plan.times == demand).all()
        assert n == 0 or (plan.patterns @ np.arange(1, 33)).max() <= 32
        assert plan.times.sum() <= math.ceil((demand * np.arange(1, 33)).sum() / 32) * 1.02 + 12
        places = packing.Places(plan)
        seen = {(int(s), int(k)) for c in np.flatnonzero(demand) + 1 for s, k in zip(*places(int(c), np.arange(demand[c - 1])), strict=True)}
        assert len(seen) == n


def test_packed(docs, nothing):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.vocabulary_files()[0])
    rows = packing.packed(docs, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in documents():
        joined = [x for _, ids, _ in sorted(pieces[i]) for x in ids]
        assert joined == [*slow.encode(t or "", add_special_tokens=False).ids, 1] and pieces[i][0][2] == len(joined)
    for placed in sequences.values():
        end = 0
        for offset, n in sorted(placed):
            assert offset == end
            end += n
        assert end <= 2048
    bins = []  # first fit by falling length
    for n in sorted((x for placed in sequences.values() for _, x in placed), reverse=True):
        k = next((k for k, b in enumerate(bins) if b + n <= 2048), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    assert len(sequences) <= 1.05 * len(bins) + 2
    assert packing.packed(nothing).count() == 0
    assert packing.packed(docs.union(docs)).count() == 2 * len(rows)


# ---------------------------------------------------------------- 4 substrings


@pytest.mark.parametrize("wide", [False, True])
def test_substrings(docs, wide):
    want = brute.substring_dedup(documents(), 20)
    got = by_id(substrings.removed(docs, 20, buckets=5, wide=wide), "n_words", "n_removed", "kept_sha256")
    assert got == want and any(w[1] for w in want.values())


def test_substring_chunks_and_repeats(docs, nothing, spark):
    small = substrings.repeated_windows(docs, 5, buckets=3, chunk_words=60).count()
    assert small > 0 and substrings.removed(nothing).count() == 0
    twice = substrings.removed(docs.union(docs), 20, buckets=5)
    assert {(r["doc_id"], r["n_removed"]) for r in twice.collect()} == {(i, v[1]) for i, v in brute.substring_dedup(documents(), 20).items()}
    hot = [(i, " ".join(f"w{k}" for k in range(25))) for i in range(300)]
    got = by_id(substrings.removed(spark.createDataFrame(hot, "doc_id long, text string").repartition(5), 20, buckets=4), "n_removed")
    assert got.pop(0) == (0,) and set(got.values()) == {(25,)}
    spans = substrings.covered(np.array([0, 3, 30]), 60, 20)[1]
    assert spans == [(0, 23), (30, 50)]


# ---------------------------------------------------------------- 5 mixing


def test_mixture(docs, nothing, spark):
    rows = mixing.mixture(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    targets = {s: v[0]["target"] for s, v in by.items()}
    assert math.isclose(sum(targets.values()), total, rel_tol=1e-9) and all(t <= 3 * by[s][0]["source_size"] + 1e-6 for s, t in targets.items())
    order = sorted((s for s in by if s is not None)) + [None]
    share = [targets[s] / w for s, w in zip(order, (5, 2, 1, 5), strict=True) if targets[s] < 3 * by[s][0]["source_size"] - 1e-6]
    assert max(share) - min(share) < 1e-6
    assert [r["position"] for r in rows if r["position"] is not None] == sorted(r["position"] for r in rows if r["position"] is not None)
    assert mixing.mixture(nothing).count() == 0
    assert sorted(map(tuple, mixing.mixture(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows if r["size"])
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {r["taken"] for r in mixing.mixture(blank).collect()} == {0}


# ---------------------------------------------------------------- 6 SimHash


def test_near_duplicates(docs, nothing):
    rows = documents()
    prints = [brute.simhash(t) for _, t in rows]
    want = brute.components([i for i, _ in rows], prints, 3)
    got = by_id(simhash.near_duplicates(docs), "fingerprint", "component_id")
    assert got == {i: (f"{p:016x}", want[i]) for (i, _), p in zip(rows, prints, strict=True)}
    assert got[1000][1] == got[1001][1] == got[1002][1] == 1000
    assert simhash.near_duplicates(nothing).count() == 0


def near_copies(seed=3, families=12, length=150):
    """Families: a document, copies of it with a few words changed, copies of copies; between them strangers, one passage in all."""
    r = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(5000)]
    passage = [r.choice(vocabulary) for _ in range(20)]
    rows, i = {}, 0
    for _ in range(families):
        first = [*passage, *(r.choice(vocabulary) for _ in range(length))]
        members = [first]
        for _ in range(r.randrange(1, 8)):
            w = list(r.choice(members))
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            members.append(w)
        for w in members:
            rows[i] = " ".join(w).title() if i % 3 == 0 else " ".join(w)
            i += 1
    return rows


def test_keep_one(docs, nothing, spark):
    want = set(brute.similar(dict(documents())).values())
    kept = simhash.keep_one(docs.union(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert simhash.keep_one(nothing).count() == 0
    rows = near_copies()
    want = brute.similar(rows)
    assert len(set(want.values())) < len(rows) - 10
    df = spark.createDataFrame([(i, t, f"k{i}", i, 0.5) for i, t in rows.items()] + [(None, rows[0], "n", 1, None), (None, None, "n", 2, None)], "doc_id long, text string, _kept_id string, kept long, score double")
    for together in (64, 3):  # under 3 the families go through hubs
        got = {r["doc_id"]: r["_kept_id"] for r in simhash.keep_one(df.repartition(4), together=together).collect() if r["doc_id"] is not None}
        assert set(got) == set(want.values()) and all(v == f"k{i}" for i, v in got.items())
    assert simhash.keep_one(df).filter("doc_id is null").count() == 2


def test_keep_one_finds_links_past_the_hubs(spark):
    """Chains of copies whose ends are far apart, and many strangers around one passage: every key goes through a hub."""
    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(4000)]
    rows, passage = {}, [r.choice(vocabulary) for _ in range(60)]
    for chain in range(6):
        w = [*passage, *(r.choice(vocabulary) for _ in range(60))]
        for k in range(14):
            rows[chain * 100 + (k * 5) % 14] = " ".join(w)
            for _ in range(2):
                w[r.randrange(60, len(w))] = r.choice(vocabulary)
            w = list(w)
    for k in range(80):
        rows[1000 + k] = " ".join([*passage, *(r.choice(vocabulary) for _ in range(r.randrange(3, 40)))])
    want = set(brute.similar(rows).values())
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    for block in (1 << 15, 10):  # cells of over 10 documents are split into pairs of blocks
        kept = {x["doc_id"] for x in simhash.keep_one(df, together=1, block=block).collect()}
        assert kept == want


def test_possible_pairs_lose_nothing():
    r = np.random.default_rng(11)
    base = [np.unique(r.integers(0, 1 << 64, int(k), np.uint64)) for k in r.integers(1, 400, 60)]
    sets = base + [np.unique(np.concatenate((x[: max(1, int(len(x) * r.uniform(0.75, 1)))], r.integers(0, 1 << 64, len(x) // 15, np.uint64)))) for x in base]
    bits = np.frombuffer(b"".join(map(simhash.parity_bits, sets)), np.uint64).reshape(len(sets), -1)
    mark = np.arange(len(sets)) // 2 * 2
    a, b = simhash.possible_pairs(np.array([len(x) for x in sets]), bits, mark, 0.8, step=7)
    got = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert len(got) == len(a) and len(got) < len(sets) ** 2 / 8
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(x, sets[j]))
            if mark[i] != mark[j] and both >= 0.8 * (len(x) + len(sets[j]) - both):
                assert (i, j) in got


def test_prefixes_share_an_element():
    r = random.Random(1)
    for _ in range(300):
        a = set(r.sample(range(60), r.randrange(1, 40)))
        b = (a - set(r.sample(sorted(a), len(a) // 9))) | {r.randrange(60) for _ in range(r.randrange(4))}
        if len(a & b) >= 0.8 * len(a | b):
            assert set(sorted(a)[: simhash.prefix_length(len(a), 0.8)]) & set(sorted(b)[: simhash.prefix_length(len(b), 0.8)])


def test_pivot_table_discards_and_loses_nothing():
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 64, 400, np.uint64)
    flips = np.array([sum(1 << int(k) for k in r.choice(64, r.integers(0, 9), replace=False)) for _ in base], np.uint64)
    fps = np.concatenate((base, base ^ flips))
    table = simhash.pivot_table(fps)
    assert (table.sum(1) == np.bitwise_count(fps[:, None] ^ simhash.REFERENCES)).all()
    a, b = (x.ravel() for x in np.meshgrid(np.arange(800), np.arange(800)))
    gone, distance = simhash.discarded(a, b, table, 3), np.bitwise_count(fps[a] ^ fps[b])
    assert not (gone & (distance <= 3)).any() and gone[distance > 3].mean() > 0.99
    at, key = simhash.cells(fps, 3, 6)
    order = np.argsort(key, kind="stable")
    x, y, n = simhash.cell_links(fps[at][order], key[order], 3, 6)
    want = {(min(p, q), max(p, q)) for p, q in zip(fps[a].tolist(), fps[b].tolist(), strict=True) if p != q and (p ^ q).bit_count() <= 3}
    assert {(min(p, q), max(p, q)) for p, q in zip(x.tolist(), y.tolist(), strict=True) if p != q} == want and n > 0
    i, j, n = simhash.links(np.unique(fps), 3)
    assert len(i) == len(want) and n > 0  # pairs of a base and its copy: each link is in the forest


def test_near_duplicates_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None), (2, "a b c"), (-(2**63), "x y z w")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2), (None, None), (2, 2), (-(2**63), -(2**63))], key=repr)


def test_links_of_many_near_fingerprints(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 6, np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(150):  # chains and clouds around each
            x ^= sum(1 << int(k) for k in r.choice(64, r.integers(1, 6), replace=False))
            fps.add(x)
    fps = sorted(fps)
    want = brute.components(fps, fps, 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    labels = {r["a"]: r["b"] for r in components.component_labels(simhash.fingerprint_links(df)).collect()}
    groups = {}
    for f, s in zip(fps, signed, strict=True):
        groups.setdefault(want[f], set()).add(labels.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 400)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["a"]: r["b"] for r in components.component_labels(df).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 400)}
    assert components.component_labels(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 7 lines


def test_line_dedup(docs, nothing, spark):
    want = brute.line_dedup(documents())
    out = lines.without_repeats(docs, buckets=3)
    assert out.columns == docs.columns
    got = by_id(out, "text")
    assert {i: t or "" for i, (t,) in got.items()} == want and got[1000] == (None,)
    assert by_id(lines.line_report(docs), "kept_sha256") == {i: (lines.digest(t),) for i, t in want.items()}
    assert lines.without_repeats(nothing).count() == 0 and lines.line_report(nothing).count() == 0
    r = random.Random(3)
    shared = "\n".join(f"shared {r.random()}" for _ in range(40))
    a, b = (1, shared), (2, "other start\n" + shared + "\nother end")
    report = by_id(lines.line_report(spark.createDataFrame([a, b], "doc_id long, text string")), "n_removed_lines")
    few = lines.repeated_chunks(docs, buckets=2, together=300, most=2)  # many batches, results in pieces
    whole = lines.repeated_chunks(docs, buckets=1)
    marks = lambda df: {(r["doc_id"], *t) for r in df.collect() for t in np.frombuffer(r["found"], np.int64).reshape(-1, 3).tolist()}
    assert marks(few) == marks(whole) and few.count() > few.select("doc_id").distinct().count()
    assert report[1] == (0,) and report[2][0] >= 38  # boundaries fall into step after the inserted line


def test_chunk_bounds_by_the_definition():
    for _, t in [*documents(), (0, "same\n" * 100), (1, "a\nb\n" * 9)]:
        own = (t or "").encode().split(b"\n")
        assert lines.chunk_bounds(own) == brute.chunk_ends(own)


def test_short_passages_between_other_lines_go(spark):
    """Passages of 2 to 6 lines inside other text, blank lines around them, lines repeated in one text, and single lines that stay."""
    r = random.Random(5)
    line = lambda: f"line {r.random()} {r.random()}"
    passages, single, rows = [[line() for _ in range(n)] for n in range(2, 7) for _ in range(40)], line(), []
    for i in range(2):
        for k, p in enumerate(passages):
            rows.append((1000 * i + k, "\n".join([line(), "", single, line(), *p[:1], "  ", *p[1:], line()])))
    rows += [(3000, "same\n" * 50), (3001, "\n\n"), (3002, single), (3003, f"{single}\n{single}\n{single}")]
    want = brute.line_dedup(rows)
    out = by_id(lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), buckets=4), "text")
    assert {i: t for i, (t,) in out.items()} == want
    assert all(want[i] == t for i, t in rows if i < 1000)
    lost = [sum(x not in want[1000 + k] for x in p) / len(p) for k, p in enumerate(passages)]
    assert sum(lost[:40]) / 40 > 0.6 and sum(lost[40:]) / 160 > 0.8
    assert all(single in want[1000 + k] for k in range(200)) and want[3002] == single


def test_line_dedup_keeps_columns_rows_and_odd_bytes(spark):
    r = random.Random(12)
    shared = "\n".join(f"line {r.random()}" for _ in range(30))
    rows = [(1, shared, "a", 1, 2.5), (2, "x\n" + shared, "b", 2, None), (2, "x\n" + shared, "b", 2, None), (None, shared, None, 3, 0.0), (3, "é" * 400_000 + "\n" + shared, "c", 4, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _ends int, _doc_key double").withColumn("n_chars", F.length("text"))
    out = lines.without_repeats(df, buckets=2)
    got = sorted((r["_ends"], r["_key"], r["_doc_key"], r["n_chars"] == len(r["text"])) for r in out.collect())
    assert out.columns == df.columns and [g[0] for g in got] == [1, 2, 2, 3, 4] and all(g[3] for g in got) and got[0][1:3] == ("a", 2.5)
    texts = {r["_ends"]: r["text"] for r in out.collect()}
    assert texts[3] == shared and len(texts[1]) < len(shared) / 2  # a null id counts as the smallest
    odd = df.withColumn("text", F.decode(F.encode("text", "utf-8"), "utf-8")).union(df.select(F.lit(9).cast("long"), F.expr("cast(X'ff0a41' as string)"), "_key", "_ends", "_doc_key", "n_chars").limit(1))
    assert lines.without_repeats(odd).count() == 6 and packing.packed(odd.select("doc_id", "text")).count() > 0


# ---------------------------------------------------------------- 8 top-k


def test_top_k(spark):
    r = np.random.default_rng(4)
    vectors = {i: (r.standard_normal(6) * r.choice([0.1, 1, 5])).tolist() for i in range(0, 400)}
    vectors |= {3: None, 10: [float("nan")] * 6, 20: [1.0, None, 0.0, 0.0, 0.0, 0.0], 30: [], 40: [1.0, 2.0], 50: [3.0, 4.0], 60: vectors[70], 80: vectors[70], 90: [0.0] * 6}
    df = spark.createDataFrame([(i, v, "clash") for i, v in vectors.items()], "vec_id long, embedding array<double>, norm string")
    got = sorted(map(tuple, topk.top_k(df.union(df.limit(5)), lambda i: F.pmod(i, F.lit(10)) == 0, block=64, run_blocks=2).collect()))
    assert got == sorted(brute.top_k(vectors, [i for i in vectors if i % 10 == 0], 5))
    assert topk.top_k(df.limit(0), lambda i: i == 0).count() == 0


def test_top_k_of_repeated_rows(spark):
    vectors = {i: [float(i), 1.0] for i in range(40)}
    rows = [*vectors.items(), *[(39, vectors[39])] * 50, *[(38, vectors[38])] * 7]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, lambda i: F.pmod(i, F.lit(10)) == 0).collect()))
    assert got == sorted(brute.top_k(vectors, [0, 10, 20, 30], 5))


def test_top_k_of_large_components(spark):
    vectors = {0: [2.0**40, 2.0**20], 1: [2.0**13, -(2.0**50) + 2.0**5], 2: [-(2.0**14), 1.0], 3: [3.0, 2.0**33 + 1]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, lambda i: i == 0).collect()
    vectors = {0: [2.0**30, 1.0], 1: [2.0**14, 5.0], 2: [1.0, 2.0**44 + 2.0**-7], 3: [-(2.0**14), 2.0**44]}  # the products fit, their bound doesn't
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, lambda i: i == 0).collect())) == sorted(brute.top_k(vectors, [0], 5))
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e18]), (1, [1.0])], "vec_id long, embedding array<double>"), lambda i: i == 0).collect()


def test_short_runs_are_not_sent():
    r = np.random.default_rng(9)
    m = (r.standard_normal((2000, 8)) * np.geomspace(100_000, 100, 2000)[:, None]).astype(np.int64)
    norms = np.sqrt((m.astype(float) ** 2).sum(1))
    order = np.argsort(-norms)
    blocks = [(norms[order[a]], order[a : a + 100], m[order[a : a + 100]]) for a in range(0, 2000, 100)]
    asked = np.arange(0, 2000, 100)
    first, _ = topk.search_block(m[asked], asked, blocks[:4], np.eye(8), 5)
    rest, verified = topk.search_block(m[asked], asked, blocks[4:], np.eye(8), 5, floors=first.floor())
    assert verified < len(asked) * 1600 / 10
    for q, i in enumerate(asked):
        s = m @ m[i]
        want = sorted((-s[j], j) for j in range(2000) if j != i)[:5]
        both = sorted({(-a, b) for best in (first, rest) for a, b, on in zip(best.scores[q], best.ids[q], best.filled[q], strict=True) if on})[:5]
        assert both == want


def test_pruning_drops_pairs_but_no_result():
    r = np.random.default_rng(5)
    m = (r.standard_normal((3000, 16)) * np.geomspace(8, 0.1, 16) * 256).astype(np.int64)
    norms = np.sqrt((m.astype(float) ** 2).sum(1))
    order = np.argsort(-norms)
    blocks = [(norms[order[k]], order[k : k + 200], m[order[k : k + 200]]) for k in range(0, 3000, 200)]
    turn = np.linalg.eigh(m.T.astype(float) @ m.astype(float))[1][:, ::-1]
    best, verified = topk.search_block(m[:50], np.arange(50), blocks, turn, 5)
    assert verified < 50 * 3000 / 3
    for q in range(50):
        s = m @ m[q]
        want = sorted(((-s[i], i) for i in range(3000) if i != q))[:5]
        assert [(-a, b) for a, b in zip(best.scores[q], best.ids[q], strict=True)] == want


# ---------------------------------------------------------------- 9 media


def test_media(docs, nothing):
    got = by_id(media.stored_texts(docs), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    for i, t in documents():
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        stored = media.to_wav(payload)
        assert got[i] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert media.stored_texts(nothing).count() == 0


def test_media_by_the_standard_library(docs):
    import io
    import wave

    got = by_id(media.stored_texts(docs), "media_sha256", "media_bytes", "feature")
    for i, t in documents():
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        stored = out.getvalue()
        counts = [payload.count(bytes([k])) for k in range(256)]
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
        want = f"wav8:frames={len(payload) // 192};mean={sum(payload) * 1000 // len(payload)};crossings={crossings};mode={counts.index(max(counts))};"
        assert got[i][:2] == (hashlib.sha256(stored).hexdigest(), len(stored)) and got[i][2].startswith(want)


def test_sniffing(spark):
    import gzip
    import io
    import struct
    import zipfile

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd12\xff\x00\xff\xd9"
    pdf = b"%PDF-1.4\nstartxref\n0\n%%EOF"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b" * 100)
    files = {"image/png": png, "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "application/pdf": pdf, "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"hello"), "audio/wav": media.to_wav(b"abc")}
    for kind, data in files.items():
        found, _ = media.sniff(b"junk" + data + b"tail")
        assert found == [media.Found(kind, 4, len(data))], kind
        assert media.detected_type(data, "image/png") == kind
        assert not media.sniff(data[:-3])[0] or kind == "application/zip"
    assert media.sniff(b"BM GIF89a RIFF \x89PNG")[0] == [] and media.detected_type(b"BM", "text/plain") == "text/plain"
    rows = [("1", bytearray(png + gif), "image/gif"), ("2", None, None), ("3", bytearray(b"x"), "image/png")]
    df = spark.createDataFrame(rows, "id string, body binary, declared string").withColumn("type", F.lit("clash"))
    got = sorted((r["id"], r["declared_type"], r["detected_type"], r["type"], r["offset"]) for r in media.sniff_column(df, "id", "body", "declared").filter("type is not null").collect())
    assert got == [("1", "image/gif", "image/png", "image/gif", len(png)), ("1", "image/gif", "image/png", "image/png", 0)]


# ---------------------------------------------------------------- 10 toxicity


def test_toxicity_finds_planted_words(spark):
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, marks = [], []
    for i in range(1500):
        words = [r.choice(vocabulary) for _ in range(r.randrange(20, 200))]
        bad = i % 5 == 0
        if bad:
            for w in r.sample(["grobb", "snark", "vile"], 2):
                words.insert(r.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    rows += [(5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame(marks + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    got = by_id(toxicity.held_out_scores(docs, labels), "held_out", "score", "predicted")
    held = [i for i, (h, _, _) in got.items() if h and i < 5000]
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, (h, _, _) in got.items())
    hits = [got[i][2] for i in held if i % 5 == 0]
    assert sum(hits) / len(hits) > 0.9 and sum(got[i][2] for i in held if i % 5) <= 0.01 * len(held)
    assert 0 <= got[5000][1] == got[5001][1] <= 1
    own = docs.withColumn("predicted", F.col("doc_id") * 2)
    kept = toxicity.without_toxic(own, labels)
    left = {r["doc_id"]: (r["score"], r["predicted"]) for r in kept.collect()}
    assert kept.schema == own.schema and 0 < len(left) < docs.count() and all(v == ("clash", 2 * i) for i, v in left.items())
    again = toxicity.training_rows(docs.union(docs), labels, toxicity.Settings())
    assert again == toxicity.training_rows(docs, labels, toxicity.Settings())  # an id that rows repeat teaches once
    assert toxicity.held_out_scores(docs.limit(0), labels).count() == 0
    assert toxicity.held_out_scores(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_by_plain_ftrl(spark):
    """The same model over word tuples in dictionaries, without hashes or arrays."""
    r = random.Random(11)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 25)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("zeta eta" in t or i % 9 == 0)) for i, t in rows], "doc_id long, toxic int")
    s = toxicity.Settings(l1=0.3)

    def tuples(text):
        w = text.lower().split()
        return {(x,) for x in w} | set(zip(w, w[1:])) | {(a, "*", b) for a, b in zip(w, w[2:])}

    z, n = {}, {}

    def weight(x):
        zx, nx = z.get(x, 0.0), n.get(x, 0.0)
        l1 = 0.0 if x == "bias" else s.l1
        return 0.0 if abs(zx) <= l1 else (math.copysign(l1, zx) - zx) / ((s.beta + math.sqrt(nx)) / s.alpha + s.l2)

    chance = lambda xs: 1 / (1 + math.exp(-sum(weight(x) for x in xs) - weight("bias")))
    taught = toxicity.training_rows(docs, labels, s, lambda c: common.id_crc32(c) % 4 != 2)
    assert sorted(t.decode() for t, _ in taught) == sorted(t for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    for _ in range(s.epochs):
        for text, y in taught:
            xs = [*tuples(text.decode()), "bias"]
            g = chance(xs[:-1]) - y
            for x, w in [(x, weight(x)) for x in xs]:
                old = n.get(x, 0.0)
                z[x] = z.get(x, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha * w
                n[x] = old + g * g
    got = by_id(toxicity.held_out_scores(docs, labels, s), "score")
    assert all(math.isclose(got[i][0], chance(tuples(t)), abs_tol=2e-5) for i, t in rows)


def test_toxicity_skips_texts_that_do_not_fit(spark):
    rows = [(i, f"word{i} " * (1000 if i % 7 == 3 else 2)) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, toxicity.Settings(most_bytes=1000))
    assert sorted(t.decode() for t, _ in got) == sorted(t for i, t in rows if i % 7 != 3)
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == toxicity.without_toxic(docs, labels, toxicity.Settings(most_bytes=1)).count() == 24


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    df, result = catalog.QUERIES[name](spark, SF), db.execute(catalog.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    round_ = lambda rows: sorted((tuple(float(f"{x:.12g}") if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert round_([tuple(r[c] for c in columns) for r in df.collect()]) == round_(result.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == names
        seen[name] = docs
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    kept = {r["doc_id"]: r["text"] for r in seen["toxicity"].collect()}
    assert set(before) - set(kept) <= toxic  # clean documents stay
    cut = {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()}
    assert cut == brute.line_dedup(sorted(kept.items()))
    want = set(brute.similar(cut).values())
    near = {r["doc_id"]: r["text"] for r in seen["near_dedup"].collect()}
    assert set(near) == want and all(near[i] == cut[i] for i in near)
    mixed = [r["doc_id"] for r in seen["mixing"].collect()]
    assert set(mixed) <= set(near) and max(mixed.count(i) for i in set(mixed)) <= 3
    packed = seen["packing"].collect()
    assert sum(r["start"] == 0 for r in packed) == len(mixed)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
