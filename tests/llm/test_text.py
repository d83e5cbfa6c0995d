"""Tokenisation, classifier, language model, mixing, resharding, chats."""

import json
import math
import random

import numpy as np
import pytest

from candlewright.llm import chat, hmm_lm, mixing, quality, resharding, sentencepieces

DOCS = "doc_id long, text string, source string"


# SentencePiece
def brute_encode(a, text):
    """Quadratic Viterbi over all pieces."""
    s = b" " + text.encode()
    by = {}
    for i, (p, score, t) in enumerate(a.pieces):
        if t == 1:
            by.setdefault(p.replace("▁", " ").encode(), score)
    best = [0.0] + [-math.inf] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - 64), e):
            if s[b:e] in by and best[b] + by[s[b:e]] > best[e]:
                best[e] = best[b] + by[s[b:e]]
        if e == len(s) or (s[e] & 0xC0) != 0x80:
            b = e - 1
            while (s[b] & 0xC0) == 0x80:
                b -= 1
            best[e] = max(best[e], best[b] + a.unknown)
    return best[-1]


TEXTS = ["Hello world, this is a test", "  two  spaces ", "tab\tand\nline", "naïve café ÜBER", "日本語 テキスト 🎉🎉", "▁literal ▁▁", "", "a" * 500, "x" + "́" * 20]


def test_sentencepiece_scores_and_round_trip():
    a = sentencepieces.Automaton.of(sentencepieces.load())
    for t in TEXTS:
        d = np.frombuffer(t.encode(), np.uint8)
        ids, off = a.encode(d, np.array([0, len(d)]))
        back, _ = a.decode(ids, off)
        assert back.tobytes().decode() == t
        if t and "▁" not in t:
            buf = np.frombuffer(b" " + t.encode(), np.uint8)
            _, _, score = a.solve(buf, np.array([0]), np.array([len(buf)]))
            assert score[0] == pytest.approx(brute_encode(a, t))


def test_sentencepiece_units_equal_whole_texts():
    """Solving unit by unit gives the same score as solving the text at once."""
    a = sentencepieces.Automaton.of(sentencepieces.load())
    score = {i: s for i, (_, s, _) in enumerate(a.pieces)}
    t = "the quick brown fox jumps over the lazy dog. the end"
    d = np.frombuffer(t.encode(), np.uint8)
    ids, _ = a.encode(d, np.array([0, len(d)]))
    assert sum(score[int(i)] for i in ids) == pytest.approx(brute_encode(a, t))


def test_sentencepiece_long_units_equal_lockstep():
    a = sentencepieces.Automaton.of(sentencepieces.load())
    rng = random.Random(4)
    raw = [" " + "".join(rng.choice("abcdefé日本🎉") for _ in range(n)) for n in (3, 700, 90, 1500, 260)]
    buf = np.frombuffer("".join(raw).encode(), np.uint8)
    size = np.array([len(r.encode()) for r in raw])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    for x, y in zip(a.solve(buf, start, size), a.solve(buf, start, size, 1 << 30), strict=True):
        assert np.array_equal(x, y)


def test_sentencepiece_very_long_text_without_spaces(spark):
    import time

    t = "データ処理9f" * 40_000
    df = spark.createDataFrame([(1, t, 5), (2, None, 6)], "doc_id long, text string, tokens int")
    began = time.time()
    e = sentencepieces.encode(df, intact="ok")
    assert e.columns == ["doc_id", "text", "tokens", "ok"] and {r["doc_id"]: r["ok"] for r in e.collect()} == {1: True, 2: None} and time.time() - began < 30
    back = sentencepieces.decode(e)
    assert back.columns == ["doc_id", "tokens", "ok", "text"] and {r["doc_id"]: r["text"] for r in back.collect()} == {1: t, 2: None}


def test_sentencepiece_frames(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(98, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "ids")
    e = sentencepieces.encode(df, intact="ok")
    got = e.collect()
    assert all(r["ok"] for r in got if r["text"] is not None) and [r["tokens"] for r in got if r["text"] is None] == [None]
    back = sentencepieces.decode(e.select("ids", "tokens")).collect()
    assert {r["ids"]: r["text"] for r in back} == {i: t for i, t in rows}
    assert sentencepieces.encode(df.limit(0)).count() == 0


# quality classifier
def labelled(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        y = i % 4
        w = [rng.choice("alpha beta gamma delta house tree river cloud".split()) for _ in range(60)]
        if y == 1:
            w = [x.upper() + "!!" for x in w]
        if y == 2:
            for j in range(0, 60, 12):
                w[j] = "nasty"
        docs.append((i, " ".join(w), "s"))
        labels.append((i, 0 if y == 1 else 1, 1 if y == 2 else 0))
    return docs, labels


def test_quality_held_out_accuracy(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, lab).collect()}
    truth = {i: q == 1 and t == 0 for i, q, t in labels}
    assert np.mean([got[i]["accepted"] == truth[i] for i in range(300, 400)]) > 0.95
    r = got[350]
    assert r["p_clean"] + r["p_low"] + r["p_toxic"] == pytest.approx(1)


def test_quality_scores_are_those_of_the_vectors():
    docs, labels = labelled(60)
    bags = [quality.bag(t.encode()) for _, t, _ in docs]
    m = quality.Model().fit(bags, np.array([i % 3 for i in range(60)]))
    tab, bias = m.table()
    for _, t, _ in docs[:5]:
        f = quality.features(t.encode())
        z = m.vectors[f].mean(0) * quality.SCALE @ m.out + m.bias
        p = np.exp(z - z.max())
        d = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(quality.score_block(d, np.array([0, len(d)]), tab, bias, m.bits)[0], p / p.sum(), atol=1e-4)


def test_quality_training_equals_plain_descent():
    """fit against the same steps written out word by word."""
    docs, labels = labelled(24)
    bits, dim, rate, epochs, batch = 6, 2, 0.3, 3, 5
    y = np.array([i % 3 for i in range(24)])
    bags = [quality.bag(t.encode(), bits) for _, t, _ in docs]
    m = quality.Model(bits, dim).fit(bags, y, epochs, rate, batch)
    w = quality.Model(bits, dim)
    v, o, c = w.vectors.tolist(), w.out.tolist(), w.bias.tolist()
    sv, so, sc = [1e-6] * (1 << bits), [[1e-6] * 3 for _ in range(dim)], [1e-6] * 3
    weight = [1 / math.sqrt(max(sum(y == k), 1) / 24) for k in range(3)]
    rng, done, total = np.random.default_rng(7), 0, epochs * 5
    for _ in range(epochs):
        order = rng.permutation(24)
        for at in range(0, 24, batch):
            step, done = rate * max(0.05, 1 - done / total), done + 1
            pick = order[at : at + batch]
            gv, go, gc = {}, [[0.0] * 3 for _ in range(dim)], [0.0] * 3
            for i in pick:
                share = {int(b): int(n) / int(bags[i][1].sum()) for b, n in zip(*bags[i], strict=True)}
                x = [64.0 * sum(v[b][k] * q for b, q in share.items()) for k in range(dim)]
                z = [sum(x[k] * o[k][j] for k in range(dim)) + c[j] for j in range(3)]
                e = [math.exp(q - max(z)) for q in z]
                d = [(e[j] / sum(e) - (j == y[i])) * weight[y[i]] / len(pick) for j in range(3)]
                for j in range(3):
                    gc[j] += d[j]
                    for k in range(dim):
                        go[k][j] += x[k] * d[j]
                for b, q in share.items():
                    g = gv.setdefault(b, [0.0] * dim)
                    for k in range(dim):
                        g[k] += 64.0 * q * sum(d[j] * o[k][j] for j in range(3))
            for b, g in gv.items():
                sv[b] += sum(q * q for q in g) / dim
                for k in range(dim):
                    v[b][k] -= step * g[k] / math.sqrt(sv[b])
            for j in range(3):
                sc[j] += gc[j] ** 2
                c[j] -= step * gc[j] / math.sqrt(sc[j])
                for k in range(dim):
                    so[k][j] += go[k][j] ** 2
                    o[k][j] -= step * go[k][j] / math.sqrt(so[k][j])
    assert np.allclose(m.vectors, v, atol=1e-9) and np.allclose(m.out, o, atol=1e-9) and np.allclose(m.bias, c, atol=1e-9)


def test_quality_counts_have_no_cap():
    b, n = quality.bag(b"x " * 100_000)
    assert n.max() == 100_000 and quality.bag(b"")[0].size == 0


def test_quality_edges(spark):
    docs, labels = labelled(80)
    df = spark.createDataFrame([*docs, (500, None, "s"), (501, "", "s"), (None, docs[0][1], "s"), docs[0]], DOCS).withColumnRenamed("source", "p")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.accepted(df, lab)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == df.columns and 500 in ids and 501 in ids and ids.count(0) in (0, 2)
    assert quality.classify(df.limit(0), lab).count() == 0
    assert quality.classify(df, lab.limit(0)).count() == df.count()


# hidden Markov model
def brute_likelihood(m, obs):
    """Sum over all paths."""
    from itertools import product

    s = len(m.start)
    total = 0.0
    for path in product(range(s), repeat=len(obs)):
        p = float(m.start[path[0]]) * float(m.emit[obs[0], path[0]])
        for a, b, o in zip(path, path[1:], obs[1:], strict=False):
            p *= float(m.trans[a, b]) * float(m.emit[o, b])
        total += p
    return math.log(total)


def test_hmm_forward_and_counts_equal_brute_force():
    m = hmm_lm.HMM.first(3, 5)
    obs = np.array([0, 3, 2, 2, 4, 1, 0, 0, 3])
    first, length = np.array([0, 5, 5]), np.array([5, 0, 4])
    ll = hmm_lm.log_likelihood(m, obs, first, length)
    assert ll[1] == 0
    for i in (0, 2):
        assert ll[i] == pytest.approx(brute_likelihood(m, obs[first[i] : first[i] + length[i]].tolist()), rel=1e-5)
    start, trans, gamma = hmm_lm.expected_counts(m, obs, first, length)
    assert start.sum() == pytest.approx(2, rel=1e-5) and trans.sum() == pytest.approx(4 + 3, rel=1e-5) and np.allclose(gamma.sum(1), 1, atol=1e-5)
    # gamma by brute force for the second text
    from itertools import product

    o = obs[5:].tolist()
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        p = float(m.start[path[0]]) * float(m.emit[o[0], path[0]])
        for a, b, x in zip(path, path[1:], o[1:], strict=False):
            p *= float(m.trans[a, b]) * float(m.emit[x, b])
        for t, s in enumerate(path):
            want[t, s] += p
    assert np.allclose(gamma[5:], want / want.sum(1, keepdims=True), atol=1e-4)


def test_hmm_counts_of_many_steps_in_little_memory():
    import tracemalloc

    rng, s = np.random.default_rng(4), 8
    m = hmm_lm.HMM.first(s, 50)
    m.trans[:] = rng.dirichlet(np.full(s, 0.5), s)
    length = np.concatenate([[9000, 7000, 0, 1], rng.integers(1, 120, 700)])
    first = np.cumsum(length) - length
    obs = rng.integers(0, 50, length.sum())
    start, trans, gamma = hmm_lm.expected_counts(m, obs, first, length)
    want_start, want = np.zeros(s), np.zeros((s, s))
    emit, step = m.emit.astype(float), m.trans.astype(float)
    for f, n in zip(first, length, strict=True):
        o, a, b = obs[f : f + n], np.zeros((n, s)), np.ones((n, s))
        for t in range(n):
            a[t] = (a[t - 1] @ step if t else m.start) * emit[o[t]]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = step @ (emit[o[t + 1]] * b[t + 1])
            b[t] /= b[t].sum()
        for t in range(1, n):
            x = np.outer(a[t - 1], emit[o[t]] * b[t]) * step
            want += x / x.sum()
        g = a * b
        g /= g.sum(1, keepdims=True)
        assert np.allclose(gamma[f : f + n], g, atol=1e-4)
        want_start += g[0] if n else 0
    assert np.allclose(start, want_start, rtol=1e-4) and np.allclose(trans, want, rtol=1e-4)
    # a slice after the first takes next to no fresh memory for its rows of 8 single-precision numbers
    tracemalloc.start()
    hmm_lm._expected(m, obs, first, length)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(obs) * s * 4


def test_hmm_training_raises_likelihood_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(("a b " if rng.random() < 0.5 else "c d ") * 10), "s") for i in range(30)]
    df = spark.createDataFrame([*rows, (100, None, "s"), (101, " ", "s"), (None, "a b", "s"), rows[0]], DOCS)
    total = []
    for n in (0, 1, 4):
        m = hmm_lm.fit(df, 2, 64, n)
        got = hmm_lm.score(df, m).collect()
        total.append(sum(r["log_likelihood"] or 0 for r in got))
    assert total[0] < total[1] < total[2] and len(got) == 34
    by = {r["doc_id"]: r for r in got}
    assert by[100]["log_likelihood"] is None and by[101]["log_likelihood"] == 0 and by[101]["nats_per_word"] is None and by[None]["n_words"] == 2
    assert hmm_lm.score(df.limit(0), hmm_lm.fit(df.limit(0), 2, 64, 1)).count() == 0


def test_hmm_training_runs_until_converged(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(w for _ in range(15) for w in rng.choice(("a b c", "d e f", "a e", "c d")).split()), "s") for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)

    def nats(*rounds):
        got = hmm_lm.score(df, hmm_lm.fit(df, 4, 4096, *rounds)).collect()
        return -sum(r["log_likelihood"] for r in got) / sum(r["n_words"] for r in got)

    whole, three = nats(), nats(3)
    assert whole < three - 0.1 and whole < nats(12) + 0.02


def test_hmm_tells_all_words_apart(spark):
    rows = [(i, " ".join(f"w{i * 500 + k}" for k in range(500)) + " often" * 50, "s") for i in range(160)]
    df = spark.createDataFrame(rows, DOCS)
    m = hmm_lm.fit(df, 1, rounds=1)
    tables = [t for _, t in m.table.collect()]
    assert sum(len(t[1]) for t in tables) == 80_001 and len(tables) > 1  # more than 65 536, in several ranges
    new = spark.createDataFrame([(1, "w7", "s"), (2, "often", "s"), (3, "neverseen", "s")], DOCS)
    total = 160 * 550 + 0.01 * 80_002
    got = {r["doc_id"]: r["log_likelihood"] for r in hmm_lm.score(new, m).collect()}
    for i, n in {1: 1, 2: 8000, 3: 0}.items():
        assert got[i] == pytest.approx(math.log((n + 0.01) / total), rel=1e-5)


def test_hmm_blocks_leave_their_task_one_by_one(spark):
    df = spark.range(0, 27, 1, 1).selectExpr("id AS doc_id", "repeat('some words here ', 65536) AS text")  # a megabyte each
    enc = hmm_lm._encoded(df, None)
    sizes = [len(x[4]) for _, x in enc.collect()]
    assert len(sizes) == 3 and sum(sizes) == 27
    assert enc._jrdd.count() == 3  # what the JVM holds at once: all blocks of a task in one piece before


def test_hmm_tables_side_by_side_pass_no_worker_more(spark):
    df = spark.createDataFrame([(i, f"a b w{i}", "s") for i in range(30)], DOCS)
    m = hmm_lm.fit(df, 2, rounds=1)
    _, enc, asks = m.source
    for pair in ((m.table, asks), (hmm_lm._with_emissions(m, asks, enc)[1], enc)):
        deps = hmm_lm._beside(*pair)._jrdd.rdd().dependencies()
        assert [deps.apply(i).rdd().id() for i in range(deps.size())] == [r._jrdd.rdd().id() for r in pair]
    assert hmm_lm.fit(df, 2, rounds=0).table.getCheckpointFile()  # else each task that reads the first guess makes it anew


def test_hmm_reads_bytes_and_nulls_as_the_columns_have_them(spark):
    df = spark.sql("SELECT * FROM VALUES (1, CAST(X'61FF2062' AS STRING)), (2, CAST(X'61FE2062' AS STRING)), (NULL, 'b'), (4, NULL), (5, '') AS t(doc_id, text)").coalesce(1)
    (_, (_, obs, length, keys, ids, no_id, no_text)), *more = hmm_lm._encoded(df, None).collect()
    assert not more and len(keys) == 3 and len(obs) == 5  # the two bad bytes make different words
    got = sorted(zip(ids.tolist(), length.tolist(), no_id.tolist(), no_text.tolist(), strict=True))
    assert got == [(0, 1, True, False), (1, 2, False, False), (2, 2, False, False), (4, 0, False, True), (5, 0, False, False)]


# mixing
def brute_mix(rows, weights, fraction, seed=5):
    import hashlib

    queues = {}
    for i, t, s in rows:
        queues.setdefault(s, []).append((hashlib.md5(f"{seed}:{i if i is not None else ''}".encode()).hexdigest(), i, len((t or "").split())))
    out = []
    for s, q in queues.items():
        cum = 0
        for _, i, n in sorted(q, key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2])):
            cum += n
            out.append((cum / weights.get(s, 1.0), s or "", i, n))
    limit, run, keep = int(sum(x[3] for x in out) * fraction), 0, []
    for f, s, i, n in sorted(out, key=lambda x: (x[0], x[1], x[2] is None, x[2] or 0)):
        run += n
        if run <= limit:
            keep.append((i, run))
    return keep


def test_mixing_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["t"] * rng.randint(1, 40)), rng.choice(["a", "a", "b", "c", None])) for i in range(200)] + [(500, None, "a"), (501, "", "b")]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("text", "text")
    w = {"a": 2.0, "b": 0.5}
    got = sorted((r["doc_id"], r["running"]) for r in mixing.mix(df, w, fraction=0.6).collect())
    assert got == sorted(brute_mix(rows, w, 0.6))
    kept = mixing.select_mixture(df.selectExpr("*", "1 AS running", "2 AS n"), w, fraction=0.6)
    assert kept.columns[-2:] == ["running", "n"] and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in got)


def test_mixing_with_a_tiny_weight(spark):
    rows = [(i, "a b c", "big" if i % 3 else "tiny") for i in range(900)]
    w = {"tiny": 1e-9}
    got = sorted((r["doc_id"], r["running"]) for r in mixing.mix(spark.createDataFrame(rows, DOCS), w, fraction=0.9).collect())
    assert got == sorted(brute_mix(rows, w, 0.9))
    assert mixing.mix(spark.createDataFrame([(1, "word " * 100_000, "a")], DOCS), fraction=1.0).first()["tokens"] == 100_000


def test_mixing_repeated_rows_and_edges(spark):
    df = spark.createDataFrame([(1, "x y", "a")] * 4 + [(None, "z", None)], DOCS)
    assert mixing.select_mixture(df, budget=5).count() == 3
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.select_mixture(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(df, {"a": 0.0})


# resharding
def test_flow_is_least_cost():
    rng = random.Random(3)
    for _ in range(30):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 3) for _ in range(n)]
        cap = [rng.randint(0, 4) for _ in range(m)]
        cost = [[rng.randint(0, 3) for _ in range(m)] for _ in range(n)]
        if sum(supply) > sum(cap):
            with pytest.raises(ValueError):
                resharding.min_cost_flow(supply, cap, cost)
            continue
        f = resharding.min_cost_flow(supply, cap, cost)
        assert [sum(r) for r in f] == supply and all(sum(f[i][j] for i in range(n)) <= cap[j] for j in range(m))
        units = [i for i in range(n) for _ in range(supply[i])]
        best = {tuple(cap): 0}
        for i in units:
            nxt = {}
            for room, c in best.items():
                for j in range(m):
                    if room[j]:
                        k = room[:j] + (room[j] - 1,) + room[j + 1 :]
                        nxt[k] = min(nxt.get(k, 1 << 30), c + cost[i][j])
            best = nxt
        assert sum(f[i][j] * cost[i][j] for i in range(n) for j in range(m)) == min(best.values())


def test_even_flow_is_least_cost():
    rng = random.Random(8)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        supply, cap = [rng.randint(0, 5) for _ in range(n)], [rng.randint(0, 9) for _ in range(m)]
        same = [i if i < m and rng.random() < 0.8 else -1 for i in range(n)]
        if sum(supply) > sum(cap):
            continue
        cost = [[0 if same[i] == j else 1 for j in range(m)] for i in range(n)]
        f, g = resharding.even_flow(supply, cap, same), resharding.min_cost_flow(supply, cap, cost)
        assert [sum(x for (i, _), x in f.items() if i == k) for k in range(n)] == supply
        assert all(sum(x for (_, j), x in f.items() if j == k) <= cap[k] for k in range(m))
        assert sum(cost[i][j] * x for (i, j), x in f.items()) == sum(cost[i][j] * g[i][j] for i in range(n) for j in range(m))


def test_reshard_query_writes_the_affected_shards(spark, tmp_path):
    rows = [(i, "x" * 50, ["a", "b", None][i % 3], i, "t") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _touched int, shard string")
    p = resharding.reshard(df, f"file://{tmp_path}/s", block_ids=64)
    got = {r["doc_id"]: r for r in p.collect()}
    touched = {x for r in got.values() if r["moved"] for x in (r["old_shard"], r["new_shard"])}
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert set(df.columns) < set(back.columns) and len(touched) > 3
    name = (set(back.columns) - set(df.columns)).pop()
    assert {r["doc_id"]: r[name] or "" for r in back.collect()} == {i: r["new_shard"] for i, r in got.items() if r["new_shard"] in touched}


def test_reshard_plan_and_rewrite(spark, tmp_path):
    rows = [(i, "x" * 100, "a" if i % 3 else "b") for i in range(300)] + [(None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    p = resharding.plan(df, {"a": 12_000, "b": 12_000, "c": 8_000}, block_ids=8).collect()
    assert len(p) == 301
    size = {}
    for r in p:
        size[r["new_shard"]] = size.get(r["new_shard"], 0) + (100 if r["doc_id"] is not None else 0)
        assert r["moved"] == (r["old_shard"] != r["new_shard"])
    assert all(size.get(k, 0) <= c + 1600 for k, c in (("a", 12_000), ("b", 12_000), ("c", 8_000)))
    moved = sum(100 for r in p if r["moved"] and r["doc_id"] is not None)
    assert abs(moved - 8_000) <= 1600  # the least: what a has over its capacity
    man = {r["shard"]: r for r in resharding.rewrite(df.where("doc_id is not null"), f"file://{tmp_path}/new", {"a": 12_000, "b": 10_000, "c": 8_000}, block_ids=8).collect()}
    assert man["a"]["rewritten"] and man["c"]["rewritten"] and not man["b"]["rewritten"]
    new = spark.read.parquet(f"file://{tmp_path}/new")
    assert new.count() == man["a"]["documents"] + man["c"]["documents"]
    assert resharding.plan(df.limit(0)).count() == 0


# chats
SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": ["number", "string"]}, "b": {"type": "integer", "minimum": 0}}, "required": ["a"], "additionalProperties": False}}


def test_chat_links_orders_and_validates(spark):
    calls = [{"id": "2", "name": "add", "arguments": '{"a":"$1","b":2}'}, {"id": "1", "name": "add", "arguments": '{"b":1,"a":1.5}'}, {"id": "3", "name": "add", "arguments": '{"b":-1}'}, {"id": "4", "name": "nope", "arguments": "{bad"}]
    loop = [{"id": "x", "name": "add", "arguments": '{"a":"$y"}'}, {"id": "y", "name": "add", "arguments": '{"a":"$x"}'}]
    rows = [
        (1, 0, "system", "be nice"), (1, 1, "user", "hi"), (1, 2, "assistant", json.dumps({"tool_calls": calls})), (1, 3, "tool", json.dumps({"tool_call_id": "1", "content": "1.5"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "9", "content": "lost"})), (1, 4, "tool", json.dumps({"tool_call_id": "1", "content": "again"})), (2, 0, "assistant", json.dumps({"tool_calls": loop})),
        (None, 1, "user", "x"), (3, None, "user", "x"), (4, 0, "system", "only"), (5, 0, "user", None), (5, 1, "assistant", "é\n\"q\""), (5, 2, "assistant", "more"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(df, SCHEMAS | chat.REPLY).collect()}
    assert set(got) == {1, 2, 5}
    c = json.loads(got[1]["chat"])
    assert [x["id"] for x in c["calls"]] == ["call-1", "1", "2", "3", "4"] and c["system"] == "be nice"
    by = {x["id"]: x for x in c["calls"]}
    assert by["1"]["result"] == "1.5" and by["1"]["valid"] and by["2"]["valid"] and by["2"]["status"] == "unanswered"
    assert by["3"]["errors"] == ["$.a: missing", "$.b: below minimum"] and by["4"]["errors"] == ["$: not JSON", "$: no tool nope"] or by["4"]["errors"]
    assert [o["id"] for o in c["orphans"]] == ["9"] and got[1]["n_linked"] == 1
    assert all("$: cycle" in x["errors"] for x in json.loads(got[2]["chat"])["calls"])
    assert got[5]["n_linked"] == 1 and got[5]["n_orphans"] == 1 and got[5]["n_valid"] == 0
    assert got[5]["chat"] == chat.canonical(json.loads(got[5]["chat"]))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_keeps_every_turn_and_survives_bad_json(spark):
    deep = '{"prompt":' + "[" * 100_000 + "]" * 100_000 + "}"
    calls = [{"id": "s", "function": {"name": "add", "arguments": '{"a":"\\ud800"}'}}, {"id": "d", "name": "reply", "arguments": deep}, {"id": "o", "name": "add", "arguments": {"a": 1}}, 7, {"name": "add"}]
    rows = [
        (1, 0, "system", "one"), (1, 1, "system", "two"), (1, 2, "user", "q"), (1, 2, "user", "q"), (1, 3, "assistant", json.dumps({"content": "let me see", "tool_calls": calls})),
        (1, 4, "tool", "plain result"), (1, 5, "tool", json.dumps({"tool_call_id": "o", "content": {"b": 2}})), (1, 6, "critic", "hm"), (1, 7, "assistant", '{"tool_calls":[]}'), (1, 8, "assistant", "{" * 50_000),
        (2, 0, "user", "long " * 200_000), (2, 1, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as chat")
    got = {r["conv_id"]: r for r in chat.format_chats(df, SCHEMAS | chat.REPLY).collect()}
    c = json.loads(got[1]["chat"])
    by = {x["id"]: x for x in c["calls"]}
    assert c["system"] == "one\ntwo" and by["call-2"]["result"] == "let me see" and by["s"]["arguments"] == {"a": "\ufffd"} and by["s"]["valid"]
    assert by["d"]["errors"] == ["$: not JSON"] and by["o"]["valid"] and by["o"]["result"] == '{"b":2}' and got[1]["n_calls"] == 6
    assert [(o["id"], o["result"][:12]) for o in c["orphans"]] == [("none-4", "plain result"), ("none-6", "hm"), ("none-7", '{"tool_calls'), ("none-8", "{" * 12)]
    assert got[2]["n_valid"] == 1 and len(got[2]["chat"]) > 1_000_000 and got[2]["n_orphans"] == 1


def test_chat_tool_calls_through_the_registered_query(spark, tmp_path):
    from candlewright.llm import queries

    say = {"tool_calls": [{"id": "b", "name": "reply", "arguments": '{"prompt":"again","after":"$call-1"}'}, {"id": "a", "name": "reply", "arguments": '{"prompt":""}'}]}
    rows = [(9, 1, "user", "hi"), (9, 2, "assistant", json.dumps(say)), (9, 3, "tool", json.dumps({"tool_call_id": "b", "content": "done"}))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    (r,) = queries.op2_chat_format(spark, f"file://{tmp_path}").collect()
    assert (r["n_calls"], r["n_linked"], r["n_valid"], r["n_orphans"]) == (3, 1, 2, 0)
    assert [(x["id"], x["status"], x["valid"]) for x in json.loads(r["chat"])["calls"]] == [("call-1", "unanswered", True), ("a", "unanswered", False), ("b", "linked", True)]


def test_topological_order_is_stable():
    order, bad = chat.topological(["a", "b", "c", "d"], {"a": {"d"}, "c": {"b", "zz"}})
    assert order == ["b", "c", "d", "a"] and not bad


def test_packed_bags_come_back_whole():
    cases = [(b"", 0), (b"a", 1), (b"one two one two " * 30000, 1), ("größe 漢字 x".encode(), 1)]
    packed = quality.Bags([quality.pack_bag(*quality.bag(t)) for t, _ in cases])
    for i, (t, _) in enumerate(cases):
        b, n = quality.bag(t)
        assert np.array_equal(packed[i][0], b) and np.array_equal(packed[i][1], n)
    assert len(packed) == len(cases)
