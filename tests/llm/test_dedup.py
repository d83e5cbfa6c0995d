"""Near-duplicates, repeated passages, fingerprints and embeddings against brute force, and their edge cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlewright.llm import common, embedding_dedup, minhash, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab=3000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(30):
        base = words(rng, rng.randint(60, 200))
        rows.append(" ".join(base))
        if i % 3 == 0:
            rows.append(" ".join(base))
        if i % 4 == 0:
            near = list(base)
            for j in rng.sample(range(len(near)), max(1, len(near) // 25)):
                near[j] = "edit"
            rows.append(" \n".join(near))
    passage = words(rng, 70)
    for _ in range(5):
        rows.append(" ".join(words(rng, 40) + passage + words(rng, 30)))
    loop = words(rng, 7)
    rows += [" ".join(loop * 30), "tiny", "tiny text", "tiny", "", " \n\t "]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


def grams(text, k=3):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(rows, t=0.5):
    sets = {i: grams(x) for i, x in rows if x is not None and x.strip()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n >= t * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = {}
    for i in sets:
        out.setdefault(find(i), []).append(i)
    return {r: sorted(m) for r, m in out.items() if len(m) > 1}


def test_minhash_groups_equal_brute_force(spark):
    rows = corpus()
    got = {}
    for r in minhash.near_duplicates(frame(spark, rows)).collect():
        got.setdefault(r["group_id"], []).append(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["group_id"])
    assert {k: sorted(v) for k, v in got.items()} == brute_groups(rows)


def test_minhash_proof_is_the_exact_jaccard():
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    a, b = texts, texts[::-1]
    got = minhash.jaccard(pa.array(a), pa.array(b), 3)
    for x, y, j in zip(a, b, got, strict=True):
        s, t = grams(x), grams(y)
        assert j == pytest.approx(len(s & t) / max(len(s | t), 1))


def test_minhash_drop_keeps_one_of_each_group(spark):
    rows = corpus()
    kept = {r[0] for r in minhash.drop_near_duplicates(frame(spark, rows)).select("doc_id").collect()}
    gone = {i for g in brute_groups(rows).values() for i in g[1:]}
    assert kept == {i for i, _ in rows} - gone


def test_minhash_estimate_is_close_and_corrected():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        common_ = rng.integers(0, 2**63, int(2000 * share)).astype(np.uint64)
        a, b = (np.concatenate([common_, rng.integers(0, 2**63, 2000 - len(common_)).astype(np.uint64)]) for _ in range(2))
        a, b = common.mix64(a), common.mix64(b)
        ra, rb = (minhash.registers(np.zeros(len(x), int), x, 1, 1024)[0] for x in (a, b))
        true = len(common_) / (4000 - len(common_))
        assert abs(minhash.estimate(ra, rb, 2000, 2000) - true) < 0.06


def test_minhash_registers_hold_zeros_and_mantissa():
    least = np.array([1 << 63, (1 << 63) | (1 << 62), 1 << 40, 2**64 - 1], dtype=np.uint64)
    r = minhash.pack_registers(least)
    assert r[0] >> 10 == 1 and r[0] & 1023 == 0 and r[1] & 1023 == 512 and r[2] >> 10 == 24 and r[3] == 0


def test_minhash_nulls_ties_and_extra_columns(spark):
    t = "one two three four five six"
    rows = [(5, t, "x", 1), (5, t, "y", 2), (None, t, "z", 3), (7, None, "n", 4), (8, "", "n", 5), (9, "other words in here now", "n", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string, uid int")
    got = sorted(((r["doc_id"], r["group_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == [(5, 5, False), (5, 5, True), (None, 5, False)]
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [5, 7, 8, 9]
    empty = df.limit(0)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_spans(rows, window):
    occ = {}
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0))
    for n, (i, t) in enumerate(order):
        w = t.split()
        for s in range(len(w) - window + 1):
            occ.setdefault(tuple(w[s : s + window]), []).append((n, s))
    marks = {(n, kind): set() for n in range(len(order)) for kind in (False, True)}
    for places in occ.values():
        if len(places) > 1:
            for j, (n, s) in enumerate(sorted(places)):
                marks[n, False].add(s)
                if j:
                    marks[n, True].add(s)
    out = []
    for (n, kind), starts in marks.items():
        last = None
        for s in sorted(starts):
            if last is not None and s <= last[1]:
                last[1] = s + window
            else:
                last = [s, s + window]
                out.append([order[n][0], last, kind])
    return sorted((i, a, b, k) for i, (a, b), k in out)


@pytest.mark.parametrize(("window", "k", "hot"), [(50, 10, 1000), (12, 4, 1000), (12, 4, 5), (50, 10, 2)])
def test_repeats_equal_brute_force(spark, window, k, hot):
    """By the sort alone, by the hashes alone, and by both."""
    rows = corpus()
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["repeat"]) for r in suffix_dedup.repeated_passages(frame(spark, rows), window, k, hot).collect())
    assert got == brute_spans(rows, window)


def test_removed_repeats_leave_no_window_twice(spark):
    rows = corpus()
    df = frame(spark, rows)
    out = suffix_dedup.remove_repeats(df, 12, 4)
    assert out.columns == df.columns
    got = out.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    spans = {}
    for i, a, b, k in brute_spans(rows, 12):
        if k:
            spans.setdefault(i, []).append((a, b))
    for i, t in rows:
        w = t.split()
        left = [x for j, x in enumerate(w) if not any(a <= j < b for a, b in spans.get(i, []))]
        mine = [r["text"].split() for r in got if r["doc_id"] == i]
        assert mine == ([left] if left or not w else [])


def test_repeats_edge_cases(spark):
    long_ = " ".join(f"x{i}" for i in range(60))
    rows = [(1, long_, "a"), (1, long_, "b"), (None, long_, "c"), (2, None, "d"), (3, "", "e"), (4, "short", "f"), (4, "short", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, packs string")
    got = sorted(((r["doc_id"], r["repeat"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(df).collect()), key=str)
    assert got == sorted([(1, False, 0, 60), (1, False, 0, 60), (1, True, 0, 60), (None, False, 0, 60), (None, True, 0, 60)], key=str)
    assert sorted((r["doc_id"] for r in suffix_dedup.remove_repeats(df).collect()), key=str) == [1, 2, 3, 4, 4]
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0 and suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_repeats_know_one_kind_of_word(spark):
    """Control signs separate words in both outputs, a no-break space in neither; repeated rows lie in different files."""
    t = "\x01".join(f"y{i}" for i in range(60))
    solid = "\u00a0".join(f"z{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (2, t), (1, t), (3, solid), (4, solid)], "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(df).where("repeat").collect())
    assert got == [(1, 0, 60), (2, 0, 60)]
    assert sorted(r["doc_id"] for r in suffix_dedup.remove_repeats(df).collect()) == [1, 3, 4]


def test_merge_in_pieces_equals_whole():
    """Pieces between anchors give what the whole range gives."""
    rng = random.Random(12)
    passage = words(rng, 60)
    texts = [" ".join(words(rng, 20) + passage + words(rng, 20)) for _ in range(30)]
    arr = pa.array(texts)
    keys = np.arange(30)
    found = list(suffix_dedup._find(12, 4)(iter([pa.RecordBatch.from_arrays([arr, pa.array(keys), pa.array(keys)], names=["text", "h1", "h2"])])))
    packs = [[] for _ in texts]
    for b in found:
        for d, x in zip(b.column("h1").to_pylist(), b.column("pack").to_pylist(), strict=True):
            packs[d].append(x)
    none = pa.array([[]] * 30, pa.list_(pa.int64()))
    rb = pa.RecordBatch.from_arrays([pa.array(keys), arr, pa.array(keys), pa.array(keys), pa.array(packs), none], names=["doc_id", "text", "h1", "h2", "packs", "hots"])
    runs = list(suffix_dedup._runs(12, 4, 2, 100)(iter([rb])))

    def rows(most):
        return sorted(tuple(x.values()) for b in suffix_dedup._merge(12, most)(iter(runs)) for x in b.to_pylist())

    assert rows(1) == rows(10**9) and len(rows(1)) > 100


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(5)
    runs, all_ = [], []
    for r in range(7):
        keys = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 50)))
        lcp, rest, size = suffix_dedup.front_code(keys)
        back, key, at = [], b"", 0
        for n, m in zip(lcp, size, strict=True):
            key = key[:n] + rest[at : at + m]
            at += m
            back.append(key)
        assert back == keys
        runs.append(iter([(k, int(n), r) for k, n in zip(keys, lcp, strict=True)]))
        all_ += keys
    prev, out = b"", []
    for key, common_, _ in suffix_dedup.merge_runs(runs):
        assert common_ == len(next((x for x in [[a for a, b in itertools.takewhile(lambda p: p[0] == p[1], zip(prev, key, strict=False))]])))
        prev = key
        out.append(key)
    assert out == sorted(all_)


def test_repeats_are_cut_in_one_python_call(spark):
    out = suffix_dedup.remove_repeats(frame(spark, corpus()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_simhash_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(63) for _ in range(60)]
    for f in list(fps):
        g = f
        for b in rng.sample(range(63), rng.randint(1, 5)):
            g ^= 1 << b
        fps.append(g)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)] + [(999, None)], "doc_id long, simhash long")
    got = {(r[0], r[1], r[2]) for r in simhash.within_radius(df).collect()}
    want = {(min(a, b), max(a, b), (a ^ b).bit_count()) for a, b in itertools.combinations(set(fps), 2) if (a ^ b).bit_count() <= 3}
    assert got == want and len(got) == simhash.within_radius(df).count()


def test_simhash_documents(spark):
    rows = corpus()
    rows += [(900, None)]
    fp = {r["doc_id"]: r["simhash"] for r in simhash.fingerprints(frame(spark, rows)).collect()}
    assert fp[900] is None and len(fp) == len(rows)
    raw = dict(rows)[0].encode() or b"x"
    w = common.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    votes, seen = np.zeros(64), [raw[a:b] for a, b in zip(w.starts, w.ends, strict=True)]
    for h, term in dict(zip(w.hashes().tolist(), seen, strict=True)).items():
        bits = np.unpackbits(np.array([h], np.uint64).view(np.uint8))
        votes += np.where(bits, 1, -1) * np.log2(1 + seen.count(term))
    if dict(rows)[0].strip():
        assert simhash.votes_to_fingerprint(votes[None])[0] == fp[0]
    assert brute_links(fp, 3) == links_of(simhash.similar_documents(frame(spark, rows)))
    assert simhash.similar_documents(frame(spark, rows).limit(0)).count() == 0


def brute_links(fp, radius):
    """Rows of similar_documents without the nearest, from fingerprints by id."""
    u = lambda x: x & (2**64 - 1)
    out = []
    for i, f in fp.items():
        if f is None:
            out.append((i, None, None, None, None))
            continue
        near = {g for g in fp.values() if g is not None and g != f and (u(f) ^ u(g)).bit_count() <= radius}
        least = min(((u(f) ^ u(g)).bit_count() for g in near), default=None)
        out.append((i, min(j for j, g in fp.items() if g == f), sum(g == f for g in fp.values()), len(near), least))
    return sorted(out, key=str)


def links_of(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_same"], r["n_links"], r["hamming"]) for r in df.collect()), key=str)


def test_simhash_edges(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "y", 2), (None, "a b c", "z", 3), (2, None, "z", 4), (3, " \n", "z", 5), (4, "lone " * 30_000, "z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, simhash int")
    got = links_of(simhash.similar_documents(df))
    assert [r[:4] for r in got if r[0] in (1, None)] == [(1, 1, 3, 0), (1, 1, 3, 0), (None, 1, 3, 0)]
    assert [r for r in got if r[0] in (2, 3)] == [(2, None, None, None, None), (3, None, None, None, None)] and len(got) == 6


def test_simhash_query_finds_inexact_copies(spark, tmp_path):
    from candlewright.llm import queries

    rng = random.Random(5)
    rows = []
    for i in range(40):
        base = words(rng, 150)
        near = [w if rng.random() > 0.02 else "edit" for w in base]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    fp = {r["doc_id"]: r["simhash"] & (2**64 - 1) for r in simhash.fingerprints(frame(spark, rows)).collect()}
    got = queries.op4_simhash(spark, f"file://{tmp_path}")
    fp_signed = {i: f - (1 << 64) if f >> 63 else f for i, f in fp.items()}
    assert links_of(got) == brute_links(fp_signed, simhash.NEAR_RADIUS)
    near = {r["doc_id"]: r["nearest_id"] for r in got.collect()}
    assert sum(near[2 * i] == 2 * i + 1 for i in range(40)) > 25 > sum((fp[2 * i] ^ fp[2 * i + 1]).bit_count() <= 3 for i in range(40))


def test_simhash_tables_are_not_broadcast(spark, tmp_path):
    spark.range(50).selectExpr("id AS fp").write.parquet(f"file://{tmp_path}/fps")
    met = simhash._meetings(spark.read.parquet(f"file://{tmp_path}/fps"), simhash.NEAR_RADIUS, simhash.NEAR_BLOCKS)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_embedding_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 64))
    near = base[:150] + rng.normal(size=(150, 64)) * 0.2
    x = np.concatenate([base, near])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 64, 0), (None, base[0].tolist(), 0), (0, base[0].tolist(), 0), (1003, [float("nan")] * 64, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")
    got = {(r["vec_a"], r["vec_b"]) for r in embedding_dedup.near_pairs(df).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.95}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100
    assert embedding_dedup.near_pairs(df.limit(0)).count() == 0
    links = {(r["vec_id"], r["class_id"], r["n_same"]): r["n_links"] for r in embedding_dedup.near_vectors(df).collect()}
    assert set(links) == {(i, i, 1) for i in range(len(x))} and sum(links.values()) == 2 * len(got)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_embedding_copies_and_unequal_lengths(spark):
    """Thousands of copies are one class; short vectors compare as if padded; int arrays, ties and clashing names."""
    rng = np.random.default_rng(6)
    v = np.zeros(64)
    v[:16] = rng.normal(size=16)
    rows = [(i, v.tolist(), i) for i in range(10, 2010)] + [(5, v[:16].tolist(), 0), (6, (v * 3).tolist(), 0), (7, (-v).tolist(), 0), (8, [float("inf")] * 3, 0), (9, [1.0, None], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, uid int")
    got = {r["vec_id"]: (r["class_id"], r["n_same"], r["n_links"]) for r in embedding_dedup.near_vectors(df).collect()}
    assert len(got) == 2003 and all(got[i] == (10, 2000, 2) for i in range(10, 2010))
    assert got[5] == (5, 1, 2) and got[6] == (6, 1, 2) and got[7] == (7, 1, 0)
    ints = spark.createDataFrame([(1, [1, 0]), (2, [1, 0]), (3, [100, 1])], "vec_id long, embedding array<int>")
    assert {(r["vec_id"], r["class_id"], r["n_links"]) for r in embedding_dedup.near_vectors(ints).collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 1)}


def test_hadamard_is_orthonormal():
    h = embedding_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_words_match_split():
    texts = ["a b", "", None, "é  ü\nx", "tail ", " lead", "one"]
    data, off = common.text_buffers(pa.array(texts))
    w = common.Words(data, off)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [(t or "").split() for t in texts]
    h = w.hashes()
    assert len(set(h.tolist())) == len({x for g in got for x in g})


def test_very_long_text(spark):
    rng = random.Random(9)
    t = " ".join(words(rng, 40_000, 10**6))
    df = frame(spark, [(1, t), (2, t + " end"), (3, "x y z")])
    assert {r["doc_id"] for r in minhash.near_duplicates(df).collect()} == {1, 2}
    got = suffix_dedup.repeated_passages(df).where("repeat").collect()
    assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in got] == [(2, 0, 40_000)]
    assert df.select(F.count("*")).first()[0] == 3
