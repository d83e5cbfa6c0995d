"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations, multiprobe, verified.

Equal vectors are one class and are hashed once. A row of a bucket table is (table and bucket in one integer, class, sketch): three
codes of seven bits for 64 dimensions need no more. The sketch holds the signs of a further rotation; two vectors at the threshold
differ in a known share of them, so a pair six deviations beyond that isn't compared further. What is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, small_batches, written

THRESHOLD, TABLES, HASHES, PROBES = 0.95, 16, 3, 4
SKETCH = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform over the last axis (a power of 2), orthonormal: eight at a time, then what is left."""
    n, shape = x.shape[-1], x.shape
    y, left = x, n
    while left > 1:
        r = min(left, 8)
        h = np.ones((1, 1), x.dtype)
        while len(h) < r:
            h = np.block([[h, h], [h, -h]])
        # transform the last r places, then bring them to the front, so that the next r stand last
        y = np.ascontiguousarray(np.swapaxes(y.reshape(-1, n // r, r) @ h, 1, 2))
        left //= r
    return y.reshape(shape) / np.sqrt(n).astype(x.dtype)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-random rotation: three rounds of random signs and a Hadamard transform."""
    g = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * g.choice(np.array([-1.0, 1.0], x.dtype), x.shape[-1]))
    return x


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, which rows they are); NULL, empty, non-finite and zero vectors are left out, shorter ones padded by zeros."""
    lists = col.to_pylist() if col.null_count else None
    if lists is None:
        o = col.offsets.to_numpy()
        v = col.values.to_numpy(zero_copy_only=False).astype(np.float64)[o[0] : o[-1]]
        n = np.diff(o)
        if len(n) and (n == n[0]).all() and n[0]:
            x = v.reshape(len(n), n[0])
        else:
            lists = col.to_pylist()
    if lists is not None:
        wide = max([len(r) for r in lists if r] or [1])
        x = np.full((len(lists), wide), np.nan)
        for i, r in enumerate(lists):
            if r:
                x[i] = 0.0
                x[i, : len(r)] = [np.nan if q is None else q for q in r]
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return x[ok] / norm[ok, None], np.flatnonzero(ok)


def _top_two(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of the largest coordinate by size, code of the second, by how much the first is larger); code: 2 x place + sign."""
    a, i = np.abs(y), np.arange(len(y))
    one = a.argmax(1)
    high = a[i, one]
    a[i, one] = -1
    two = a.argmax(1) if y.shape[1] > 1 else one
    low = a[i, two] if y.shape[1] > 1 else high
    return one * 2 + (y[i, one] < 0), two * 2 + (y[i, two] < 0), high - low


def _hash(tables: int, hashes: int, probes: int, dim: int, seed: int):
    wide = 1 << max(0, (dim - 1).bit_length())
    compact = (2 * wide) ** hashes * tables * 2 < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch.column("embedding"))
            if not len(rows):
                continue
            ids = batch.column("uid").to_numpy()[rows]
            z = np.zeros((len(x), wide), np.float32)
            z[:, : x.shape[1]] = x
            sketch = np.concatenate([rotate(z, seed + 500_000 + i) > 0 for i in range(-(-SKETCH // wide))], axis=1)[:, :SKETCH]
            sketch = np.packbits(sketch, axis=1).view(np.int64).ravel()

            def key(code, t):
                if compact:
                    k = np.full(len(code), t, np.int64)
                    for h in range(hashes):
                        k = k * (2 * wide) + code[:, h]
                    return k * 2
                k = np.full(len(code), mix64(np.array([t + 1], U64))[0], U64)
                for h in range(hashes):
                    k = mix64(k * U64(0x100000001B3) + code[:, h].astype(U64) + U64(1))
                return (k & ~U64(1)).view(np.int64)

            # probes in order of what they give up: subsets of hash functions that take their second choice
            options = [[h for h in range(hashes) if s >> h & 1] for s in range(1, 1 << hashes)]
            for t in range(tables):
                best, second, gap = (np.stack(v, 1) for v in zip(*(_top_two(rotate(z, seed + 1000 * t + h)) for h in range(hashes)), strict=True))
                loss = np.stack([(gap[:, o] ** 2).sum(1) for o in options], 1)
                order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
                keys = [key(best, t) + 1]  # an odd key: the vector's own bucket
                for p in range(order.shape[1]):
                    c = best.copy()
                    for s, o in enumerate(options):
                        at = order[:, p] == s
                        for h in o:
                            c[at, h] = second[at, h]
                    keys.append(key(c, t))
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(ids, n)), pa.array(np.tile(sketch, n))], names=["key", "uid", "sketch"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("ea"))[0], _matrix(batch.column("eb"))[0]
            if a.shape[1] != b.shape[1]:
                wide = max(a.shape[1], b.shape[1])
                a, b = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b))
            cos = np.einsum("ij,ij->i", a, b)
            ok = cos >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array(cos[ok])], names=["a", "b", "cosine"])

    return run


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, uid, each once; classes: uid, class_id, n_same, embedding), the classes written once. uid numbers the classes.

    Equal vectors are those whose two 64-bit hashes are equal, so that the vectors travel once and their rows without them.
    """
    kind = dict(vectors.select("embedding").dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    v = v.where("vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x != 0)")
    same = F.transform("embedding", lambda x: x + F.lit(0).cast(kind[6:-1]))  # -0 and 0 are one
    v = v.select("vec_id", "embedding", F.xxhash64(same).alias("k1"), F.xxhash64(F.lit(0x5EED), same).alias("k2"))
    ids = v.select("vec_id", "k1", "k2").distinct()
    n = ids.groupBy("k1", "k2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n_same"))
    c = v.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding")).join(n, ["k1", "k2"])
    c = written(c.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    return ids.join(c.select("k1", "k2", "uid"), ["k1", "k2"]).select("vec_id", "uid"), c


def _linked(c: DataFrame, threshold: float, tables: int, hashes: int, probes: int, seed: int) -> DataFrame:
    """(a, b, cosine) of all pairs of classes that share a bucket and reach the threshold, a < b."""
    dim = c.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = c.select("uid", "embedding").mapInArrow(_hash(tables, hashes, probes, dim, seed), "key long, uid long, sketch long")
    share = np.arccos(min(max(threshold, -1.0), 1.0)) / np.pi
    most = int(SKETCH * share + 6 * np.sqrt(SKETCH * share * (1 - share)) + 1) if dim >= 16 else SKETCH
    a, b = rows.alias("a"), rows.alias("b")
    # the arithmetic keeps all conditions in the join, so that both sides are the same shuffle
    meet = F.shiftright("a.key", 1) == F.shiftright("b.key", 1)
    own = F.col("a.key").bitwiseAND(F.lit(1)) * (F.col("a.uid") != F.col("b.uid")).cast("int") == 1
    close = F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))) <= most
    cand = a.join(b, meet & own & close).select(F.least("a.uid", "b.uid").alias("a"), F.greatest("a.uid", "b.uid").alias("b")).distinct()
    va = c.select(F.col("uid").alias("a"), F.col("embedding").alias("ea"))
    vb = c.select(F.col("uid").alias("b"), F.col("embedding").alias("eb"))
    return cand.join(va, "a").join(vb, "b").select("a", "b", "ea", "eb").mapInArrow(_verify(threshold), "a long, b long, cosine double")


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 9) -> DataFrame:
    """Pairs of classes of equal vectors with cosine at least ``threshold``: (vec_a, vec_b, cosine), cosine rounded to 6 places.

    A class goes by its least vec_id, the smaller one of a pair comes first; classes that share their least id (an id with several
    vectors) give no pair, and a pair of ids that several vectors give counts once, at its most similar. See ``near_vectors``.
    """
    small_batches(vectors.sparkSession, 5000)
    _, c = _classes(vectors)
    p = _linked(c, threshold, tables, hashes, probes, seed)
    ids = [c.select(F.col("uid").alias(x), F.col("class_id").alias(f"id_{x}")) for x in "ab"]
    p = p.join(ids[0], "a").join(ids[1], "b").where("id_a != id_b")
    return p.groupBy(F.least("id_a", "id_b").alias("vec_a"), F.greatest("id_a", "id_b").alias("vec_b")).agg(F.round(F.max("cosine"), 6).alias("cosine"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 9) -> DataFrame:
    """Each vector with its class and its links: (vec_id, class_id, n_same, n_links).

    A class is all rows with equal embeddings; class_id is its least vec_id, n_same the number of its ids. n_links counts the other
    classes with cosine at least ``threshold``, every one that shares a bucket: each vector lies in its own bucket of every table
    and looks into ``probes`` more, candidates are compared exactly, so there are no false links, and recall is that of the tables.
    NULL ids and NULL, empty, zero or non-finite embeddings have no row; vectors of unequal length compare as if padded by zeros;
    repeated rows count once, and an id with several embeddings has a row for each. Other columns aren't read.
    """
    small_batches(vectors.sparkSession, 5000)
    rows, c = _classes(vectors)
    p = _linked(c, threshold, tables, hashes, probes, seed)
    n = p.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("n_links"))
    facts = c.select("uid", "class_id", "n_same").join(n, "uid", "left")
    return rows.join(facts, "uid").select("vec_id", "class_id", "n_same", F.coalesce("n_links", F.lit(0)).alias("n_links"))
