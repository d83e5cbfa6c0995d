"""Near-duplicate groups by HyperMinHash: compressed registers, banded, collision-corrected, then verified exactly.

Plan: exact copies collapse on a 128-bit text key. Each distinct text gets ``registers`` buckets over its word ``k``-grams; a
register packs the leading-zero count of the bucket's least hash with ``MANTISSA`` further bits. Bands of ``rows`` registers are
hash-partitioned. Inside a bucket a sketch of one bit a register decides: members whose sketches agree beyond doubt are
linked by a spanning tree, so thousands of copies cost a pass each and not a pair each; all further pairs that may reach the
threshold become candidates. A candidate pair is then estimated from the full registers, collision-corrected, and what is left
is proved by the exact Jaccard of the k-gram sets (64-bit hashes of the grams, made from the texts). Proved pairs give the groups (connected components). No bound on bucket or
group size exists, and no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, blocks, components, fresh, mix64, n_parts, small_batches, text_buffers, text_key, written

MANTISSA = 10
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
K, REGISTERS, ROWS, THRESHOLD = 3, 192, 4, 0.5


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word k-gram; a text of fewer words has its whole word list as one."""
    h = w.hashes()
    pos, g = w.grams(h, k)
    d = w.doc[pos]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        extra = np.zeros(len(short), U64)
        for i in range(k - 1):
            has = w.counts[short] > i
            extra[has] = extra[has] * U64(0xD6E8FEB86659FD93) + h[w.first[short[has]] + i]
        d, g = np.concatenate([d, short]), np.concatenate([g, mix64(extra)])
    return d, g


def pack_registers(least: np.ndarray) -> np.ndarray:
    """16-bit registers (leading zeros + 1, mantissa) of bucket minima; 0 is an empty bucket."""
    u = (least >> U64(11)).astype(np.int64)
    _, exp = np.frexp(u.astype(np.float64))
    lz = 53 - exp
    mant = ((u << lz) & ((1 << 52) - 1)) >> (52 - MANTISSA)
    return np.where(least == EMPTY, 0, ((lz + 1) << MANTISSA) | mant).astype(np.uint16)


def registers(d: np.ndarray, g: np.ndarray, n: int, m: int) -> np.ndarray:
    """[n, m] registers of the gram hashes g that belong to rows d."""
    least = np.full(n * m, EMPTY, U64)
    bucket = ((g >> U64(32)) * U64(m)) >> U64(32)
    np.minimum.at(least, d * m + bucket.astype(np.int64), mix64(g ^ U64(0x1F83D9ABFB41BD6B)))
    return pack_registers(least).reshape(n, m)


def densify(r: np.ndarray) -> np.ndarray:
    """Registers without empty buckets: each takes the value of the first non-empty bucket of a probe sequence of its own.

    The sequence is the same for all documents, so two documents agree in a bucket with a chance near their Jaccard, however
    few k-grams they have. Rows without any register stay empty.
    """
    n, m = r.shape
    out = r.copy()
    row, col = np.nonzero((r == 0) & r.any(axis=1)[:, None])
    t = 0
    while len(row):
        t += 1
        src = (mix64(col.astype(U64) * U64(0x10001) + U64(t * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U64(m)).astype(np.int64)
        got = r[row, src]
        out[row, col] = got
        more = got == 0
        row, col = row[more], col[more]
    return out


def estimate(a: np.ndarray, b: np.ndarray, na, nb) -> np.ndarray:
    """Jaccard estimate from registers (last axis), less the matches that two different minima give by chance."""
    any_ = (a > 0) | (b > 0)
    n = np.maximum(any_.sum(-1), 1)
    same = ((a == b) & any_).sum(-1)
    phi = 4.0 * na * nb / np.maximum((na + nb) * 1.0, 1) ** 2
    chance = 0.169919487159739 * np.minimum(n, a.shape[-1]) * 2.0**-MANTISSA * phi
    return np.maximum(0.0, (same - chance) / n)


def sketch_names(m: int) -> list[str]:
    return [f"s{i}" for i in range(-(-m // 64))]


def sketch_words(packed: np.ndarray) -> list[np.ndarray]:
    """Columns of 64 bits of sketches packed in bytes, padded by zeros."""
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return list(wide.view(np.uint64).T)


def _bands(k: int, m: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nb = m // rows
        salt = mix64(np.arange(1, nb + 1, dtype=U64))
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            uid = batch.column("uid").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in blocks(off):
                w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                d, g = shingles(w, k)
                r = registers(d, g, j - i, m)
                full = w.counts > 0
                r, ids = densify(r[full]), uid[i:j][full]
                if not len(ids):
                    continue
                x = mix64(r.astype(U64) + U64(0x51ED27) * np.arange(1, m + 1, dtype=U64))
                sk = np.packbits((x & U64(1)).astype(np.uint8), axis=1)
                part = r.reshape(len(ids), nb, rows)
                key = np.zeros((len(ids), nb), U64)
                for q in range(rows):
                    key = key * U64(0xC2B2AE3D27D4EB4F) + part[:, :, q].astype(U64) + U64(1)
                key = mix64(key + salt)
                at, band = np.nonzero(part.any(axis=2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at, band].view(np.int64)), pa.array(ids[at]), *(pa.array(np.ascontiguousarray(c[at]).view(np.int64)) for c in sketch_words(sk))],
                    names=["key", "uid", *sketch_names(m)],
                )

    return run


def _links(m: int, sure: int, least_same: int):
    """Candidate pairs inside each bucket of equal keys; input is sorted by key within the partition."""

    def agree(sk: list[np.ndarray], q, at) -> np.ndarray:
        far = np.zeros(np.shape(at), np.int64)
        for s in sk:
            far += np.bitwise_count(s[at] ^ s[q])
        return m - far

    def bucket(ids: np.ndarray, sk: list[np.ndarray], out: list) -> None:
        def same(q, at):
            return agree(sk, q, at)

        part, left, c = np.full(len(ids), -1), np.arange(len(ids)), 0
        while len(left):
            part[left[0]] = c
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                q = queue.pop()
                hit = same(q, left) >= sure
                new = left[hit]
                if len(new):
                    out.append((np.full(len(new), ids[q]), ids[new]))
                    part[new] = c
                    queue.extend(new)
                    left = left[~hit]
            c += 1
        if c > 1:
            at = np.arange(len(ids))
            for q in range(len(ids) - 1):
                rest = at[q + 1 :]
                may = rest[(same(q, rest) >= least_same) & (part[rest] != part[q])]
                if len(may):
                    out.append((np.full(len(may), ids[q]), ids[may]))

    def emit(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        key, ids, *sk = cols
        sk = [s.view(U64) for s in sk]
        out: list = []
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(cut)
        two = cut[:-1][sizes == 2]
        if len(two):
            near = agree(sk, two, two + 1) >= least_same
            out.append((ids[two[near]], ids[two[near] + 1]))
        for i in np.flatnonzero(sizes > 2):
            a, b = cut[i], cut[i + 1]
            bucket(ids[a:b], [s[a:b] for s in sk], out)
        if not out:
            return None
        a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
        e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: list[list[np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(c).to_numpy() for c in ("key", "uid", *sketch_names(m))]
            if hold and cols[0][-1] == hold[-1][0][-1]:  # the whole batch may continue one bucket
                hold.append(cols)
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            hold.append([c[:cut] for c in cols])
            got = [np.concatenate(x) for x in zip(*hold, strict=True)]
            if len(got[0]) and (rb := emit(got)) is not None:
                yield rb
            hold = [[c[cut:] for c in cols]]
        if hold:
            got = [np.concatenate(x) for x in zip(*hold, strict=True)]
            if len(got[0]) and (rb := emit(got)) is not None:
                yield rb

    return run


def _features(k: int, m: int):
    """Registers and number of distinct k-grams of each text, and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            for i, j in blocks(off):
                w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                d, g = shingles(w, k)
                regs = registers(d, g, j - i, m)
                n = np.bincount(distinct(d, g)[0], minlength=j - i).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("uid")[i:j], pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(n), batch.column("text")[i:j]], names=["uid", "regs", "n", "text"])

    return run


def distinct(d: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (row, hash), sorted."""
    order = np.argsort(g, kind="stable")
    order = order[np.argsort(d[order], kind="stable")]
    d, g = d[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return d[new], g[new]


def jaccard(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """Exact Jaccard of the word k-gram sets of the texts in equal rows."""
    out, sides = np.zeros(len(a)), []
    for col in (a, b):
        data, off = text_buffers(col)
        sides.append((data, off))
    both = sides[0][1] + sides[1][1]
    for i, j in blocks(both):
        ds, gs, ns = [], [], []
        for data, off in sides:
            d, g = distinct(*shingles(Words(data[off[i] : off[j]], off[i : j + 1] - off[i]), k))
            ds.append(d)
            gs.append(g)
            ns.append(np.bincount(d, minlength=j - i))
        d, _ = distinct(np.concatenate(ds), np.concatenate(gs))
        union = np.bincount(d, minlength=j - i)
        out[i:j] = (ns[0] + ns[1] - union) / np.maximum(union, 1)
    return out


def _estimated(m: int, threshold: float):
    """Pairs whose estimate isn't four standard errors below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, m) for c in ("ra", "rb"))
            used = np.maximum(((ra > 0) | (rb > 0)).sum(1), 1)
            slack = 4 * np.sqrt(threshold * (1 - threshold) / used) + 1 / used
            ok = estimate(ra, rb, batch.column("na").to_numpy(), batch.column("nb").to_numpy()) >= threshold - slack
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return run


def _proved(k: int, threshold: float):
    """Pairs whose exact Jaccard reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array(jaccard(batch.column("ta"), batch.column("tb"), k) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = K, m: int = REGISTERS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Every document of a near-duplicate group of two or more rows: (doc_id, group_id, kept).

    group_id is the group's least doc_id; kept marks the one row that stays. Two texts are linked where the Jaccard of their
    word k-gram sets is at least ``threshold``; groups are single linkage. NULL texts and texts without a word belong to no
    group. Repeated rows are copies of each other: exactly one of them is kept. A NULL doc_id sorts after all others, so it is
    kept only where its group has no other. Other columns, whatever their names, aren't read.
    """
    decided, base = _decide(docs, k, m, rows, threshold)
    w = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last())
    return (
        base.join(decided, ["h1", "h2"]).withColumn("rn", F.row_number().over(w))
        .select("doc_id", "group_id", (F.col("wins") & (F.col("rn") == 1)).alias("kept"))
    )


def _decide(docs: DataFrame, k: int, m: int, rows: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    small_batches(spark)
    h1, h2 = text_key("text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    keyed = d.where(F.col("text").rlike(r"[^\x00-\x20]")).select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))
    base = keyed.select("doc_id", "h1", "h2")
    texts = base.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    bands = keyed.select(F.col("h1").alias("uid"), "text").mapInArrow(_bands(k, m, rows), "key long, uid long, " + ", ".join(f"{c} long" for c in sketch_names(m)))
    agree, dev = m * (1 + threshold) / 2, np.sqrt(m * (1 + threshold) / 2 * (1 - threshold) / 2)
    pairs = (
        bands.repartition(n_parts(spark), "key").sortWithinPartitions("key")
        .mapInArrow(_links(m, int(np.ceil(agree + 4 * dev)), int(np.floor(agree - 3.5 * dev))), "a long, b long").distinct()
    )
    pairs = written(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    suspects = texts.join(nodes, texts.h1 == nodes.node, "left_semi").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first_id")
    one = Window.partitionBy("h1", "h2").orderBy("doc_id")
    feats = (
        keyed.join(suspects, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
        .withColumn("rn", F.row_number().over(one)).where("rn = 1").select(F.col("h1").alias("uid"), "text")
        .mapInArrow(_features(k, m), "uid long, regs binary, n int, text string")
    )
    feats = written(feats, "features")
    ra = feats.select(F.col("uid").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    rb = feats.select(F.col("uid").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
    likely = pairs.join(ra, "a").join(rb, "b").mapInArrow(_estimated(m, threshold), "a long, b long")
    ta, tb = (feats.select(F.col("uid").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    linked = likely.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_proved(k, threshold), "a long, b long")
    comp = components(linked)
    members = texts.join(comp, texts.h1 == comp.node).select("h1", "h2", "first_id", "root")
    best = F.struct(F.col("first_id").isNull().alias("z"), "first_id", "h1", "h2")
    groups = members.groupBy("root").agg(F.min(best).alias("best"))
    settled = written(
        members.join(groups, "root").select("h1", "h2", F.col("best.first_id").alias("group_id"), ((F.col("h1") == F.col("best.h1")) & (F.col("h2") == F.col("best.h2"))).alias("wins")), "settled"
    )
    alone = (
        texts.where("copies > 1").join(settled, ["h1", "h2"], "left_anti")
        .select("h1", "h2", F.col("first_id").alias("group_id"), F.lit(True).alias("wins"))
    )
    return settled.select("h1", "h2", "group_id", "wins").union(alone), base


def drop_near_duplicates(docs: DataFrame, k: int = K, m: int = REGISTERS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without the rows that ``near_duplicates`` doesn't keep; all columns stay, whatever their names.

    Rows with a NULL or wordless text all stay.
    """
    decided, _ = _decide(docs, k, m, rows, threshold)
    c1, c2, rn, g1, g2, win = fresh(docs, "h1", "h2", "rn", "g1", "g2", "wins")
    h1, h2 = text_key("text")
    lose = decided.select(F.col("h1").alias(g1), F.col("h2").alias(g2), F.col("wins").alias(win))
    has = F.col("text").isNotNull() & F.col("text").rlike(r"[^\x00-\x20]")
    d = docs.withColumn(c1, F.when(has, h1)).withColumn(c2, F.when(has, h2))
    bare = d.where(F.col(c1).isNull()).select(*docs.columns)
    j = d.where(F.col(c1).isNotNull()).join(lose, (F.col(c1) == F.col(g1)) & (F.col(c2) == F.col(g2)), "left")
    one = Window.partitionBy(c1, c2).orderBy(F.col("doc_id").asc_nulls_last())
    kept = j.withColumn(rn, F.row_number().over(one)).where(F.col(win).isNull() | (F.col(win) & (F.col(rn) == 1)))
    return kept.select(*docs.columns).union(bare)
