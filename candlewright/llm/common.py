"""Shared pieces of the text operators: zero-copy word tables over Arrow batches, hashing, shared tables.

A *word* is a maximal run of bytes above 0x20 in the UTF-8 text (ASCII white space and control characters separate words).
NULL text counts as the empty text.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.shipping import ensure

U64 = np.uint64
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_RINV = pow(_R, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
BLOCK_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2^64; grown on demand."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 64)
        for key, base in (("up", _R), ("down", _RINV)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            np.cumprod(p, out=p)
            _POWERS[key] = p
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the texts; NULL becomes empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges of at most ``most`` bytes each (a longer document stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Word table of one block: starts, ends (byte positions), doc (row in block), first (first word of each row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.n_docs = data, len(offsets) - 1
        full = data > 32
        brk = np.zeros(len(data) + 1, bool)
        brk[offsets] = True
        before = np.empty_like(full)
        if len(full):
            before[0] = False
            before[1:] = full[:-1]
            after = np.empty_like(full)
            after[-1] = False
            after[:-1] = full[1:]
            self.starts = np.flatnonzero(full & (~before | brk[:-1]))
            self.ends = np.flatnonzero(full & (~after | brk[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, a function of its bytes alone."""
        up, down = _powers(len(self.data) + 1)
        c = np.empty(len(self.data) + 1, U64)
        c[0] = 0
        c[1:] = self.data
        c[1:] += U64(1)
        c[1:] *= up[:-1]
        np.cumsum(c, out=c)
        h = (c[self.ends] - c[self.starts]) * down[self.starts]
        return mix64(h)

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of all k-word windows that lie inside one row."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        pos = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n])
        g = np.zeros(n, U64)
        for i in range(k):
            g *= U64(0xD6E8FEB86659FD93)
            g += h[i : i + n]
        return pos, mix64(g[pos])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near to those asked for that the table doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        c = f"_cw_{n}"
        while c.lower() in have:
            c += "_"
        have.add(c.lower())
        out.append(c)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for shared files; a folder of our own only where it is unset and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "candlewright-shared")
    return where.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write the table into the shared folder and read it again."""
    return _written(df, what)[0]


def _written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/cw-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of so many rows, so that a worker's memory follows the block size and not the table; workers get the package."""
    ensure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(col: str = "text"):
    """Two 64-bit hashes; equal texts and only those share them (128 bits)."""
    t = F.col(col)
    return F.xxhash64(t), F.xxhash64(F.lit(0x5EED), t)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    Returns (node, root): root is the component's smallest node. Only nodes with an edge to another node occur. NULL ends and
    self loops are dropped. Each round is one pair of shuffles; the number of rounds grows with the logarithm of the
    diameter. Lineage is cut by a written table each round, so a lost executor costs one round at most.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    spark = edges.sparkSession
    e, path = _written(e, "edges")
    last = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(m, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        )
        ms = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(ms, "u")
        small = j.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            ms.select("u", F.col("m").alias("v"))
        )
        old = path
        e, path = _written(small.where("u != v").distinct(), "edges")
        removed(spark, old)
        got = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (got["n"], got["s"]) == last:
            break
        last = (got["n"], got["s"])
    else:
        raise RuntimeError("components did not converge")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
