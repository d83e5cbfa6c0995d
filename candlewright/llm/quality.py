"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax over three classes.

Class 0 is clean, 1 low quality, 2 toxic. Training is numpy stochastic gradient descent (Adagrad steps) on the driver, over at
most ``train_rows`` labelled documents chosen by a hash of their id, so what the driver holds is bounded by that parameter. The
tasks make the documents' bags of features; the driver gets these and no text.
Scoring folds the vectors into one logit per bucket and class (the average is linear), a table of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, blocks, fresh, small_batches, text_buffers

BITS, DIM, NGRAMS, CLASSES = 17, 8, (3, 5), 3
TRAIN_ROWS, EPOCHS, RATE, SCALE = 8000, 5, 0.3, 64.0


def ngram_buckets(data: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """Bucket of the n bytes that begin at each position; white space counts as one boundary sign."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    b = np.where(data <= 32, 32, data).astype(U64)
    m = len(b) - n + 1
    x = np.full(m, U64(n))
    for i in range(n):
        x = (x << U64(8)) | b[i : i + m]
    return ((x * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


def word_buckets(w: Words, bits: int = BITS) -> np.ndarray:
    return (w.hashes() >> U64(64 - bits)).astype(np.int64)


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """All buckets of one document."""
    data = np.frombuffer(text, np.uint8)
    w = Words(data, np.array([0, len(data)]))
    return np.concatenate([word_buckets(w, bits), *(ngram_buckets(data, n, bits) for n in NGRAMS)])


def bag(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of one document, in six bytes a bucket, or eight where one occurs more than 65535 times."""
    b, n = np.unique(features(text, bits), return_counts=True)
    return b.astype(np.int32), n.astype(np.uint16 if n.max(initial=0) < 65536 else np.uint32)


def pack_bag(b: np.ndarray, n: np.ndarray) -> bytes:
    """A bag without loss in about a byte a bucket: gaps and counts by byte planes, compressed."""
    x = np.concatenate([np.diff(b, prepend=0).astype(np.uint32), n.astype(np.uint32)])
    return zlib.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    m = len(x) // 2
    return np.cumsum(x[:m], dtype=np.int64).astype(np.int32), x[m:]


class Bags:
    """Packed bags as a sequence, unpacked when asked for, so that the driver holds a byte a bucket."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return unpack_bag(self.packed[i])


def _bags(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            got = [pack_bag(*bag(data[off[i] : off[i + 1]].tobytes(), bits)) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(got, pa.binary())], names=["doc_id", "y", "bag"])

    return run


class Model:
    """vectors [2^bits, dim], out [dim, classes], bias [classes]."""

    def __init__(self, bits: int = BITS, dim: int = DIM, seed: int = 7):
        g = np.random.default_rng(seed)
        self.bits = bits
        self.vectors = g.uniform(-0.5, 0.5, (1 << bits, dim)) / dim
        self.out = g.normal(0, 1 / np.sqrt(dim), (dim, CLASSES))
        self.bias = np.zeros(CLASSES)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]] | Bags, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 32, seed: int = 7) -> Model:
        """Minibatch SGD over bags of (bucket, count); classes weigh by the square root of their inverse frequency."""
        g = np.random.default_rng(seed)
        v, o, c = self.vectors, self.out, self.bias
        size, dim = v.shape
        freq = np.maximum(np.bincount(y, minlength=CLASSES), 1) / max(len(y), 1)
        weight = 1 / np.sqrt(freq)
        sv, so, sc = np.full(size, 1e-6), np.full(o.shape, 1e-6), np.full(CLASSES, 1e-6)
        done, total = 0, epochs * -(-len(docs) // batch)
        for _ in range(epochs):
            order = g.permutation(len(docs))
            for at in range(0, len(order), batch):
                step, done = rate * max(0.05, 1 - done / total), done + 1
                pick = order[at : at + batch]
                part = [docs[i] for i in pick]
                n = np.array([len(b) for b, _ in part])
                idx = np.concatenate([b for b, _ in part])
                share = np.concatenate([m / max(int(m.sum(dtype=np.int64)), 1) for _, m in part])
                row = np.repeat(np.arange(len(pick)), n)
                x = np.stack([np.bincount(row, v[idx, k] * share, minlength=len(pick)) for k in range(dim)], axis=1) * SCALE
                z = x @ o + c
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                p *= weight[y[pick]][:, None] / len(pick)
                gx, go, gc = p @ o.T * SCALE, x.T @ p, p.sum(0)
                used, inv = np.unique(idx, return_inverse=True)
                gv = np.stack([np.bincount(inv, gx[row, k] * share, minlength=len(used)) for k in range(dim)], axis=1)
                sv[used] += (gv**2).mean(1)
                so += go**2
                sc += gc**2
                v[used] -= step * gv / np.sqrt(sv[used])[:, None]
                o -= step * go / np.sqrt(so)
                c -= step * gc / np.sqrt(sc)
        return self

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each bucket and class, and the bias."""
        return (self.vectors @ self.out * SCALE).astype(np.float32), self.bias.copy()


def score_block(data: np.ndarray, off: np.ndarray, tab: np.ndarray, bias: np.ndarray, bits: int) -> np.ndarray:
    """Class probabilities [rows, classes] of the documents of one block."""
    n = len(off) - 1
    total, count = np.zeros((n, CLASSES)), np.zeros(n)
    w = Words(data, off)
    parts = [(word_buckets(w, bits), w.first[:-1], w.first[1:])]
    for k in NGRAMS:
        parts.append((ngram_buckets(data, k, bits), off[:-1], np.maximum(off[1:] - k + 1, off[:-1])))
    for buckets, a, b in parts:
        b = np.minimum(b, len(buckets))
        a = np.minimum(a, b)
        count += b - a
        for c in range(CLASSES):
            s = np.zeros(len(buckets) + 1)
            np.cumsum(tab[buckets, c], out=s[1:], dtype=np.float64)
            total[:, c] += s[b] - s[a]
    z = total / np.maximum(count, 1)[:, None] + bias
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 7) -> Model:
    """Fit on at most ``train_rows`` rows of ``docs`` that ``labels`` covers.

    A toxic label of 1 makes class 2, else a quality of 0 class 1, else class 0. Rows with a NULL id, text or quality are left
    out; a document with several labels takes the worst of them, of several rows of an id the least text counts; without any
    labelled row the model is the untrained one.
    """
    small_batches(docs.sparkSession)
    lab = (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .select("doc_id", F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0).alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(train_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    m = Model(seed=seed)
    one = texts.join(F.broadcast(lab), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # train_rows bounds the broadcast
    got = one.select("doc_id", "y", "text").mapInArrow(_bags(m.bits), "doc_id long, y int, bag binary").toArrow()
    if not got.num_rows:
        return m
    y = got["y"].to_numpy()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    bags = Bags([got["bag"][i].as_py() for i in order.tolist()])
    return m.fit(bags, y[order].astype(np.int64), seed=seed)


def score_documents(docs: DataFrame, model: Model, p_col: str = "p") -> DataFrame:
    """All columns of ``docs`` and ``p_col``: ARRAY<DOUBLE> of the three class probabilities.

    A NULL or empty text has no features; its probabilities are those of the bias alone. Long texts are read whole.
    """
    small_batches(docs.sparkSession)
    (tab, bias), bits = model.table(), model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            col = batch.column(at)
            if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
                col = col.cast(pa.string())
            data, off = text_buffers(col)
            p = np.zeros((len(batch), CLASSES))
            for i, j in blocks(off):
                p[i:j] = score_block(data[off[i] : off[j]], off[i : j + 1] - off[i], tab, bias, bits)
            arr = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * CLASSES), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, arr], names=[*batch.schema.names, p_col])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(p_col, ArrayType(DoubleType()))]))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose probability of being clean is at least ``threshold``; all columns stay, whatever their names.

    NULL and empty texts carry no evidence against them and stay. Repeated rows get equal decisions.
    """
    (p,) = fresh(docs, "p")
    s = score_documents(docs, train(docs, labels, train_rows), p)
    bare = F.col("text").isNull() | (F.col("text") == "")
    return s.where(bare | (F.col(p)[0] >= threshold)).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, p_clean, p_low, p_toxic, accepted) for every document; see ``accepted`` for NULL and empty texts."""
    d = docs.select("doc_id", "text")
    s = score_documents(d, train(docs, labels, train_rows), "p")
    bare = F.col("text").isNull() | (F.col("text") == "")
    return s.select(
        "doc_id", *(F.col("p")[i].alias(n) for i, n in enumerate(("p_clean", "p_low", "p_toxic"))), (bare | (F.col("p")[0] >= threshold)).alias("accepted")
    )
