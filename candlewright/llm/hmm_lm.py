"""Language-model scoring by a hidden Markov model over words.

Observations are words, known by their 64-bit hash. The model's table (a row of expected counts for every word of the corpus) is
kept in ranges of the hash and never in one place, so it grows with the vocabulary. Blocks of documents are encoded once. In each
round of Baum-Welch a block gets the rows of its own words, and sends back what it counted for them; both travel as arrays, one
for each block and range. In the table and on its way a word's counts are its number of occurrences and the shares of the states
in it, these in half precision (11 bits, nothing below 3e-8). Scoring is the scaled forward recursion over each whole document in
double precision, exact for the model in the table.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
from pyspark import RDD
from pyspark.core.rdd import Partitioner
from pyspark.serializers import pack_long
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from candlewright.shipping import ensure

from .common import BLOCK_BYTES, U64, Words, blocks, mix64, shared_dir

STATES, SMOOTH = 8, 0.01
#: Training ends when two rounds running add less than so many nats a word to the corpus log likelihood, the later one no more.
TOLERANCE = 0.005
#: One document of so many, chosen by a hash of its row, is in the first guess.
WARM = 32
#: The gain at which the rounds of the first guess end.
WARM_TOLERANCE = 0.02
#: Bytes of text in an encoded block, words that one recursion takes at a time.
BLOCK, SLICE = 12 << 20, 3 << 18
#: Words whose alphas and betas stay in a core's cache.
NEAR = 1 << 14
#: By number of states, what _room keeps.
_ROOM: dict[int, np.ndarray] = {}
#: Bytes of text for each range of the table of words; the table has from 8 to 4096 ranges.
RANGE = 64 << 20


class HMM:
    """start [S], trans [S, S], emit [V, S] (the probability of a symbol in a state); deterministic first guess."""

    def __init__(self, start: np.ndarray, trans: np.ndarray, emit: np.ndarray):
        self.start, self.trans, self.emit = (np.ascontiguousarray(x, dtype=np.float32) for x in (start, trans, emit))
        self._scaled: tuple[np.ndarray, np.ndarray] | None = None

    def scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """(each symbol's emissions divided by their sum, the logs of the sums)."""
        if self._scaled is None:
            c = self.emit.sum(1, dtype=np.float64)
            self._scaled = (self.emit / c[:, None]).astype(np.float32), np.log(c)
        return self._scaled

    @classmethod
    def first(cls, states: int, symbols: int) -> HMM:
        e = _guess(np.arange(symbols, dtype=U64), states)
        t = np.full((states, states), 0.5 / max(states - 1, 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(t, 0.5 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), t, e / e.sum(0))


def _guess(keys: np.ndarray, states: int) -> np.ndarray:
    """First weights [len(keys), states]; far from alike, else the first rounds gain next to nothing."""
    u = mix64(keys[:, None] * U64(states) + np.arange(states, dtype=U64) + U64(12345))
    return -np.log(((u >> U64(11)).astype(np.float64) + 0.5) / 2.0**53)


class Model(NamedTuple):
    """start [S], trans [S, S]; table: records (range, ("table", sorted keys, packed counts, _)) in ``parts`` ranges of the key.

    A word's emission is (its counts + smooth) / total; total holds the smoothing of all words and of one more, the unseen.
    """

    start: np.ndarray
    trans: np.ndarray
    table: RDD
    parts: int
    total: np.ndarray
    smooth: float
    symbols: int | None
    source: tuple[DataFrame, RDD, RDD] | None = None  #: the documents of the training, encoded, and what they ask for


def _layout(first: np.ndarray, length: np.ndarray):
    """(rows by falling length, rows that reach each step, where each step begins, places): the words step after step."""
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    f, n = first[order], length[order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), side="left")
    base = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
    row = np.arange(base[-1]) - np.repeat(base[:-1], active)
    return order, active, base, f[row] + np.repeat(np.arange(steps), active)


def _forward(m: HMM, e: np.ndarray, active: np.ndarray, base: np.ndarray, every: int, a: np.ndarray | None = None):
    """Lockstep forward recursion, scaled to a sum of 1 at every so many steps: log scales of the rows, the emissions' left out.

    ``a`` gets the (scaled) alphas of all steps; then only the sum of all rows' log scales is returned. Where a row ends, its sum
    counts into its likelihood.
    """
    start, trans, one = (x.astype(e.dtype, copy=False) for x in (m.start, m.trans, np.ones((len(m.start), len(m.start)))))
    log = np.zeros(active[0] if len(active) else 0)
    ends = np.append(active[1:], 0)
    hold = [np.empty((len(log), len(start)), e.dtype) for _ in range(2)] if a is None else None
    prev, at, sums = None, base.tolist(), []
    for t, (n, left) in enumerate(zip(active.tolist(), ends.tolist(), strict=True)):
        now = a[at[t] : at[t + 1]] if hold is None else hold[t & 1][:n]
        if t:
            np.dot(prev[:n], trans, out=now)
            now *= e[at[t] : at[t + 1]]
        else:
            np.multiply(e[:n], start, out=now)
        if t % every == every - 1:
            c = np.dot(now, one)  # the sum in every column, as a division row by row costs several times as much
            now /= c
            if hold is None:
                sums.append(c[:, 0])
            else:
                log[:n] += np.log(c[:, 0])
        if left < n:
            c = np.dot(now[left:], one[0])
            if hold is None:
                sums.append(c)
            else:
                log[left:n] += np.log(c)
        prev = now
    return log if hold is not None else np.log(np.concatenate(sums)).sum(dtype=np.float64) if sums else 0.0


def log_likelihood(m: HMM, obs: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Exact log likelihood of each row's symbols, in double precision; 0 for an empty row."""
    order, active, base, pos = _layout(first, length)
    emit, c = m.scaled()
    out = np.zeros(len(length))
    out[order] = _forward(m, np.take(emit, obs[pos], axis=0).astype(np.float64), active, base, 8)
    given = np.concatenate([[0], np.cumsum(c[obs])])
    return out + given[first + length] - given[first]


def expected_counts(m: HMM, obs: np.ndarray, first: np.ndarray, length: np.ndarray):
    """E-step: (start [S], transitions [S, S], gamma [len(obs), S])."""
    start, trans, g, pos, _ = _expected(m, obs, first, length)
    gamma = np.zeros((len(obs), len(start)), np.float32)
    gamma[pos] = g
    return start, trans, gamma


def _room(size: int, states: int) -> np.ndarray:
    """Two arrays [size, states] for a slice, kept for the next one of the task: fresh ones would cost as much in page faults as a recursion."""
    have = _ROOM.get(states)
    if have is not None and have.shape[1] >= size:
        return have[:, :size]
    new = np.empty((2, size, states), np.float32)
    if size <= 2 * SLICE:
        _ROOM[states] = new
    return new


def _expected(m: HMM, obs: np.ndarray, first: np.ndarray, length: np.ndarray):
    """(start, transitions, gamma by step, places of its rows, log likelihood of all rows together); gamma holds until the next call.

    Alphas and betas carry scales of their own; each word's gamma and each pair's share are divided by their sums, so that the
    scales fall out. What isn't recursion is done on some steps at once, as many as stay in a core's cache.
    """
    s = len(m.start)
    _, active, base, pos = _layout(first, length)
    if not len(active):
        return np.zeros(s), np.zeros((s, s)), np.zeros((0, s), np.float32), pos, 0.0
    emit, c = m.scaled()
    o = obs[pos]
    e, a = _room(len(o), s)
    np.take(emit, o, axis=0, out=e, mode="clip")
    one, at = np.ones((s, s), np.float32), base.tolist()
    ll = _forward(m, e, active, base, 2, a) + c[o].sum()
    back = np.ascontiguousarray(m.trans.T)
    trans = np.zeros((s, s))
    room = np.empty((min(len(o), NEAR + int(active[0])), s), np.float32)
    last, after = len(active), None  # steps from there on are done; the first of them as emission times beta
    while last:
        i = min(int(np.searchsorted(base, at[last] - NEAR, side="left")), last - 1)
        lo, hi = at[i], at[last]
        b = room[: hi - lo]
        for t in range(last - 1, i - 1, -1):
            j, k = at[t] - lo, at[t + 1] - lo
            if after is None:
                b[j:k] = 1
            else:
                n = len(after)
                np.dot(after, back, out=b[j : j + n])
                if j + n < k:
                    b[j + n : k] = 1
            after = e[at[t] : at[t + 1]]  # from here on e holds emission times beta
            after *= b[j:k]
            if not t & 1:
                after /= np.dot(after, one)
        g = a[lo:hi]
        b *= g
        total = np.dot(b, one)
        b /= total
        g /= total
        # the pairs that begin in these steps; their later words are rows of the step after
        f, z = at[i + 1], at[min(last + 1, len(active))]
        if f < z:
            n = active[i + 1 : min(last + 1, len(active))]
            before = np.arange(f, z) - np.repeat(active[i : i + len(n)], n)
            trans += np.dot(np.take(a, before, axis=0, mode="clip").T, e[f:z])
        g[:] = b
        last = i
    return a[: at[1]].sum(0, dtype=np.float64), trans * m.trans, a, pos, ll


def _range(p: int) -> int:
    return p


def _home(b: int) -> int:
    """Partition of a block."""
    return b >> 20


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the equal ranges begins in sorted keys, and their end."""
    bound = np.array([(p << 64) // parts for p in range(1, parts)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(keys, bound), [len(keys)]]).astype(np.int64)


def _placed(rdd: RDD, parts: int, place: Callable[[int], int]) -> RDD:
    """partitionBy that hands over each record as soon as it is made; Spark's own holds a task's until there are ten for each
    partition, which is all its blocks, and sends them as one. The result is serialised as any other table: else a union with one
    would first send both through Python workers of their own."""
    sc = rdd.ctx
    one = sc._unbatched_serializer

    def run(_: int, records: Iterable) -> Iterator[bytes]:
        for rec in records:
            yield pack_long(place(rec[0]) % parts)
            yield one.dumps([rec])

    keyed = rdd.mapPartitionsWithIndex(run, preservesPartitioning=True)
    keyed._bypass_serializer = True
    pairs = sc._jvm.PairwiseRDD(keyed._jrdd.rdd()).asJavaPairRDD()
    out = RDD(sc._jvm.PythonRDD.valueOfPair(pairs.partitionBy(sc._jvm.PythonPartitioner(parts, id(place)))), sc, sc.serializer)
    out.partitioner = Partitioner(parts, place)
    return out


def _some_rows(rows: Iterable[Row]) -> Iterator[list[Row]]:
    """Rows (doc_id, text) together, of BLOCK_BYTES of text at most (a longer text stands alone)."""
    out, size = [], 0
    for r in rows:
        n = len(r[1] or b"")
        if out and (size + n > BLOCK_BYTES or len(out) == 4000):
            yield out
            out, size = [], 0
        out.append(r)
        size += n
    if out:
        yield out


def _encoded(docs: DataFrame, symbols: int | None) -> RDD:
    """Records (block, ("block", words as places in keys, words of each row, sorted keys, ids, NULL ids, NULL texts)).

    The rows come as bytes to the worker that also places the blocks: Arrow would need a second worker for each task, whose memory
    stays for the rounds after.
    """
    ensure(docs.sparkSession)

    def run(part: int, rows: Iterable[Row]) -> Iterator[tuple[int, tuple]]:
        seq = count(part << 20)
        held, size = [], 0

        def block():
            h, length, ids, no_id, no_text = (np.concatenate(x) for x in zip(*held, strict=True))
            # long texts side by side: a slice takes as many steps as its longest text has words
            order = np.argsort(-length, kind="stable")
            first, n = (np.cumsum(length) - length)[order], length[order]
            h = h[np.arange(len(h)) + np.repeat(first - (np.cumsum(n) - n), n)]
            length, ids, no_id, no_text = (x[order] for x in (length, ids, no_id, no_text))
            keys, obs = np.unique(h, return_inverse=True)
            return next(seq), ("block", obs.astype(np.int32), length.astype(np.int32), keys, ids, no_id, no_text)

        for some in _some_rows(rows):
            texts = [r[1] or b"" for r in some]
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            w = Words(np.frombuffer(b"".join(texts), np.uint8), off)
            h = w.hashes()
            if symbols is not None:
                h = mix64(h % U64(symbols))
            null = [np.array([r[c] is None for r in some]) for c in (0, 1)]
            held.append((h, w.counts, np.array([r[0] or 0 for r in some], np.int64), *null))
            size += int(off[-1])
            if size >= BLOCK:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).rdd
    return _placed(rows.mapPartitionsWithIndex(run), max(rows.getNumPartitions(), 1), _home)


def _asks(enc: RDD, parts: int) -> RDD:
    """Records (range, ("ask", block, keys)): the words of each block."""

    def run(rec):
        b, x = rec
        at = _cuts(x[3], parts)
        return [(p, ("ask", b, x[3][at[p] : at[p + 1]])) for p in range(parts) if at[p] < at[p + 1]]

    return _placed(enc.flatMap(run), parts, _range)


def _beside(*rdds: RDD) -> RDD:
    """The records of equal partitions in one, those of the first table first."""
    out = rdds[0]
    for r in rdds[1:]:
        out = out.union(r)
    if out.getNumPartitions() != rdds[0].getNumPartitions():
        raise RuntimeError("tables are not partitioned alike")
    return out


def _places(keys: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, ask), max(len(keys) - 1, 0))
    return at, keys[at] == ask if len(keys) else np.zeros(len(ask), bool)


def _pack(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares of the states, their sum) of rows of counts."""
    n = counts.sum(1)
    return (counts / np.maximum(n, 1e-30)[:, None]).astype(np.float16), n.astype(np.float32)


def _unpack(x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts in single precision; the shares of a row add up to 1 again."""
    share = x[0].astype(np.float32)
    return share * (x[1] / np.maximum(share.sum(1), 1e-30))[:, None]


def _with_emissions(m: Model, asks: RDD, enc: RDD) -> tuple[RDD, RDD]:
    """(the encoded blocks, before each of them the packed counts of its words; these counts alone)."""

    states = len(m.start)

    def look_up(records):
        keys, share, n = np.zeros(0, U64), None, None
        for p, x in records:
            if x[0] == "table":
                keys, (share, n) = x[1], x[2]
                continue
            at, seen = _places(keys, x[2])
            got = (np.zeros((len(at), states), np.float16), np.zeros(len(at), np.float32))
            if seen.any():
                got[0][seen], got[1][seen] = share[at[seen]], n[at[seen]]
            yield x[1], ("emit", p, got)

    sent = _placed(_beside(m.table, asks).mapPartitions(look_up), enc.getNumPartitions(), _home)
    return _beside(sent, enc), sent


def _blocks_met(records, start: np.ndarray, trans: np.ndarray, total: np.ndarray, smooth: float):
    """(block, its model, its record, first words of rows) from what _with_emissions gives."""
    rows, scale = defaultdict(dict), (1 / total).astype(np.float32)
    for b, x in records:
        if x[0] == "emit":
            rows[b][x[1]] = x[2]
            continue
        got = rows.pop(b, {})
        emit = np.concatenate([_unpack(got[p]) for p in sorted(got)]) if got else np.zeros((0, len(start)), np.float32)
        emit += np.float32(smooth)
        emit *= scale
        yield b, HMM(start, trans, emit), x, np.concatenate([[0], np.cumsum(x[2], dtype=np.int64)])


def _count(m: Model):
    """E-step over blocks: (range, ("add", block, packed counts of the words asked for)) and (range, ("stats", sums))."""
    start, trans, total, smooth, parts, s = m.start, m.trans, m.total, m.smooth, m.parts, len(m.start)

    def run(records):
        for b, h, x, off in _blocks_met(records, start, trans, total, smooth):
            obs, length, keys = x[1], x[2], x[3]
            counts, stats = np.zeros((s, len(keys))), np.zeros(s * s + s + 2)
            for i, j in blocks(off, SLICE):
                o = obs[off[i] : off[j]]
                a, t, g, pos, ll = _expected(h, o, off[i:j] - off[i], length[i:j].astype(np.int64))
                stats += np.concatenate([t.ravel(), a, [ll, len(o)]])
                o = o[pos].astype(np.int64)
                for k in range(s):
                    counts[k] += np.bincount(o, g[:, k], minlength=len(keys))
            at, (share, n) = _cuts(keys, parts), _pack(counts.T)
            for p in range(parts):
                if at[p] < at[p + 1]:
                    yield p, ("add", b, (share[at[p] : at[p + 1]], n[at[p] : at[p + 1]]))
            yield b % parts, ("stats", stats)
        _ROOM.clear()  # idle workers hold nothing

    return run


def _gather(states: int):
    """M-step over a range: its table with the new counts, and the sums that came to it."""

    def run(records):
        keys, where, part, counts, stats = np.zeros(0, U64), {}, None, np.zeros((0, states)), np.zeros(states * states + states + 2)
        for part, x in records:
            if x[0] == "table":
                keys, counts = x[1], np.zeros((len(x[1]), states))
            elif x[0] == "ask":
                where[x[1]] = np.searchsorted(keys, x[2])
            elif x[0] == "add":
                counts[where[x[1]]] += _unpack(x[2])
            else:
                stats += x[1]
        if part is not None:
            yield part, ("table", keys, _pack(counts), stats)

    return run


def _sums(table: RDD, states: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of counts by state and number of words, sums of the E-step)."""
    one = table.map(lambda r: (np.append(_unpack(r[1][2]).sum(0, dtype=np.float64), len(r[1][1])), r[1][3]))
    return one.fold((np.zeros(states + 1), np.zeros(states * states + states + 2)), lambda a, b: (a[0] + b[0], a[1] + b[1]))


def _keep(table: RDD) -> None:
    """Write the table into the checkpoint folder now, and make no other copy; a job of ours to bring this about would have a second
    Python worker in its tasks and make a part of the table twice."""
    table.checkpoint()
    table._jrdd.rdd().doCheckpoint()


def _drop_shuffles(*rdds: RDD) -> None:
    """Delete the files of the shuffles that made these tables; nothing reads them once what follows is in the checkpoint folder."""
    for r in rdds:
        j, cleaner = r._jrdd.rdd(), r.ctx._jsc.sc().cleaner()
        while cleaner.isDefined() and j.dependencies().size():
            d = j.dependencies().head()
            if d.getClass().getSimpleName() == "ShuffleDependency":
                cleaner.get().doCleanupShuffle(d.shuffleId(), True)
                break
            j = d.rdd()


def _forget(table: RDD) -> None:
    """Remove a table's file, and let Spark drop the shuffles that nothing refers to any more."""
    sc, file = table.ctx, table.getCheckpointFile()
    if file:
        path = sc._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    sc._jvm.System.gc()


def fit(
    docs: DataFrame, states: int = STATES, symbols: int | None = None, rounds: int | None = None, smooth: float = SMOOTH, tolerance: float = TOLERANCE, warm: int = WARM
) -> Model:
    """Baum-Welch over every document, for so many rounds or until it has converged: two rounds running add less than the
    tolerance to the log likelihood a word and the later one no more than the other, as early rounds may gain little, but then
    more each time. Words are told apart by their 64-bit hash, or by that modulo ``symbols``. NULL, empty and wordless texts add
    nothing; repeated rows count each time. Of the table, doc_id and text are read.

    Where no number of rounds is given, the first guess comes from rounds over one document of ``warm``, whatever the size of the
    table (0: from the hash of the words, as with given rounds). It decides where the search begins and nothing else: all
    rounds after it count every document, and go on until they have converged.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts, guess = min(max(8, size // RANGE), 4096), None
    if rounds is None and warm:
        some = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(warm)) == 0)
        some = some.select("doc_id", "text").repartition(max(1, size // (warm * BLOCK)))
        guess, words = _train(some, states, symbols, None, smooth, max(tolerance, WARM_TOLERANCE), None, parts)
        _drop_shuffles(*guess.source[1:])
        guess = guess if words else None
    return _train(docs, states, symbols, rounds, smooth, tolerance, guess, parts)[0]


def _train(docs: DataFrame, states: int, symbols: int | None, rounds: int | None, smooth: float, tolerance: float, guess: Model | None, parts: int) -> tuple[Model, float]:
    """(model, words counted in the last round)."""
    sc = docs.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(docs.sparkSession))
    enc = _encoded(docs, symbols)
    asks = _asks(enc, parts)
    none = stats = np.zeros(states * states + states + 2)
    hashed = guess is None

    def begin(records):
        p, keys, known = None, [], None
        for p, x in records:
            if x[0] == "table":
                known = x
            else:
                keys.append(x[2])
        if keys:
            k = np.unique(np.concatenate(keys))
            if hashed:
                yield p, ("table", k, _pack(_guess(k, states)), none)
                return
            share, n = np.zeros((len(k), states), np.float16), np.zeros(len(k), np.float32)
            if known is not None:
                at, seen = _places(known[1], k)
                share[seen], n[seen] = known[2][0][at[seen]], known[2][1][at[seen]]
            yield p, ("table", k, (share, n), none)

    table = (asks if guess is None else _beside(guess.table, asks)).mapPartitions(begin, preservesPartitioning=True)
    _keep(table)  # the hashed one too: what reads an unkept table has a second Python worker in each of its tasks
    size = _sums(table, states)[0]
    if guess is None:
        h = HMM.first(states, 1)
        m = Model(h.start, h.trans, table, parts, np.maximum(size[:-1], 1e-300), 0.0, symbols)
    else:
        m = Model(guess.start, guess.trans, table, parts, size[:-1] + smooth * (size[-1] + 1), smooth, symbols)
        _forget(guess.table)
    last, gain = -np.inf, np.inf  # of the log likelihood a word
    for _ in count() if rounds is None else range(rounds):
        met, sent = _with_emissions(m, asks, enc)
        adds = _placed(met.mapPartitions(_count(m)), parts, _range)
        table = _beside(m.table, asks, adds).mapPartitions(_gather(states), preservesPartitioning=True)
        _keep(table)
        size, stats = _sums(table, states)
        _drop_shuffles(sent, adds)
        del adds, met, sent
        if rounds is None:
            now = stats[-2] / max(stats[-1], 1)
            if now - last <= gain < tolerance or not stats[-1]:
                _forget(table)
                break
            gain, last = now - last, now
        t, a = stats[: states * states].reshape(states, states) + smooth, stats[states * states : -2] + smooth
        old, m = m.table, Model(a / a.sum(), t / t.sum(1, keepdims=True), table, parts, size[:-1] + smooth * (size[-1] + 1), smooth, symbols)
        _forget(old)
        del old
    return m._replace(source=(docs, enc, asks)), stats[-1]


def score(docs: DataFrame, m: Model) -> DataFrame:
    """(doc_id, n_words, log_likelihood, nats_per_word) of every document, its whole text.

    A NULL text has NULL figures; an empty or wordless text 0 words, likelihood 1 (log 0) and NULL nats per word. A word that the
    model hasn't seen has the smoothed mass of one.
    """
    start, trans, total, smooth = m.start, m.trans, m.total, m.smooth
    known = m.source is not None and m.source[0] is docs
    enc = m.source[1] if known else _encoded(docs, m.symbols)
    asks = m.source[2] if known else _asks(enc, m.parts)

    def run(records):
        for _, h, x, off in _blocks_met(records, start, trans, total, smooth):
            _, obs, length, _, ids, no_id, no_text = x
            for i, j in blocks(off, SLICE):
                ll = log_likelihood(h, obs[off[i] : off[j]], off[i:j] - off[i], length[i:j].astype(np.int64))
                for k, v in zip(range(i, j), ll.tolist(), strict=True):
                    n = int(length[k])
                    key = None if no_id[k] else int(ids[k])
                    yield (key, None, None, None) if no_text[k] else (key, n, v, -v / n if n else None)

    rows = _with_emissions(m, asks, enc)[0].mapPartitions(run)
    return docs.sparkSession.createDataFrame(rows, "doc_id long, n_words long, log_likelihood double, nats_per_word double", verifySchema=False)
