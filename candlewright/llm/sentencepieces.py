"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The best segmentation is the one whose piece scores have the greatest sum. At each position the automaton's output links give
every piece that ends there; each relaxes the best score. The recursion runs in lockstep over a block's distinct units (a run of
spaces and the signs up to the next space): where no piece has a space after another sign, a text's best segmentation is the
units' best segmentations one after the other, so each distinct unit is solved once a block. A model with such pieces is refused.
A unit too long for company (texts without spaces) is walked by itself.
Signs that no piece covers fall back to byte pieces. The literal sign U+2581 is coded in bytes, so every text comes back exactly.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _powers, blocks, fresh, mix64, small_batches, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_CACHE: dict[int, Automaton] = {}
BLOCK = 2 << 20
#: Bytes from which a unit is walked by itself: so long ones are few, and steps over a handful of units cost more than a loop.
LONG = 256


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    i = 0

    def varint(i):
        x = s = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << s
            s += 7
            if b < 128:
                return x, i

    while i < len(buf):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 1:
            v, i = buf[i : i + 8], i + 8
        elif kind == 2:
            n, i = varint(i)
            v, i = buf[i : i + n], i + n
        else:
            v, i = struct.unpack("<f", buf[i : i + 4])[0], i + 4
        yield key >> 3, v


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a .model file's bytes, by id."""
    out = []
    for n, v in _fields(model):
        if n == 1:
            f = dict(_fields(v))
            out.append((f.get(1, b"").decode(), float(f.get(2, 0.0)), int(f.get(3, _NORMAL))))
    return out


class Automaton:
    """Aho-Corasick over the pieces' bytes (the space sign as byte 0x20), with its goto function completed to a dense table."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        normal = [s for _, s, t in pieces if t == _NORMAL]
        top, low = (max(normal), min(normal)) if normal else (0.0, 0.0)
        self.unknown = low - 10.0
        self.byte_ids = np.full(256, next((i for i, p in enumerate(pieces) if p[2] == _UNKNOWN), 0), np.int32)
        self.text_of: list[bytes] = []
        kids: list[dict[int, int]] = [{}]
        depth, piece, score = [0], [-1], [0.0]
        for i, (p, s, t) in enumerate(pieces):
            raw = p.replace("▁", " ").encode()
            if t == _BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
                self.text_of.append(bytes([int(p[1:-1], 16)]))
                continue
            self.text_of.append(raw if t in (_NORMAL, _USER) else b"")
            if t not in (_NORMAL, _USER) or not raw:
                continue
            if b" " in raw.lstrip(b" "):
                raise ValueError(f"piece {i} has a space after another sign")
            at = 0
            for b in raw:
                if b not in kids[at]:
                    kids[at][b] = len(kids)
                    kids.append({})
                    depth.append(depth[at] + 1)
                    piece.append(-1)
                    score.append(0.0)
                at = kids[at][b]
            if piece[at] < 0:
                piece[at], score[at] = i, (len(p.encode()) * top - 0.1 if t == _USER else s)
        n = len(kids)
        kind = np.uint16 if n < 65536 else np.int32
        self.depth, self.piece, self.score = np.array(depth, np.int32), np.array(piece, np.int32), np.array(score)
        self.goto = np.zeros((n, 256), kind)
        fail, link = np.zeros(n, np.int64), np.zeros(n, np.int32)
        level = [(0, b, c) for b, c in kids[0].items()]
        for _, b, c in level:
            self.goto[0, b] = c
        while level:
            s = np.array([c for _, _, c in level])
            f = fail[s]
            link[s] = np.where(self.piece[f] >= 0, f, link[f])
            self.goto[s] = self.goto[f]
            deeper = [(c, b, x) for _, _, c in level for b, x in kids[c].items()]
            for p, b, c in deeper:
                fail[c] = self.goto[fail[p], b]
            if deeper:
                a = np.array(deeper)
                self.goto[a[:, 0], a[:, 1]] = a[:, 2]
            level = deeper
        self.link = link  # nearest proper suffix that is a piece; 0: none
        self.out = np.where(self.piece >= 0, np.arange(n), link).astype(np.int32)
        size = np.array([len(x) for x in self.text_of])
        self.text_off = np.concatenate([[0], np.cumsum(size)])
        self.text_bytes = np.frombuffer(b"".join(self.text_of), np.uint8)
        self._lists: tuple | None = None

    @classmethod
    def of(cls, model: bytes) -> Automaton:
        key = hash(model)
        if key not in _CACHE:
            _CACHE[key] = cls(read_pieces(model))
        return _CACHE[key]

    def solve(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi of each unit data[start:start+size]: (ids, offsets into ids, best scores)."""
        big = size > long
        if not big.any():
            return self._lockstep(data, start, size)
        few = np.flatnonzero(~big)
        ids, off, score = self._lockstep(data, start[few], size[few])
        alone = {int(i): self._walk(data[start[i] : start[i] + size[i]].tobytes()) for i in np.flatnonzero(big)}
        count, scores = np.zeros(len(start), np.int64), np.zeros(len(start))
        count[few], scores[few] = np.diff(off), score
        for i, (x, s) in alone.items():
            count[i], scores[i] = len(x), s
        to = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(to[-1], np.int32)
        out[np.arange(len(ids)) + np.repeat(to[few] - off[:-1], count[few])] = ids
        for i, (x, _) in alone.items():
            out[to[i] : to[i + 1]] = x
        return out, to, scores

    def _walk(self, raw: bytes) -> tuple[np.ndarray, float]:
        """(ids, best score) of one unit, byte after byte."""
        if self._lists is None:
            self._lists = tuple(x.tolist() for x in (self.out, self.link, self.depth, self.score, self.piece, self.byte_ids))
        out, link, depth, score, piece, byte_ids = self._lists
        goto, n, none = memoryview(self.goto.ravel()), len(raw), float("-inf")
        best, back, ids = array("d", [none]) * (n + 1), array("i", [1]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        state = lead = 0
        for t, b in enumerate(raw):
            if b & 0xC0 != 0x80:
                lead = t
            state = goto[state << 8 | b]
            s, top, k, p = out[state], none, 1, byte_ids[b]
            while s:
                c = best[t + 1 - depth[s]] + score[s]
                if c > top:
                    top, k, p = c, depth[s], piece[s]
                s = link[s]
            if t + 1 == n or raw[t + 1] & 0xC0 != 0x80:
                c = best[lead] + self.unknown
                if c > top:
                    top, k, p = c, 1, byte_ids[b]
            best[t + 1], back[t + 1], ids[t + 1] = top, k, p
        path, at = [], n
        while at:
            path.append(ids[at])
            at -= back[at]
        return np.array(path[::-1], np.int32), best[n]

    def _lockstep(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``solve`` for all units at once, a step for each byte of the longest."""
        order = np.argsort(-size, kind="stable")
        st, n = start[order], size[order]
        base = np.concatenate([[0], np.cumsum(n + 1)])[:-1]
        total = int((n + 1).sum())
        best = np.full(total, -np.inf)
        best[base] = 0.0
        back, ids = np.ones(total, np.int32), np.zeros(total, np.int32)
        state = np.zeros(len(n), np.int64)
        lead = np.zeros(len(n), np.int64)
        longest = int(n[0]) if len(n) else 0
        active = np.searchsorted(-n, -np.arange(longest), side="left")
        for t, k in enumerate(active):
            b = data[st[:k] + t]
            here = base[:k] + t + 1
            ids[here] = self.byte_ids[b]
            first = (b & 0xC0) != 0x80
            lead[:k][first] = t
            state[:k] = self.goto[state[:k], b]
            out = self.out[state[:k]]
            row = np.flatnonzero(out)
            s = out[row]
            while len(row):
                h = here[row]
                length = self.depth[s]
                cand = best[h - length] + self.score[s]
                win = cand > best[h]
                hw = h[win]
                best[hw], back[hw], ids[hw] = cand[win], length[win], self.piece[s[win]]
                s = self.link[s]
                more = s > 0
                row, s = row[more], s[more]
            # a sign ends where the next byte isn't a continuation or the unit ends
            more = n[:k] > t + 1
            after = np.zeros(k, np.uint8)
            after[more] = data[st[:k][more] + t + 1]
            end = np.flatnonzero((after & 0xC0) != 0x80)
            h = here[end]
            cand = best[base[:k][end] + lead[:k][end]] + self.unknown
            win = cand > best[h]
            hw = h[win]
            best[hw], back[hw], ids[hw] = cand[win], 1, self.byte_ids[b[end[win]]]
        # walk back in lockstep
        pos, live, steps = n.copy(), np.flatnonzero(n > 0), []
        count = np.zeros(len(n), np.int64)
        while len(live):
            h = base[live] + pos[live]
            steps.append((live, ids[h]))
            count[live] += 1
            pos[live] -= back[h]
            live = live[pos[live] > 0]
        where = np.empty(len(n), np.int64)
        unsorted = np.empty(len(n), np.int64)
        unsorted[order] = count
        off = np.concatenate([[0], np.cumsum(unsorted)])
        where = off[:-1][order] + count
        res = np.empty(off[-1], np.int32)
        for i, (live, x) in enumerate(steps):
            res[where[live] - 1 - i] = x
        scores = np.empty(len(n))
        scores[order] = best[base + n]
        return res, off, scores

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block's rows."""
        n = len(off) - 1
        some = np.diff(off) > 0
        shift = np.cumsum(some)
        buf = np.full(len(data) + int(some.sum()), 32, np.uint8)
        buf[np.arange(len(data)) + np.repeat(shift, np.diff(off))] = data
        at = off[:-1] + shift - some  # row starts in buf, its added space included
        first = np.zeros(len(buf) + 1, bool)
        space = buf == 32
        first[:-1] = space
        first[1:-1] &= ~space[:-1]
        first[at[some]] = True
        first[-1] = False
        start = np.flatnonzero(first[:-1])
        size = np.diff(np.concatenate([start, [len(buf)]]))
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        up, down = _powers(len(buf) + 1)
        c = np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * up[:-1], out=c[1:])
        key = mix64((c[start + size] - c[start]) * down[start])
        _, rep, inv = np.unique(key, return_index=True, return_inverse=True)
        # units that share a hash must share their bytes; any that don't are solved by themselves
        r = rep[inv]
        same = size == size[r]
        rows = np.repeat(np.arange(len(start)), np.where(same, size, 0))
        within = np.arange(len(rows)) - np.repeat(np.cumsum(np.where(same, size, 0)) - np.where(same, size, 0), np.where(same, size, 0))
        differ = rows[buf[start[rows] + within] != buf[start[r[rows]] + within]]
        alone = np.unique(np.concatenate([differ, np.flatnonzero(~same)]))
        inv[alone] = len(rep) + np.arange(len(alone))
        rep = np.concatenate([rep, alone])
        ids, uo, _ = self.solve(buf, start[rep], size[rep])
        k = np.diff(uo)[inv]
        out_off = np.concatenate([[0], np.cumsum(k)])
        src = np.arange(out_off[-1]) + np.repeat(uo[:-1][inv] - out_off[:-1], k)
        cut = np.searchsorted(start, np.concatenate([at, [len(buf)]]))
        return ids[src], out_off[cut]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of rows of ids; the added first space is taken off. Ids outside the vocabulary give nothing."""
        ok = (ids >= 0) & (ids < len(self.pieces))
        x = np.where(ok, ids, 0)
        size = np.where(ok, np.diff(self.text_off)[x], 0)
        end = np.concatenate([[0], np.cumsum(size)])
        src = np.arange(end[-1]) + np.repeat(self.text_off[x] - end[:-1], size)
        out = self.text_bytes[src]
        o = end[off]
        strip = np.zeros(len(off) - 1, bool)
        full = np.flatnonzero(np.diff(o) > 0)
        strip[full] = out[o[full]] == 32
        keep = np.ones(len(out), bool)
        keep[o[:-1][strip]] = False
        return out[keep], o - np.concatenate([[0], np.cumsum(strip)])


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str = MODEL, column: str = "text", to: str = "tokens", intact: str | None = None) -> DataFrame:
    """``docs`` with ``to``: ARRAY<INT> of the text's piece ids; every other column stays, one that has the name is replaced.

    A NULL text has NULL ids, an empty text no ids. ``intact`` names a further column: whether decoding gives the text back.
    The model file is read once on the driver and travels with the task (its size doesn't grow with the data).
    """
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

    model = load(model_path)
    small_batches(docs.sparkSession)
    new = {to.lower(), (intact or to).lower()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    extra = [StructField(to, ArrayType(IntegerType()))] + ([StructField(intact, BooleanType())] if intact else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Automaton.of(model)
        for batch in batches:
            col = batch.column(batch.schema.names.index(column))
            data, off = text_buffers(col)
            null = col.is_null().to_numpy(zero_copy_only=False)
            for i, j in blocks(off, BLOCK):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ids, to_ = a.encode(part, o)
                got = [pa.ListArray.from_arrays(pa.array(to_.astype(np.int32)), pa.array(ids), mask=pa.array(null[i:j]))]
                if intact:
                    back, bo = a.decode(ids, to_)
                    good = np.diff(bo) == np.diff(o)
                    if len(back) == len(part) and good.all():
                        bad = np.searchsorted(o, np.flatnonzero(back != part), side="right") - 1
                        good[bad] = False
                    else:
                        good = np.array([back[bo[x] : bo[x + 1]].tobytes() == part[o[x] : o[x + 1]].tobytes() for x in range(j - i)])
                    got.append(pa.array(good, mask=null[i:j]))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name)[i:j] for f in kept), *got], names=[*(f.name for f in kept), to, *([intact] if intact else [])])

    return docs.mapInArrow(run, StructType([*kept, *extra]))


def decode(rows: DataFrame, model_path: str = MODEL, column: str = "tokens", to: str = "text") -> DataFrame:
    """``rows`` with ``to`` (a column of that name is replaced): the text of the piece ids. NULL ids give NULL; NULL entries and unknown ids give nothing; bytes that
    aren't UTF-8 become U+FFFD."""
    from pyspark.sql.types import StringType, StructField, StructType

    model = load(model_path)
    (work,) = fresh(rows, "ids")
    rows_ = rows.withColumn(work, F.coalesce(F.transform(column, lambda x: F.coalesce(x.cast("int"), F.lit(-1))), F.array().cast("array<int>")))
    kept = [f for f in rows.schema.fields if f.name.lower() != to.lower()]
    schema = StructType([*kept, StructField(to, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Automaton.of(model)
        for batch in batches:
            col = batch.column(len(batch.columns) - 1)
            null = batch.column(batch.schema.names.index(column)).is_null().to_pylist()
            o = col.offsets.to_numpy().astype(np.int64)
            out, bo = a.decode(col.values.to_numpy()[o[0] : o[-1]], o - o[0])
            texts = [None if null[i] else out[bo[i] : bo[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), to])

    return rows_.mapInArrow(run, schema)
