"""Repeated passages by a distributed suffix sort: front-coded sorted runs, merged by loser trees that know common prefixes.

Every window of ``window`` words has one anchor: its least k-gram by hash (leftmost on ties), so equal windows have equal anchors
at equal offsets. Only suffixes that begin at an anchor are sorted, and of these only those whose anchor k-gram occurs in
another place as well (a window with another anchor can't repeat), which loses nothing.

1. each text's anchors, hash-partitioned by their k-gram; those that occur once go;
2. the texts with anchors left: tasks sort their suffixes (anchor hash mixed once more, then the words up to the last window's end) into runs,
   front-coded per target range of the hash, with each suffix's left context as payload;
3. each range merges its runs with a loser tree over (common prefix, rest): a comparison whose prefixes differ in length is
   settled by these lengths alone, and no byte of a known common prefix is looked at again. The merge yields the common prefix
   of neighbours, and so the classes of equal right context for each number of words; with the classes of equal left context
   they give exactly the windows that occur more than once;
4. the windows go back to their texts as bit masks and become spans of words.

Suffixes at one anchor have to meet in one task, and a line that a third of all texts hold makes an anchor of a third of them. The
few anchors with ``hot`` places or more (all places of a window share its anchor) therefore go another way, as exact as the sort:
their windows are hashed whole (128 bits), counted with partial sums in every task, and joined with those that occur again.

Order of occurrence is (doc_id, NULL last; text key; position). The first occurrence of a window stays, all others are repeats.
Exact copies of a text take part once and share its result, so thousands of copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, _powers, blocks, fresh, mix64, n_parts, small_batches, text_buffers, text_key, written

WINDOW, GRAM = 50, 10
#: Places from which an anchor's windows are counted by hash.
HOT = 1000
_LAST = b"\xff"


def anchors(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word position, first window start, last window start) of every anchor of a block, in words of the block."""
    pos, g = w.grams(w.hashes(), k)
    span = window - k + 1
    n = len(g)
    none = np.zeros(0, np.int64)
    if n < span:
        return np.zeros(0, U64), none, none, none
    idx, size = np.arange(n), 1
    while size * 2 <= span:
        m = len(idx) - size
        a, b = idx[:m], idx[size : size + m]
        idx = np.where(g[b] < g[a], b, a)
        size *= 2
    if size < span:
        m = n - span + 1
        a, b = idx[:m], idx[span - size : span - size + m]
        idx = np.where(g[b] < g[a], b, a)
    m = n - span + 1
    start = pos[:m]
    inside = (w.doc[start] == w.doc[pos[span - 1 : span - 1 + m]]) & (pos[span - 1 : span - 1 + m] - start == span - 1)
    at, start = pos[idx[:m]][inside], start[inside]
    h = g[idx[:m]][inside]
    if not len(at):
        return np.zeros(0, U64), none, none, none
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [len(at)]]) - 1
    return h[lo], at[lo], start[lo], start[hi]


def _find(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for i, j in blocks(off):
                w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                h, at, lo, hi = anchors(w, window, k)
                if not len(h):
                    continue
                d = w.doc[at]
                p = at - w.first[d]
                pack = (p << 16) | ((at - lo) << 8) | (at - hi)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(h1[i + d]), pa.array(h2[i + d]), pa.array(pack)], names=["h", "h1", "h2", "pack"])

    return run


def front_code(keys: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(common prefix with the one before, the rests joined, their lengths) of a sorted list."""
    lcp, rest, prev = np.zeros(len(keys), np.int32), [], b""
    for i, s in enumerate(keys):
        n = common_prefix(prev, s, 0)
        lcp[i] = n
        rest.append(s[n:])
        prev = s
    return lcp, b"".join(rest), np.array([len(r) for r in rest], np.int32)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are equal and aren't looked at."""
    n = min(len(a), len(b))
    if a[known : known + 16] != b[known : known + 16]:
        i = known
        while i < n and a[i] == b[i]:
            i += 1
        return i
    step, i = 32, known
    while i < n:
        if a[i : i + step] == b[i : i + step]:
            i += step
            step *= 2
        elif step == 1:
            return i
        else:
            step = max(1, step // 4)
    return n


def merge_runs(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Merge sorted runs of (key, common prefix with the run's key before, payload) into one such sequence.

    A loser tree whose nodes hold (run, common prefix of its head with the winner that passed). If two heads' prefixes with the
    last winner differ, the longer one is the smaller key and the prefix of the loser is unchanged; only equal prefixes need a
    comparison, from that position on.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    head: list = [None] * size
    lcp = [0] * size
    for r in range(k):
        x = next(runs[r], None)
        if x is not None:
            head[r] = x
    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's prefix with the winner."""
        ha, hb = head[a], head[b]
        if ha is None:
            return b, a
        if hb is None:
            return a, b
        la, lb = lcp[a], lcp[b]
        if la > lb:
            return a, b
        if lb > la:
            return b, a
        sa, sb = ha[0], hb[0]
        n = common_prefix(sa, sb, la)
        if sa[n:n + 1] < sb[n:n + 1] or (n == len(sa) == len(sb) and a < b):
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    loser = [0] * size
    level = list(range(size))
    at = size
    while len(level) > 1:
        at //= 2
        up = []
        for i in range(0, len(level), 2):
            win, lose = play(level[i], level[i + 1])
            up.append(win)
            loser[at + i // 2] = lose
        level = up
    win = level[0]
    while head[win] is not None:
        key, _, payload = head[win]
        yield key, lcp[win], payload
        x = next(runs[win], None)
        head[win] = x
        if x is not None:
            lcp[win] = x[1]
        node = (win + size) // 2
        while node:
            other = loser[node]
            if head[other] is not None:
                if head[win] is None:
                    loser[node], win = win, other
                elif lcp[other] > lcp[win]:
                    loser[node], win = win, other
                elif lcp[other] == lcp[win]:
                    w, lose = play(win, other)
                    loser[node], win = lose, w
            node //= 2


_STEP = pa.schema([("target", pa.int32()), ("run", pa.binary()), *((c, pa.int64()) for c in ("w1", "w2", "doc_id", "h1", "h2", "s"))])


def _step(**cols) -> pa.RecordBatch:
    """A batch of runs or of windows; the columns of the other kind are NULL."""
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _STEP], schema=_STEP)


def window_hashes(h: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows of so many words (given by their hashes) that begin at the starts."""
    up, down = _powers(len(h) + 1)
    out = []
    for x in (h, mix64(h ^ U64(0xA0761D6478BD642F))):
        c = np.zeros(len(h) + 1, U64)
        np.cumsum(x * up[: len(h)], out=c[1:])
        out.append(mix64((c[start + window] - c[start]) * down[start]).view(np.int64))
    return out[0], out[1]


def _runs(window: int, k: int, targets: int, most: int = 20_000):
    """Sorted runs of the suffixes at ``packs``, and the hashes of the windows at ``hots``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: list[tuple] = []

        def flush():
            hold.sort(key=lambda x: x[0])
            goal = [int.from_bytes(x[0][:8], "big") * targets >> 64 for x in hold]
            edges = np.searchsorted(np.array(goal), np.arange(targets + 1))
            for t in range(targets):
                part = hold[edges[t] : edges[t + 1]]
                if not part:
                    continue
                lcp, rest, size = front_code([x[0] for x in part])
                left = [x[1] for x in part]
                meta = np.array([x[2] for x in part], np.int64)
                blob = b"".join([np.array([len(part), len(rest)], np.int64).tobytes(), meta.tobytes(), lcp.tobytes(), size.tobytes(), np.array([len(x) for x in left], np.int32).tobytes(), rest, b"".join(left)])
                yield _step(target=[t], run=[blob])
            hold.clear()

        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            packs, hots = batch.column("packs"), batch.column("hots")
            for i in range(len(batch)):
                raw = data[off[i] : off[i + 1]]
                w = Words(raw, np.array([0, len(raw)]))
                h = w.hashes()
                hot = hots[i].as_py()
                if hot:
                    x = np.array(hot, np.int64)
                    near, n = x & 255, ((x >> 8) & 255) - (x & 255) + 1
                    at = np.repeat((x >> 16) - near, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    w1, w2 = window_hashes(h, at, window)
                    m = len(at)
                    yield _step(w1=w1, w2=w2, doc_id=np.full(m, ids[i]), h1=np.full(m, h1[i]), h2=np.full(m, h2[i]), s=at)
                cold = packs[i].as_py()
                if not cold:
                    continue
                words = [raw[a:b].tobytes() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
                g = mix64(w.grams(h, k)[1])  # one to one; an anchor is the least of many hashes, so its own would all lie in the lowest ranges
                for pack in sorted(cold):
                    p, back, near = pack >> 16, (pack >> 8) & 255, pack & 255
                    key = int(g[p]).to_bytes(8, "big") + b" ".join(words[p : p - near + window]) + b" "
                    hold.append((key, b" ".join(words[p - back : p]), (h1[i], h2[i], ids[i] if not null[i] else np.iinfo(np.int64).max, pack)))
                if len(hold) >= most:
                    yield from flush()
        if hold:
            yield from flush()

    return run


def _open(blob: bytes) -> Iterator[tuple[bytes, int, tuple[bytes, tuple]]]:
    n, size = np.frombuffer(blob, np.int64, 2).tolist()
    at = 16
    meta = np.frombuffer(blob, np.int64, n * 4, at).reshape(n, 4)
    at += n * 32
    lcp, rest, left = (np.frombuffer(blob, np.int32, n, at + i * 4 * n).tolist() for i in range(3))
    at += 12 * n
    lat, key = at + size, b""
    for i in range(n):
        key = key[: lcp[i]] + blob[at : at + rest[i]]
        at += rest[i]
        yield key, lcp[i], (blob[lat : lat + left[i]], meta[i])
        lat += left[i]


def _settle(keys_lcp: np.ndarray, lefts: list[bytes], meta: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit masks by suffix: windows (offset back from the anchor) that occur again; those of them that occur earlier as well.

    keys_lcp: words that neighbours have in common from the anchor on (-1: another anchor).
    """
    n = len(lefts)
    off = np.concatenate([[0], np.cumsum([len(x) for x in lefts])])
    hs, ends, base = [np.zeros(0, U64)], [], 0
    for i, j in blocks(off):
        w = Words(np.frombuffer(b"".join(lefts[i:j]), np.uint8), off[i : j + 1] - off[i])
        hs.append(w.hashes())
        ends.append(w.first[1:] + base)
        base += len(w)
    h, end = np.concatenate(hs), np.concatenate(ends)
    pack = meta[:, 3]
    back, near = (pack >> 8) & 255, pack & 255
    rank = np.empty(n, np.int64)
    rank[np.lexsort((pack >> 16, meta[:, 1], meta[:, 0], meta[:, 2]))] = np.arange(n)
    again, later = np.zeros(n, U64), np.zeros(n, U64)
    left = np.zeros(n, U64)
    power = 1
    for o in range(int(back.max()) + 1 if n else 0):
        if o:
            has = back >= o
            left[has] += h[end[has] - o] * U64(power)
            power = power * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        on = np.flatnonzero((near <= o) & (o <= back))
        if len(on) < 2:
            continue
        cls = np.cumsum(keys_lcp < window - o)
        key = mix64(left[on] ^ mix64(cls[on].astype(U64) + U64(1)))
        order = np.lexsort((rank[on], key))
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        lone = new.copy()
        lone[:-1] &= new[1:]
        bit = U64(1) << U64(o)
        again[on[order[~lone]]] |= bit
        later[on[order[~new]]] |= bit
    return again, later


def _merge(window: int, most: int = 100_000):
    """Merge the runs of each range and settle it piece by piece: a piece ends between anchors, after at least ``most`` suffixes."""

    def settled(lcp, lefts, meta):
        m = np.array(meta, np.int64).reshape(-1, 4)
        again, later = _settle(np.array(lcp), lefts, m, window)
        some = again > 0
        if some.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[some, 0]), pa.array(m[some, 1]), pa.array(m[some, 3] >> 16), pa.array(again[some].view(np.int64)), pa.array(later[some].view(np.int64))],
                names=["h1", "h2", "p", "again", "later"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: dict[int, list[bytes]] = {}
        for batch in batches:
            for t, blob in zip(batch.column("target").to_pylist(), batch.column("run").to_pylist(), strict=True):
                hold.setdefault(t, []).append(blob)
        for t in list(hold):
            lcp, lefts, meta = [], [], []
            for key, common, (left, m) in merge_runs([_open(b) for b in hold.pop(t)]):
                if common < 8 and len(lefts) >= most:
                    yield from settled(lcp, lefts, meta)
                    lcp, lefts, meta = [], [], []
                lcp.append(key.count(b" ", 8, common) if common >= 8 else -1)
                lefts.append(left)
                meta.append(m)
            yield from settled(lcp, lefts, meta)

    return run


def spans_of(p: np.ndarray, mask: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Union of [p - o, p - o + window) over the set bits o of the masks, as sorted spans of words."""
    o = np.arange(64, dtype=U64)
    on = (np.asarray(mask, np.int64).view(U64)[:, None] >> o) & U64(1) == 1
    s = np.unique((np.asarray(p)[:, None] - o.astype(np.int64))[on])
    if not len(s):
        return []
    cut = np.flatnonzero(np.diff(s) > window)
    a, b = s[np.concatenate([[0], cut + 1])], s[np.concatenate([cut, [len(s) - 1]])] + window
    return list(zip(a.tolist(), b.tolist(), strict=True))


def _spans(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, again, later = batch.column("masks"), [], []
            off = col.offsets.to_numpy()
            p, ms, ml = (col.values.field(c).to_numpy() for c in ("p", "again", "later"))
            for i in range(len(batch)):
                at = slice(off[i], off[i + 1])
                for out, m in ((again, ms), (later, ml)):
                    out.append([{"s": a, "e": b} for a, b in spans_of(p[at], m[at], window)])
            t = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(again, t), pa.array(later, t)], names=["h1", "h2", "again", "later"])

    return run


_SPANS = "array<struct<s:bigint,e:bigint>>"


def _text_spans(docs: DataFrame, window: int, k: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(keyed documents: doc_id, text, h1, h2, n_words aside; spans by distinct text: h1, h2, again, later)."""
    if not 1 <= k <= window <= k + 62:
        raise ValueError("window must be between k and k + 62 words")
    spark = docs.sparkSession
    small_batches(spark)
    h1, h2 = text_key("text")
    keyed = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
        .select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))
    )
    found = keyed.select("text", "h1", "h2").mapInArrow(_find(window, k), "h long, h1 long, h2 long, pack long")
    by_gram = found.repartition(n_parts(spark), "h").dropDuplicates(["h", "h1", "h2", "pack"])
    twice = by_gram.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1")
    packs = twice.groupBy("h1", "h2").agg(F.collect_list(F.when(F.col("n") < hot, F.col("pack"))).alias("packs"), F.collect_list(F.when(F.col("n") >= hot, F.col("pack"))).alias("hots"))
    first = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"))
    cand = packs.join(first, ["h1", "h2"]).withColumnsRenamed({"h1": "c1", "h2": "c2"})
    texts = keyed.join(cand, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["h1", "h2"])
    targets = n_parts(spark)
    form = ", ".join(["target int", "run binary", *(f"{c} long" for c in ("w1", "w2", "doc_id", "h1", "h2", "s"))])
    steps = written(texts.select("doc_id", "text", "h1", "h2", "packs", "hots").mapInArrow(_runs(window, k, targets), form), "steps")
    masks = (
        steps.where("target is not null").select("target", "run")
        .repartitionById(targets, F.col("target")).mapInArrow(_merge(window), "h1 long, h2 long, p long, again long, later long")
    )
    place = F.struct("doc_id", "h1", "h2", "s")
    wins = steps.where("w1 is not null").select("w1", "w2", place.alias("place"))
    lead = wins.groupBy("w1", "w2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "first")
    met = wins.join(lead, ["w1", "w2"])
    masks = masks.union(met.select("place.h1", "place.h2", F.col("place.s").alias("p"), F.lit(1).cast("long").alias("again"), (F.col("place") != F.col("first")).cast("long").alias("later")))
    spans = (
        masks.groupBy("h1", "h2").agg(F.collect_list(F.struct("p", "again", "later")).alias("masks"))
        .mapInArrow(_spans(window), f"h1 long, h2 long, again {_SPANS}, later {_SPANS}")
    )
    return keyed, written(spans, "spans")


def repeated_passages(docs: DataFrame, window: int = WINDOW, k: int = GRAM, hot: int = HOT) -> DataFrame:
    """Every passage of at least ``window`` words that occurs more than once: (doc_id, start_word, end_word, repeat).

    Rows with repeat = true are the stretches of words that an earlier place has too (these a dedup removes); rows with repeat
    = false are the maximal stretches all of whose windows occur again anywhere, earlier or later. Words are counted from 0,
    ends are exclusive. An exact copy of a text of at least ``window`` words is one repeat from its first to its last word. NULL
    texts and texts of fewer words have no rows. A NULL doc_id is reported as NULL and comes after all others; repeated rows are
    copies of each other. Other columns aren't read.
    """
    keyed, spans = _text_spans(docs, window, k, hot)
    words = F.regexp_count("text", F.lit(r"[^\x00-\x20]+")).cast("long")
    rows = keyed.select("doc_id", "h1", "h2", F.when(F.length("text") >= 2 * window - 1, words).otherwise(0).alias("n"))
    w = Window.partitionBy("h1", "h2")
    rows = rows.where(F.col("n") >= window).withColumn("copies", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.col("doc_id").asc_nulls_last())))
    j = rows.join(spans, ["h1", "h2"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n").alias("e")))
    none = F.array().cast(_SPANS)
    j = j.where((F.col("copies") > 1) | F.col("again").isNotNull()).select(
        "doc_id",
        F.when(F.col("copies") > 1, whole).otherwise(F.col("again")).alias("again"),
        F.when(F.col("rn") > 1, whole).otherwise(F.coalesce("later", none)).alias("later"),
    )
    both = F.concat(
        F.transform("again", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(False).alias("r"))),
        F.transform("later", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(True).alias("r"))),
    )
    return j.select("doc_id", F.explode(both).alias("x")).select("doc_id", F.col("x.s").alias("start_word"), F.col("x.e").alias("end_word"), F.col("x.r").alias("repeat"))


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these spans of words (sorted, disjoint), each with the white space after it."""
    data = np.frombuffer(text, np.uint8)
    w = Words(data, np.array([0, len(data)]))
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : w.starts[s]])
        at = int(w.starts[e]) if e < len(w) else len(text)
    out.append(text[at:])
    return b"".join(out)


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = GRAM, hot: int = HOT) -> DataFrame:
    """The documents with every repeat cut out of the text; all columns stay, ``n_chars`` (if there is one) follows the text.

    Documents of which no word is left go; NULL, empty and wordless texts stay as they are. See ``repeated_passages``.
    """
    _, spans = _text_spans(docs, window, k, hot)
    c1, c2, g1, g2, rn, cut, new = fresh(docs, "h1", "h2", "g1", "g2", "rn", "cut", "new")
    h1, h2 = text_key("text")
    spans = spans.select(F.col("h1").alias(g1), F.col("h2").alias(g2), F.col("later").alias(cut))
    d = docs.withColumn(c1, h1).withColumn(c2, h2)
    bare = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x00-\x20]")
    alone = d.where(bare).select(*docs.columns)
    j = d.where(~bare).join(spans, (F.col(c1) == F.col(g1)) & (F.col(c2) == F.col(g2)), "left")
    j = j.withColumn(rn, F.row_number().over(Window.partitionBy(c1, c2).orderBy(F.col("doc_id").asc_nulls_last())))

    @F.arrow_udf("string")
    def shorten(text, spans, rank):
        out = []
        for t, s, r in zip(text.to_pylist(), spans.to_pylist(), rank.to_pylist(), strict=True):
            if t is None:
                out.append(None)
            elif r > 1:
                raw = np.frombuffer(t.encode(), np.uint8)
                out.append("" if len(Words(raw, np.array([0, len(raw)]))) >= window else t)
            elif s:
                out.append(cut_text(t.encode(), [(x["s"], x["e"]) for x in s]).decode())
            else:
                out.append(t)
        return pa.array(out, pa.string())

    shorten = shorten.asNondeterministic()  # else the filter below gets a call of its own, in one more Python worker for each task
    touched = (F.col(rn) > 1) | (F.size(F.coalesce(cut, F.array().cast(_SPANS))) > 0)
    # untouched texts don't travel to Python: the function gets NULL for them
    j = j.withColumn(new, shorten(F.when(touched, F.col("text")), F.when(touched, F.col(cut)), F.col(rn)))
    j = j.where(F.col(new).isNull() | F.col(new).rlike(r"[^\x00-\x20]"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.coalesce(F.col(new), F.col(c)).alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col(new).isNull(), F.col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols).union(alone)
