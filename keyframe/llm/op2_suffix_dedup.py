"""Exact substring deduplication by a distributed, prefix-aware merge sort of suffixes (operator 2).

A byte goes if a LENGTH-byte string that covers it also starts in a document
with a smaller doc_id.  Every LENGTH-byte window holds one anchor: the K-gram of
least hash, the rightmost of equals.  The choice depends on the window's bytes
alone, so equal windows hold their anchor at the same offset, and it is enough
to sort the suffixes that start at anchors.

1. Anchors: each batch sends its anchors' hashes, sorted, per (hash bucket, document group);
   a bucket sends back to each group those that more than one document holds.
2. Runs: each group sorts its shared anchors' suffixes (LENGTH bytes, with the bytes to their
   left as payload), folds equal ones, front-codes the run and cuts it at sampled splitters.
3. Merge: each range merges its runs with a loser tree that keeps every loser's common prefix
   with the last output and compares two suffixes only beyond it.  From the merged order and its
   LCP array follows, for each of the offsets at which a window may hold its anchor, the smallest
   document with the same window.
4. Cut: each group gets, in the order of its runs, the offsets that are covered.

Texts meet their answers in groups of documents of about GROUP_BYTES.  Equal
contexts are folded before the exchange, so a passage that a third of all
documents share is sent once per group.  Whole copies are found by 128-bit
hashes and need no suffixes.  Splitters come from a bounded sample; where there are more
groups than ranges between them, each range is split further by the hash of the anchor.

Null text is empty.  A row without doc_id keeps all and covers nothing.
Rows that share a doc_id do not cover each other.  Other columns are ignored.
A text of any length is one row: its task holds some 15 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ID_BLOCK, U64, Groups, cut, mix, release, slices, stream, table, text_buffer, trim, trimmed

LENGTH, K = 50, 24
LEFT = LENGTH - K  # most bytes of a window before its anchor
GRAMS = LEFT + 1
GROUP_BYTES = 12 << 20
SEGMENT = 1 << 20
SAMPLED_GROUPS, SAMPLE = 256, 64
WIDTH = LENGTH + LEFT + 2


def segment_anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the anchors of all windows inside rows; under 2**21 bytes."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    base = U64(0xD6E8FEB86659FD93)
    power = np.multiply.accumulate(np.full(n, base))
    inverse = U64(pow(int(base), -1, 1 << 64))
    c = np.zeros(n + 1, U64)
    np.cumsum(stream(11, 256)[data] * power, out=c[1:])
    g = mix((c[K:] - c[:-K]) * np.multiply.accumulate(np.full(n - K + 1, inverse)))
    low = U64((1 << 21) - 1)
    m = (g & ~low) | (low - np.arange(len(g), dtype=U64))
    span = 1
    while 2 * span <= GRAMS:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[: len(m) - (GRAMS - span)], m[GRAMS - span :])  # by window start
    end = np.repeat(offs[1:], np.diff(offs))[: len(m)]
    ok = np.arange(len(m)) + LENGTH <= end
    at = (low - (m[ok] & low)).astype(np.int64)
    if len(at):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, g[at]


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in data, hash) of every row's anchors, by row and position."""
    rows, at, hashes = [], [], []
    for lo, hi in slices(offs, SEGMENT):
        a, b = int(offs[lo]), int(offs[hi])
        for s in range(a, max(a + 1, b - LENGTH + 1 if b - a > SEGMENT else a + 1), SEGMENT):
            e = min(b, s + SEGMENT + LENGTH - 1) if b - a > SEGMENT else b
            p, h = segment_anchors(data[s:e], np.array([0, e - s]) if b - a > SEGMENT else offs[lo : hi + 1] - a)
            at.append(p + s)
            hashes.append(h)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    keep = np.concatenate([[True], at[1:] > np.maximum.accumulate(at)[:-1]]) if len(at) else np.zeros(0, bool)
    at, hashes = at[keep], hashes[keep]
    return np.searchsorted(offs, at, "right") - 1, at, hashes


def _runs_of(x: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of equal values; none of an empty array."""
    if not len(x):
        return []
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist()
    return list(zip(at, [*at[1:], len(x)], strict=True))


def _filter_key(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) % U64(buckets)) << U64(32) | (h & U64(0xFFFFFFFF))


def _post_anchors(groups: int):
    def run(batches):
        import pyarrow as pa

        every = max(1, groups // SAMPLED_GROUPS)
        for b in batches:
            data, offs = text_buffer(b.column(2))
            group = np.asarray(b.column(1))
            row, at, h = anchors(data, offs)
            if not len(row):
                continue
            g, key = group[row], _filter_key(h, groups)
            out = []
            for s in np.unique(g[g % every == 0]):
                pick = np.flatnonzero(g == s)
                pick = pick[np.argsort(mix(h[pick]))[: SAMPLE if groups < SAMPLED_GROUPS else SAMPLE // 4]]
                text = data[at[pick][:, None] + np.arange(K)].tobytes()
                out.append((-1, -1, text))
            order = np.lexsort((row, key, g))
            g, key, row = g[order], key[order], row[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(g)) - 1
            many = (row[first] != row[last]).astype(np.uint8)
            g, key = g[first], key[first]
            bucket = (key >> U64(32)).astype(np.int64)
            cut_at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (bucket[1:] != bucket[:-1])]))
            low = key.astype(np.uint32)
            for s, e in zip(cut_at, np.append(cut_at[1:], len(g)), strict=True):
                out.append((int(bucket[s]), int(g[s]), low[s:e].tobytes() + many[s:e].tobytes()))
            for i in range(0, len(out), 4000):
                x = list(zip(*out[i : i + 4000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int32()), pa.array(x[1], pa.int32()), pa.array(x[2], pa.binary())], names=["bucket", "g", "data"])

    return trimmed(run)


def _shared_anchors(key, t):
    """Of one bucket: to each group, the hashes that another document holds too."""
    import pyarrow as pa

    bucket = key[0].as_py()
    rows = list(zip(t.column("g").to_pylist(), t.column("data").to_pylist(), strict=True))
    out = []
    if bucket < 0:
        out = [(-1, -1, d) for _, d in rows]
    else:
        size = np.array([len(d) // 5 for _, d in rows])
        h = np.concatenate([np.frombuffer(d, np.uint32, n) for (_, d), n in zip(rows, size, strict=True)])
        many = np.concatenate([np.frombuffer(d, np.uint8, n, 4 * n) for (_, d), n in zip(rows, size, strict=True)])
        g = np.repeat(np.array([x for x, _ in rows]), size)
        order = np.argsort(h, kind="stable")
        h, many, g = h[order], many[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.append(first, len(h)))
        ok = np.repeat((n > 1) | (np.maximum.reduceat(many, first) > 0), n)
        h, g = h[ok], g[ok]
        order = np.lexsort((h, g))
        h, g = h[order], g[order]
        for s, e in _runs_of(g):
            out.append((int(g[s]), bucket, np.unique(h[s:e]).tobytes()))
    x = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({"g": pa.array(x[0], pa.int32()), "id": pa.array(x[1], pa.int64()), "data": pa.array(x[2], pa.binary())})


class Group:
    """One group's documents and their shared suffix contexts, the same each time it is built."""

    def __init__(self, t, groups: int, splitters: np.ndarray) -> None:
        import pyarrow.compute as pc

        d = t.filter(pc.equal(t.column("kind"), 0))
        d = d.take(pc.sort_indices(d, [("id", "ascending"), ("data", "ascending")]))
        self.ids = d.column("id").to_pylist()
        self.data, self.offs = text_buffer(d.column("data"))
        c = t.filter(pc.equal(t.column("kind"), 3))
        copies = set(zip(c.column("id").to_pylist(), c.column("data").to_pylist(), strict=True))
        some = {i for i, _ in copies}
        self.copy = np.array([i in some and (i, hashlib.md5(self.data[a:b].tobytes()).digest()) in copies for i, a, b in zip(self.ids, self.offs[:-1], self.offs[1:], strict=True)], bool)
        shared = [np.zeros(0, U64)]
        s = t.filter(pc.equal(t.column("kind"), 1))
        for bucket, blob in zip(s.column("id").to_pylist(), s.column("data").to_pylist(), strict=True):
            shared.append(U64(bucket << 32) | np.frombuffer(blob, np.uint32).astype(U64))
        shared = np.unique(np.concatenate(shared))
        row, at, h = anchors(self.data, self.offs)
        key = _filter_key(h, groups)
        hit = np.searchsorted(shared, key)
        ok = np.zeros(len(key), bool)
        inside = hit < len(shared)
        ok[inside] = shared[hit[inside]] == key[inside]
        usable = np.array([x is not None for x in self.ids], bool) & ~self.copy
        ok &= usable[row] if len(row) else ok
        self.row, self.at = row[ok], at[ok]
        doc = np.array([x or 0 for x in self.ids], np.int64)[self.row] if len(self.ids) else np.zeros(0, np.int64)
        n = len(self.at)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), self.data, np.zeros(LENGTH, np.uint8)])
        ctx = np.empty((n, WIDTH), np.uint8)
        ctx[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[self.at + LEFT]
        ctx[:, LENGTH : LENGTH + LEFT] = np.lib.stride_tricks.sliding_window_view(padded, LEFT)[self.at][:, ::-1]  # nearest first
        start, end = self.offs[self.row], self.offs[self.row + 1]
        self.lo = np.maximum(0, self.at + LENGTH - end)  # offsets at which a window around the anchor fits
        self.hi = np.minimum(LEFT, self.at - start)
        over = np.arange(LENGTH) >= (end - self.at)[:, None]
        ctx[:, :LENGTH][over] = 0  # bytes of other documents
        ctx[:, LENGTH : LENGTH + LEFT][np.arange(LEFT) >= (self.at - start)[:, None]] = 0
        ctx[:, -2], ctx[:, -1] = self.lo, self.hi
        order = np.argsort(ctx.view(f"S{WIDTH}").ravel(), kind="stable") if n else np.zeros(0, np.int64)
        s = ctx[order]
        new = np.ones(n, bool)
        new[1:] = (s[1:] != s[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.of = np.empty(n, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.ctx = s[first]
        self.doc = np.minimum.reduceat(doc[order], first) if n else doc
        self.occurrence_doc = doc
        del ctx, s, over
        head = np.ascontiguousarray(self.ctx[:, :K])
        self.range = np.searchsorted(splitters, head.view(f"S{K}").ravel(), "right")
        split = -(-groups // (len(splitters) + 1))
        if split > 1:
            words = head.view(U64).reshape(-1, K // 8)
            self.range = self.range * split + (mix(words[:, 0] + mix(words[:, 1] + mix(words[:, 2]))) % U64(split)).astype(np.int64)
            by = np.argsort(self.range, kind="stable")
            place = np.empty_like(by)
            place[by] = np.arange(len(by))
            self.of, self.ctx, self.doc, self.range = place[self.of], self.ctx[by], self.doc[by], self.range[by]


def encode_run(ctx: np.ndarray, doc: np.ndarray) -> bytes:
    """A front-coded run: count, LCPs, what follows them, left contexts and limits, documents."""
    n = len(ctx)
    right = ctx[:, :LENGTH]
    lcp = np.zeros(n, np.uint8)
    if n > 1:
        diff = right[1:] != right[:-1]
        lcp[1:] = np.where(diff.any(axis=1), diff.argmax(axis=1), LENGTH)
    tail = right[np.arange(LENGTH) >= lcp[:, None]]
    return b"".join([np.uint32(n).tobytes(), lcp.tobytes(), tail.tobytes(), ctx[:, LENGTH:].tobytes(), doc.astype(np.int64).tobytes()])


def decode_run(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lcp, suffixes (n, LENGTH), left contexts and limits, documents."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    lcp = np.frombuffer(blob, np.uint8, n, 4)
    size = int((LENGTH - lcp.astype(np.int64)).sum())
    tail = np.frombuffer(blob, np.uint8, size, 4 + n)
    right = np.zeros((n, LENGTH), np.uint8)
    mask = np.arange(LENGTH) >= lcp[:, None]
    right[mask] = tail
    who = np.arange(n)
    for j in range(LENGTH):
        right[:, j] = right[np.maximum.accumulate(np.where(mask[:, j], who, 0)), j]
    rest = 4 + n + size
    side = np.frombuffer(blob, np.uint8, n * (LEFT + 2), rest).reshape(n, LEFT + 2)
    return lcp, right, side, np.frombuffer(blob, np.int64, n, rest + n * (LEFT + 2))


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Loser tree over sorted runs (strings, LCPs): the stream of each output and its LCP with the one before."""
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    lcps = [r[1] for r in runs] + [[]] * (k - len(runs))
    size = [len(s) for s in strings]
    at = [0] * k
    common = [0] * k  # LCP with the last output; -1: the stream has ended
    for s in range(k):
        if not size[s]:
            common[s] = -1

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's LCP becomes that with the winner."""
        x, y = common[a], common[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        if x < LENGTH:
            p, q = strings[a][at[a]], strings[b][at[b]]
            differ = int.from_bytes(p[x:], "big") ^ int.from_bytes(q[x:], "big")
            if differ:
                m = LENGTH - (differ.bit_length() + 7) // 8
                if p[m] < q[m]:
                    common[b] = m
                    return a, b
                common[a] = m
                return b, a
            common[b if a < b else a] = LENGTH
        return (a, b) if a < b else (b, a)

    losers, winners = [0] * k, [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    out, out_lcp = [], []
    while common[top] >= 0:
        out.append(top)
        out_lcp.append(common[top])
        at[top] += 1
        common[top] = lcps[top][at[top]] if at[top] < size[top] else -1
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2
    return out, out_lcp


def covered_offsets(lcp: np.ndarray, side: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset at which a window around each suffix's anchor occurs in a smaller document (255: none)."""
    n = len(doc)
    first, last = np.full(n, 255, np.uint8), np.full(n, 255, np.uint8)
    run = np.cumsum(lcp < K)
    busy = np.flatnonzero(np.bincount(run)[run] > 1) if n else np.zeros(0, np.int64)
    if not len(busy):
        return first, last
    left = np.ascontiguousarray(side[busy, :LEFT])
    order = np.argsort(left.view(f"S{LEFT}").ravel(), kind="stable")
    s = left[order]
    diff = s[1:] != s[:-1]
    left_lcp = np.concatenate([[0], np.where(diff.any(axis=1), diff.argmax(axis=1), LEFT)])
    lo, hi, d = side[busy, LEFT], side[busy, LEFT + 1], doc[busy]
    for a in range(GRAMS):
        right_run = np.cumsum(lcp < LENGTH - a)[busy]
        left_run = np.empty(len(busy), np.int64)
        left_run[order] = np.cumsum(left_lcp < a) if a else 0
        ok = np.flatnonzero((lo <= a) & (a <= hi))
        if not len(ok):
            continue
        key = right_run[ok] * (len(busy) + 1) + left_run[ok]
        by = np.argsort(key, kind="stable")
        key = key[by]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(np.minimum.reduceat(d[ok][by], start), np.diff(np.append(start, len(key))))
        hit = busy[ok[by[least < d[ok][by]]]]
        last[hit] = a
        first[hit] = np.minimum(first[hit], a)
    return first, last


def _merge_range(key, t):
    import pyarrow as pa

    rows = sorted(zip(t.column("g").to_pylist(), t.column("data").to_pylist(), strict=True))
    runs = [decode_run(d) for _, d in rows]
    text = [right.view(f"V{LENGTH}").ravel().tolist() for _, right, _, _ in runs]
    runs = [(lcp, None, side, doc) for lcp, _, side, doc in runs]
    order, lcp = merge_runs([(s, r[0].tolist()) for s, r in zip(text, runs, strict=True)])
    text.clear()
    order, lcp = np.array(order), np.array(lcp)
    size = np.array([len(r[0]) for r in runs])
    base = np.cumsum(size) - size
    by = np.argsort(order, kind="stable")
    at = np.empty(len(order), np.int64)
    at[by] = np.arange(len(order))  # merged place -> place in the runs laid end to end
    side, doc = np.concatenate([r[2] for r in runs]), np.concatenate([r[3] for r in runs])
    first, last = covered_offsets(lcp, side[at], doc[at])
    f, e = np.empty_like(first), np.empty_like(last)
    f[at], e[at] = first, last
    data = [f[b : b + n].tobytes() + e[b : b + n].tobytes() for b, n in zip(base, size, strict=True)]
    out = pa.table({"g": pa.array([g for g, _ in rows], pa.int32()), "id": pa.array([key[0].as_py()] * len(rows), pa.int64()), "data": pa.array(data, pa.binary())})
    del runs, text, side, doc, by, at, first, last, f, e, data
    trim()
    return out


def _make_runs(groups: int, splitters: np.ndarray):
    def run(key, t):
        import pyarrow as pa

        g = Group(t, groups, splitters)
        out = []
        for s, e in _runs_of(g.range):
            out.append((int(g.range[s]), key[0].as_py(), encode_run(g.ctx[s:e], g.doc[s:e])))
        x = list(zip(*out, strict=True)) or [(), (), ()]
        del g
        out = pa.table({"range": pa.array(x[0], pa.int64()), "g": pa.array(x[1], pa.int32()), "data": pa.array(x[2], pa.binary())})
        trim()
        return out

    return run


def _cut_texts(groups: int, splitters: np.ndarray, with_text: bool):
    def run(key, t):
        import pyarrow as pa
        import pyarrow.compute as pc

        g = Group(t, groups, splitters)
        first, last = np.full(len(g.doc), 255, np.uint8), np.full(len(g.doc), 255, np.uint8)
        r = t.filter(pc.equal(t.column("kind"), 2))
        for rng, blob in zip(r.column("id").to_pylist(), r.column("data").to_pylist(), strict=True):
            lo, hi = np.searchsorted(g.range, [rng, rng + 1])
            b = np.frombuffer(blob, np.uint8)
            first[lo:hi], last[lo:hi] = b[: hi - lo], b[hi - lo :]
        f, e = first[g.of].astype(np.int64), last[g.of].astype(np.int64)
        later = g.occurrence_doc > g.doc[g.of] if len(g.of) else np.zeros(0, bool)
        f, e = np.where(later, g.lo, f), np.where(later, g.hi, e)
        hit = f != 255
        delta = np.zeros(len(g.data) + 1, np.int32)
        np.add.at(delta, (g.at - e)[hit], 1)
        np.add.at(delta, (g.at - f + LENGTH)[hit], -1)
        gone = np.cumsum(delta[:-1], dtype=np.int32, out=delta[:-1]) > 0
        del delta, f, e, later, hit
        out, seen = [], set()
        for i, doc in enumerate(g.ids):
            a, b = g.offs[i], g.offs[i + 1]
            own = (doc, hashlib.md5(g.data[a:b].tobytes()).digest()) if with_text and doc is not None else None
            cutting = gone[a:b]
            if g.copy[i] and b - a >= LENGTH:
                cutting = np.ones(b - a, bool)
            removed = int(cutting.sum())
            spans = int(cutting[:1].sum()) + int((cutting[1:] & ~cutting[:-1]).sum()) if removed else 0
            kept = (g.data[a:b][~cutting] if removed else g.data[a:b]).tobytes()
            out.append((doc, int(b - a), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None, own[1] if own else None, own in seen))
            if own:
                seen.add(own)
        x = list(zip(*out, strict=True)) or [()] * 8
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_()]
        del g, gone, out
        out = pa.table({n: pa.array(v, k) for n, v, k in zip(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "digest", "again"], x, types, strict=True)})
        del x
        trim()
        return out

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the text left, if asked for).

    With the text come digest, the MD5 of the text as it was (null without id),
    and again, true for a row whose id and text an earlier row has.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h1 = F.xxhash64(F.lit(1), text)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"), F.octet_length(text).cast("long").alias("bytes"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    keyed = cut(keyed)
    dealt = Groups(keyed.select("doc_id", "bytes"), GROUP_BYTES, ID_BLOCK)
    groups = dealt.groups
    classes = keyed.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = dealt.deal(keyed.join(classes, ["h1", "h2"]).where("doc_id > first"), F.col("h1"))
    copies = cut(copies.select("g", "doc_id", "digest").distinct())

    texts = dealt.deal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("data"), h1.alias("h1")), F.col("h1")).drop("h1")
    posted = texts.where("doc_id is not null").select("doc_id", "g", "data").mapInArrow(_post_anchors(groups), "bucket int, g int, data binary")
    shared = cut(posted.groupBy("bucket").applyInArrow(_shared_anchors, "g int, id long, data binary"))
    sample = [r.data for r in shared.where("g = -1").select("data").limit(8 * SAMPLED_GROUPS).collect()]
    sample = np.sort(np.frombuffer(b"".join(sample), f"S{K}"))
    splitters = np.unique(sample[np.linspace(0, len(sample) - 1, groups + 1).astype(int)[1:-1]]) if len(sample) and groups > 1 else sample[:0]

    release(docs.sparkSession)
    rows = texts.select("g", F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "data")
    rows = rows.union(shared.where("g >= 0").select("g", F.lit(1), "id", "data"))
    rows = rows.union(copies.select("g", F.lit(3), "doc_id", "digest"))
    runs = rows.groupBy("g").applyInArrow(_make_runs(groups, splitters), "range long, g int, data binary")
    answers = cut(runs.groupBy("range").applyInArrow(_merge_range, "g int, id long, data binary"))
    release(docs.sparkSession)
    rows = rows.union(answers.select("g", F.lit(2), "id", "data"))
    out = rows.groupBy("g").applyInArrow(_cut_texts(groups, splitters, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, digest binary, again boolean")
    return out if with_text else out.drop("digest", "again")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the repeated bytes; a document of which nothing but blanks is left goes.

    Bytes of characters that a cut has split go too.  Rows meet their texts by id
    and text, so each row of a shared id has its own text once.  Rows without id,
    of which nothing is cut, stay as they are unless blank.
    """
    left = remove_repeats(docs, with_text=True).where("doc_id is not null and not again").where(F.length(F.trim("kept")) > 0)
    left = left.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("kept").alias("_kept"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]).alias("row")  # the old text stays behind
    rows = docs.where("doc_id is not null").select(rest, F.col("doc_id").cast("long").alias("_own"), F.unhex(F.md5(text.cast("binary"))).alias("_text"))
    out = rows.join(left, (F.col("_own") == F.col("_id")) & (F.col("_text") == F.col("_digest"))).select("row", "_kept")
    out = out.union(docs.where("doc_id is null").select(rest, text)).where(F.length(F.trim("_kept")) > 0)
    new = {"text": F.col("_kept"), "n_chars": F.char_length("_kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
