"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 3).

Features are the distinct character n-grams (SIZES, A-Z and the like in lower
case) of a whole text.  From at most TRAIN_DOCS labelled documents of each class,
chosen by the hash of their id, each n-gram gets r = log((a + p) / P) - log((a + q) / Q)
over the numbers of toxic and other documents that hold it.  The FEATURES n-grams
of most weight in that comparison stay; their r are the inputs of a logistic
regression with an L2 penalty.  A score is the sigmoid of the sum over a text's
features.

A label counts if it is 0 or 1 and its document has text, of TRAIN_BYTES at most;
repeated labels of one document count once (the largest); one without id does not count.  Null or empty texts, and all texts if nothing
could be learned, get the score of a text without features.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, held_out, mix, slices, stream, table, text_buffer, trimmed

SIZES, TRAIN_DOCS, TRAIN_BYTES, FEATURES = (4, 5, 6), 1200, 1 << 16, 2000
SMOOTH, PENALTY, STEPS = 0.5, 0.001, 500
COUNT_BITS, FILTER_BITS, LEAST_DOCS = 22, 20, 4
CUT = 0.3
#: Lower case of the Latin, Greek and Cyrillic letters that have one of a single code point.
SMALL = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x600)], np.uint32)


def points_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the rows and their offsets."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offs]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return np.where(points < 0x600, SMALL[np.minimum(points, 0x5FF)], points), at


def ngram_hashes(points: np.ndarray):
    """(size, hash of the n-gram at each place) for each size."""
    mult = stream(31, max(SIZES))
    x = points.astype(U64) + U64(1)
    done, h = 0, np.zeros(len(x), U64)
    for size in SIZES:
        while done < size:
            if len(x) > done:
                h = h[: len(x) - done] + x[done:] * mult[done]
            done += 1
        if len(x) >= size:
            yield size, mix(h ^ U64(size))


def distinct(points: np.ndarray) -> np.ndarray:
    found = [np.unique(h) for _, h in ngram_hashes(points)]
    return np.concatenate(found) if found else np.zeros(0, U64)


class Model:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float) -> None:
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The score of each row of one slice."""
        points, at = points_of(data, offs)
        seen = np.zeros(1 << FILTER_BITS, bool)
        shift = U64(64 - FILTER_BITS)
        seen[self.hashes >> shift] = True
        row, slot = [], []
        for size, h in ngram_hashes(points) if len(self.hashes) else ():
            hit = np.flatnonzero(seen[h >> shift])
            k = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
            r = np.searchsorted(at, hit, "right") - 1
            ok = (self.hashes[k] == h[hit]) & (hit + size <= at[np.minimum(r + 1, len(at) - 1)])
            row.append(r[ok])
            slot.append(k[ok])
        z = np.full(len(offs) - 1, self.bias)
        if row:
            pair = np.unique(np.concatenate(row) * (len(self.hashes) + 1) + np.concatenate(slot))
            np.add.at(z, pair // (len(self.hashes) + 1), self.weights[pair % (len(self.hashes) + 1)])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def log_count_ratios(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """From how many other and toxic documents hold each n-gram (two rows), of how many there are."""
    p = (SMOOTH + counts) / (SMOOTH * 2 + total)
    return np.log(p[1]) - np.log(p[0])


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Learn from texts and their labels (0 or 1)."""
    y = np.asarray(labels, np.float64)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else -3.0
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, U64), np.zeros(0), base)
    shift, small = U64(64 - COUNT_BITS), np.zeros((2, 1 << COUNT_BITS), np.int32)

    def grams(text: str) -> np.ndarray:
        b = np.frombuffer(text.encode(), np.uint8)
        return distinct(points_of(b, np.array([0, len(b)]))[0])

    for t, k in zip(texts, labels, strict=True):
        small[int(k)][np.unique(grams(t) >> shift)] += 1
    total = np.array([[len(y) - y.sum()], [y.sum()]])

    def worth(c: np.ndarray) -> np.ndarray:
        """A G-statistic's share of what an n-gram tells, and nothing for rare ones."""
        s = c.sum(axis=0)
        e = s * total / total.sum()
        g = (c * np.log(np.maximum(c, 1e-9) / np.maximum(e, 1e-9))).sum(axis=0)
        return np.where(s >= LEAST_DOCS, g, 0)

    often = np.flatnonzero(small.sum(axis=0) >= LEAST_DOCS)
    w = worth(small[:, often])
    cut = max(np.partition(w, -4 * FEATURES)[-4 * FEATURES], 1.0) if len(w) > 4 * FEATURES else 1.0
    wanted = np.zeros(small.shape[1], bool)
    wanted[often[w >= cut]] = True
    exact: dict[int, list[int]] = {}
    held = []
    for t, k in zip(texts, labels, strict=True):
        h = grams(t)
        h = np.unique(h[wanted[h >> shift]])
        held.append(h)
        for v in h.tolist():
            exact.setdefault(v, [0, 0])[int(k)] += 1
    hashes = np.array(list(exact), U64)
    counts = np.array(list(exact.values()), np.float64).reshape(-1, 2).T
    pick = np.argsort(-worth(counts), kind="stable")[:FEATURES]
    pick = pick[worth(counts)[pick] > 0]
    pick = pick[np.argsort(hashes[pick])]
    hashes, r = hashes[pick], log_count_ratios(counts[:, pick], total)
    x = np.zeros((len(texts), len(hashes)), np.float32)
    for i, h in enumerate(held):
        k = np.searchsorted(hashes, h)
        ok = (k < len(hashes)) & (hashes[np.minimum(k, len(hashes) - 1)] == h) if len(hashes) else np.zeros(len(h), bool)
        x[i, k[ok]] = r[k[ok]]
    x /= np.sqrt(max(1.0, float((x**2).sum(axis=1).mean())))
    scale = np.sqrt(max(1.0, float((np.where(x != 0, r, 0) ** 2).sum(axis=1).mean())))
    wt, b = np.zeros(len(hashes), np.float32), np.float32(0)
    m, s = np.zeros(len(hashes) + 1, np.float32), np.zeros(len(hashes) + 1, np.float32)
    y = y.astype(np.float32)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    for t in range(1, STEPS + 1):
        z = np.clip(x @ wt + b, -60, 60)
        d = balance * (1 / (1 + np.exp(-z)) - y) / len(y)
        g = np.append(x.T @ d + PENALTY * wt / len(hashes), d.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        wt, b = wt - step[:-1], b - step[-1]
    return Model(hashes, wt * r / scale, float(b))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """docs (doc_id, text), labels (doc_id, column): learn from rows that are not held out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).alias("y"))
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for y in (0, 1)]
    ids = F.broadcast(some[0].union(some[1]))  # at most 2 * TRAIN_DOCS rows
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], np.array([r.y for r in rows]))


def _score(model: Model):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offs = text_buffer(b.column(2))
            found = [model.scores(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in slices(offs)]
            s = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return trimmed(run)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
