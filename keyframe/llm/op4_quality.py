"""Quality by importance resampling with hashed n-gram models (operator 4).

Two generative models share BUCKETS hashed n-grams (character trigrams, and word
bigrams, of which those of a word with itself have a bucket of their own): the
target's, from at most TRAIN_DOCS labelled documents of good quality chosen by the
hash of their id, and the raw one, from all documents.  A document's log weight is
the sum over its n-grams of log p_target - log p_raw; it is tempered by the factor
TEMPER / (TEMPER + n-grams), so that a long document's many small terms, which are
not independent, do not outweigh everything.  Documents are drawn without
replacement by Gumbel top-k: the k largest of tempered weight + Gumbel noise, the
noise a function of seed, id and text.  k is the number of documents whose tempered
weight passes the cut that best separates the labelled ones (all, if no labels
of both kinds are known).

A text without n-grams has weight 0 (log) and is drawn like any other.  Null
text is empty.  Labels other than 0 and 1 do not count; repeated labels of a
document count once (the smallest).  Rows that repeat are drawn together, so more than k may come.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, boxed, cut, mix, slices, span_hashes, table, text_buffer, trimmed, word_spans

BITS, GRAM, TRAIN_DOCS, SMOOTH, SEED, TEMPER = 15, 3, 4000, 0.5, 1234, 1000.0
BUCKETS = 1 << BITS
BINS = 4096


def buckets_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram of one slice; the last bucket holds words that repeat."""
    half = U64(BUCKETS // 2)
    out, rows = [], []
    if len(data) >= GRAM:
        x = data.astype(U64)
        h = mix(x[:-2] << U64(16) | x[1:-1] << U64(8) | x[2:]) % half
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        ok = row[:-2] == row[2:]
        out.append(h[ok].astype(np.int64))
        rows.append(row[:-2][ok])
    starts, ends = word_spans(data, offs)
    if len(starts) > 1:
        w = span_hashes(data, starts, ends, 41)
        row = np.searchsorted(offs, starts, "right") - 1
        same = row[1:] == row[:-1]
        h = (half + mix(w[:-1] + U64(3) * w[1:]) % (half - U64(1))).astype(np.int64)
        h[w[1:] == w[:-1]] = BUCKETS - 1
        out.append(h[same])
        rows.append(row[1:][same])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows)


def _count(batches):
    """One row of n-gram counts for each task."""
    import pyarrow as pa

    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        data, offs = text_buffer(b.column(0))
        for lo, hi in slices(offs):
            total += np.bincount(buckets_of(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def model(texts: DataFrame) -> np.ndarray:
    """Counts by bucket over all rows of texts (text); at most BUCKETS rows reach the driver."""
    got = texts.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in got:
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p = (target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)
    q = (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    return np.log(p) - np.log(q)


def _weigh(ratio: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offs = text_buffer(b.column(2))
            w, n = np.zeros(len(b)), np.zeros(len(b), np.int64)
            for lo, hi in slices(offs):
                bucket, row = buckets_of(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                w[lo:hi] = np.bincount(row, ratio[bucket], hi - lo)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(w)], names=["doc_id", "salt", "n_grams", "log_weight"])

    return trimmed(run)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut of best balanced accuracy, midway between its neighbours; the lowest of equals."""
    if not len(good) or not len(bad):
        return -np.inf
    x = np.concatenate([good, bad])
    y = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    miss_good = np.concatenate([[0], np.cumsum(y)]) / len(good)
    miss_bad = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / len(bad)
    at = int(np.argmin(miss_good + miss_bad))
    if at == 0:
        return -np.inf
    return float(x[-1] + 1 if at == len(x) else (x[at - 1] + x[at]) / 2)


def gumbel(seed: int, *keys: Column) -> Column:
    """Standard Gumbel noise, a function of the seed and the keys."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def top_k_bound(df: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of key; by rounds of histograms, of which BINS rows reach the driver."""
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or n == 0:
        return float("inf")
    if k >= n:
        return lo
    above = 0
    while True:
        width = (hi - lo) / BINS
        if width <= 0 or lo + width == lo:
            return lo
        b = F.least(F.floor((F.col(key) - lo) / width), F.lit(BINS - 1))
        counts = {r.b: (r.n, r.lo, r.hi) for r in df.where((F.col(key) >= lo) & (F.col(key) <= hi)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for i in sorted(counts, reverse=True):
            if above + counts[i][0] >= k:
                break
            above += counts[i][0]
        n, lo, hi = counts[i]
        if n <= BINS:
            return sorted((r[0] for r in df.where((F.col(key) >= lo) & (F.col(key) <= hi)).select(key).collect()), reverse=True)[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, n_grams, log_weight, tempered, sample_key, selected, salt."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("salt"), text.alias("text"))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"))
    good = known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    bad = known.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    target = model(rows.join(F.broadcast(good.select("doc_id")), "doc_id", "left_semi").select("text"))  # at most TRAIN_DOCS ids
    raw = model(rows.select("text"))
    ratio = log_ratio(target, raw) if target.sum() else np.zeros(BUCKETS)
    weighed = cut(rows.mapInArrow(_weigh(ratio), "doc_id long, salt long, n_grams long, log_weight double").withColumn("tempered", F.col("log_weight") * TEMPER / (TEMPER + F.col("n_grams"))))
    tried = weighed.join(F.broadcast(good.union(bad)), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("tempered").alias("tempered")).collect()  # one row for each of at most 2 * TRAIN_DOCS ids
    by = {y: np.array([r.tempered for r in tried if r.y == y]) for y in (0, 1)}
    bound = best_cut(by[1], by[0])
    keyed = weighed.withColumn("sample_key", F.col("tempered") + gumbel(seed, F.col("doc_id"), F.col("salt")))
    k = weighed.where(F.col("tempered") >= bound).count()
    least = top_k_bound(keyed, "sample_key", k)
    return keyed.select("doc_id", "n_grams", "log_weight", "tempered", "sample_key", (F.col("sample_key") >= least).alias("selected"), "salt")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("salt")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not drawn go.

    Rows meet what is drawn by id (null is an id here) and text, so repeated rows stay or go together;
    a null text and an empty one have the same n-grams, but noise of their own.
    """
    kept = resample(docs, table(spark, sf_dir, "labels")).where("selected").select(F.col("doc_id").alias("_id"), F.col("salt").alias("_salt")).distinct()
    on = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("_salt"))
    return boxed(docs).join(kept, on, "left_semi").select("row.*")
