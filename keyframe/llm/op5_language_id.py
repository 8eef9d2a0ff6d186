"""Language identification by a byte convolutional network in numpy (operator 5).

Texts are read in windows of LENGTH bytes.  Bytes are embedded; filters of
several widths slide over the window; each filter's maximum goes through a
rectifier into a softmax over the languages.  Trained with Adam on WINDOWS windows of
each of a bounded sample of labelled documents: TRAIN_DOCS, an equal share of each
language (LEAST_DOCS at least), chosen by the hash of their id.  A text's score is the
mean of its windows' log-probabilities, weighted by their bytes.  Every byte of every
text is read.

In use, embedding and convolution become sums of table rows, one table for each
two bytes of a filter, so a window costs a few gathers.

lang_pred is `und` (score 0) if the text is null or has no letter, or if nothing
could be learned; letters are what Unicode counts in category L.  Ties go to the first
language by name.  A null doc_id counts as not held out.  Repeated rows are repeated results.
Other columns are ignored.  A text of any length is one row: its task holds some 10 bytes for each of its bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, table, text_buffer, trimmed

LENGTH, WIDTHS, FILTERS, EMBED = 512, (2, 3, 4), 12, 8
TRAIN_DOCS, LEAST_DOCS, WINDOWS, EPOCHS, BATCH, RATE = 2400, 24, 2, 4, 64, 0.01
UNKNOWN = "und"


class ByteNet:
    def __init__(self, classes: int, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)), "o": r.normal(0, 0.2, (len(WIDTHS) * FILTERS, classes)), "b": np.zeros(classes)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"c{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients for windows x (n, LENGTH) and classes y."""
        p, n = self.p, len(x)
        e = p["e"][x]
        peaks, parts = [], []
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * EMBED)
            a = cols @ p[f"w{w}"]
            at = a.argmax(axis=1)
            peaks.append(np.take_along_axis(a, at[:, None], 1)[:, 0] + p[f"c{w}"])
            parts.append((cols, at))
        z = np.concatenate(peaks, axis=1)
        h = np.maximum(z, 0)
        logit = h @ p["o"] + p["b"]
        logit -= logit.max(axis=1, keepdims=True)
        q = np.exp(logit)
        q /= q.sum(axis=1, keepdims=True)
        loss = -float((weight * np.log(q[np.arange(n), y] + 1e-9)).mean())
        d = q.copy()
        d[np.arange(n), y] -= 1
        d *= (weight / n)[:, None]
        g = {"o": h.T @ d, "b": d.sum(0), "e": np.zeros_like(p["e"])}
        dz = (d @ p["o"].T) * (z > 0)
        for k, w in enumerate(WIDTHS):
            cols, at = parts[k]
            dk = dz[:, k * FILTERS : (k + 1) * FILTERS]
            best = np.take_along_axis(cols, at[:, :, None], 1)  # (n, FILTERS, w * EMBED)
            g[f"w{w}"] = np.einsum("nfi,nf->if", best, dk)
            g[f"c{w}"] = dk.sum(0)
            de = (dk[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            where = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(g["e"], where, de)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        r = np.random.default_rng(seed)
        share = np.bincount(y, minlength=self.p["b"].size) / len(y)
        weight = (1 / np.maximum(share, 1e-3))[y].astype(np.float32)
        weight /= weight.mean()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                _, g = self.step(x[pick], y[pick], weight[pick])
                t += 1
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, tables over two bytes (the last over one, for an odd width), in float32."""
        out = {}
        for w in WIDTHS:
            one = [self.p["e"] @ self.p[f"w{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)]
            out[w] = [(one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS) if j + 1 < w else one[j] for j in range(0, w, 2)]
        return out

    def log_probabilities(self, x: np.ndarray, tables: dict) -> np.ndarray:
        """(n, classes) for windows x (n, LENGTH)."""
        pair = x[:, :-1].astype(np.int64) << 8 | x[:, 1:]
        peaks = []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            a = None
            for k, t in enumerate(tables[w]):
                at = pair[:, 2 * k : 2 * k + n] if 2 * k + 1 < w else x[:, 2 * k : 2 * k + n]
                a = np.take(t, at, axis=0) if a is None else np.add(a, np.take(t, at, axis=0), out=a)
            peaks.append(a.max(axis=1) + self.p[f"c{w}"])
        logit = np.maximum(np.concatenate(peaks, axis=1), 0) @ self.p["o"] + self.p["b"]
        logit -= logit.max(axis=1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))


def windows(data: np.ndarray, offs: np.ndarray):
    """Batches of (windows, row of each, bytes in each): every byte of every row, in windows padded with 0."""
    n = -(-np.diff(offs) // LENGTH)
    row = np.repeat(np.arange(len(n)), n)
    start = offs[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * LENGTH
    end = np.minimum(start + LENGTH, offs[row + 1])
    padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
    for i in range(0, len(row), 256):
        s, e = start[i : i + 256], end[i : i + 256]
        x = padded[s[:, None] + np.arange(LENGTH)]
        x[np.arange(LENGTH) >= (e - s)[:, None]] = 0
        yield x, row[i : i + 256], e - s


def train(docs: DataFrame) -> tuple[ByteNet | None, list[str]]:
    """docs (doc_id, text, lang): learn from rows that are not held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    names = sorted(r.lang for r in known.select(F.col("lang").cast("string").alias("lang")).distinct().collect())  # one row for each language
    if not names:
        return None, []
    size = F.char_length("text")
    places = [F.pmod(F.xxhash64(F.lit(k), "doc_id", "text"), F.greatest(F.lit(1), size - LENGTH // 2)).cast("int") + 1 for k in range(WINDOWS)]
    parts = F.array(*[F.substring(F.col("text"), p, F.lit(LENGTH)) for p in places])
    rows = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("order"), F.xxhash64("text").alias("salt"), F.when(size > LENGTH, parts).otherwise(F.array("text")).alias("parts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "salt"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= max(LEAST_DOCS, TRAIN_DOCS // len(names))).collect()
    x, y = [], []
    for r in sorted(rows, key=lambda r: (r.order, r.salt, r.lang)):
        for part in r.parts:
            part = np.frombuffer(part.encode(), np.uint8)[:LENGTH]
            x.append(np.pad(part, (0, LENGTH - len(part))))
            y.append(names.index(r.lang))
    net = ByteNet(len(names))
    net.fit(np.array(x), np.array(y))
    return net, names


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _predict(net: ByteNet | None, names: list[str]):
    def run(batches):
        import pyarrow as pa

        tables = net.tables() if net else None
        for b in batches:
            n = len(b)
            total, size = np.zeros((n, max(1, len(names)))), np.zeros(n)
            texts = b.column(2).to_pylist()
            if net:
                data, offs = text_buffer(b.column(2))
                for x, row, length in windows(data, offs):
                    np.add.at(total, row, net.log_probabilities(x, tables) * length[:, None])
                    np.add.at(size, row, length)
            mean = total / np.maximum(size, 1)[:, None]
            mean -= mean.max(axis=1, keepdims=True) if n else 0
            q = np.exp(mean)
            q /= q.sum(axis=1, keepdims=True)
            best = q.argmax(axis=1)
            ok = [net is not None and has_letter(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([names[k] if o else UNKNOWN for k, o in zip(best, ok, strict=True)], pa.string()), pa.array([float(q[i, k]) if o else 0.0 for i, (k, o) in enumerate(zip(best, ok, strict=True))], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return trimmed(run)


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    net, names = train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(net, names), "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
