"""Operators without SQL against plain versions of the same rule, and what every one does with odd tables."""

import math
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from test_ops import frame, held, learn_texts, words  # noqa: E402

# ---------------------------------------------------------------- 3


def test_toxicity_scores(spark):
    """Scores are sigmoids of sums over a text's distinct n-grams; ratios are those of smoothed document counts."""
    from keyframe.llm import op3_toxicity as op

    data = learn_texts(random.Random(30), 300)
    texts = [d[0] for d in data] + ["", None, "é", "scumbag scumbag", "x" * 5000, "SCUMBAG ÉÉ"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, d[2]) for i, d in enumerate(data)], "doc_id long, toxic int")
    model = op.train(docs, labels)
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    assert 0 < len(weight) <= op.FEATURES

    def hashes(text):
        t = "".join(chr(op.SMALL[ord(c)]) if ord(c) < 0x600 else c for c in text)
        grams = {t[i : i + n] for n in op.SIZES for i in range(len(t) - n + 1)}
        return {int(h[0]) for g in grams for n, h in op.ngram_hashes(np.array([ord(c) for c in g], np.uint32)) if n == len(g)}

    got = {r.doc_id: r for r in op.toxicity(docs, labels).collect()}
    for i, t in enumerate(texts):
        z = model.bias + sum(weight.get(h, 0.0) for h in hashes(t or ""))
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-6
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == held(i)

    counts = np.array([[0.0, 3.0, 9.0], [5.0, 3.0, 0.0]])
    r = op.log_count_ratios(counts, np.array([[20.0], [10.0]]))
    assert np.allclose(r, [math.log((0.5 + p) / 11) - math.log((0.5 + q) / 21) for q, p in counts.T])


# ---------------------------------------------------------------- 4


def trigrams_and_bigrams(op, text):
    """Buckets of a text's n-grams, one n-gram at a time."""
    b = (text or "").encode()
    out = Counter()
    one = lambda raw, at: int(op.buckets_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][at])
    for i in range(len(b) - 2):
        out[one(b[i : i + 3], 0)] += 1
    w = [x for x in bytes(32 if 9 <= c <= 13 else c for c in b).split(b" ") if x]
    for x, y in zip(w, w[1:], strict=False):
        out[op.BUCKETS - 1 if x == y else one(x + b" " + y, -1)] += 1
    return out


def drawn(spark, op, texts, ids, quality, seed):
    """The selected (id, text) by plain sums, a sorted list of keys and the k-th of them."""
    grams = [trigrams_and_bigrams(op, t) for t in texts]
    first = lambda y: [i for i in ids if quality.get(i) == y]
    target, raw = np.zeros(op.BUCKETS), np.zeros(op.BUCKETS)
    for i, g in zip(ids, grams, strict=True):
        for k, n in g.items():
            raw[k] += n
            target[k] += n * (quality.get(i) == 1)
    ratio = [math.log((t + 0.5) / (target.sum() + op.BUCKETS / 2)) - math.log((r + 0.5) / (raw.sum() + op.BUCKETS / 2)) for t, r in zip(target, raw, strict=True)]
    weight = [sum(n * ratio[k] for k, n in g.items()) * 1000 / (1000 + sum(g.values())) for g in grams]
    by = {i: min(w for j, w in zip(ids, weight, strict=True) if j == i) for i in ids}
    good, bad = [by[i] for i in first(1)], [by[i] for i in first(0)]
    cuts = sorted(good + bad)
    cuts = [-math.inf, *[(a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False)], cuts[-1] + 1]
    bound = min(cuts, key=lambda c: (sum(g < c for g in good) / len(good) + sum(b >= c for b in bad) / len(bad), c))
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "i long, t string").select("i", "t", F.xxhash64(F.lit(seed), "i", F.xxhash64("t")).alias("h")).collect()
    noise = {(r.i, r.t): -math.log(-math.log(((r.h % 2**64 >> 11) + 0.5) / 2**53)) for r in rows}
    keys = [w + noise[i, t] for i, t, w in zip(ids, texts, weight, strict=True)]
    k = sum(w >= bound for w in weight)
    least = sorted(keys, reverse=True)[k - 1]
    return Counter((i, t) for i, t, x in zip(ids, texts, keys, strict=True) if x >= least), weight, k


def quality_case():
    r = random.Random(31)
    texts, quality = [None, "", "ab", "aa aa", "é\tb"], {}
    for i in range(5, 150):
        bad = i % 5 == 0
        texts.append(words(r, r.randint(5, 60), "xyzw!" if bad else "abcdefg"))
        if i < 110:
            quality[i] = int(not bad)
    return texts, quality


def test_quality_draw(spark):
    from keyframe.llm import op4_quality as op

    texts, quality = quality_case()
    ids = list(range(len(texts)))
    want, weight, k = drawn(spark, op, texts, ids, quality, op.SEED)
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    got = op.resample(frame(spark, texts), labels).collect()
    assert all(abs(r.tempered - weight[r.doc_id]) < 1e-6 for r in got) and 0 < k < len(texts)
    assert Counter((r.doc_id, texts[r.doc_id]) for r in got if r.selected) == want


# ---------------------------------------------------------------- 5


def test_language_predictions(spark):
    """Every text's prediction by a plain convolution over its windows."""
    from keyframe.llm import op5_language_id as op

    data = learn_texts(random.Random(32), 120)
    texts = [d[0] for d in data] + ["a" * 1300, "é" * 700 + " abc", "x"]
    langs = [d[1] for d in data] + ["en", "xx", "en"]
    docs = frame(spark, texts, langs)
    net, names = op.train(docs)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def forward(window):
        e, z = p["e"][window], []
        for w in op.WIDTHS:
            z.append(np.max([e[i : i + w].reshape(-1) @ p[f"w{w}"] for i in range(len(window) - w + 1)], axis=0) + p[f"c{w}"])
        logit = np.maximum(np.concatenate(z), 0) @ p["o"] + p["b"]
        return logit - logit.max() - np.log(np.exp(logit - logit.max()).sum())

    got = {r.doc_id: r for r in op.identify(docs).collect()}
    for i, t in list(enumerate(texts))[::5] + list(enumerate(texts))[-3:]:
        b = t.encode()
        parts = [b[s : s + op.LENGTH] for s in range(0, len(b), op.LENGTH)]
        mean = sum(len(x) * forward(np.frombuffer(x.ljust(op.LENGTH, b"\0"), np.uint8)) for x in parts) / len(b)
        q = np.exp(mean - mean.max())
        q /= q.sum()
        assert got[i].lang_pred == names[int(q.argmax())] and abs(got[i].score - q.max()) < 1e-3


# ---------------------------------------------------------------- 6


def budgets(node, budget, epochs):
    """{path: tokens given}: by weights among siblings that are not full, found by bisection of the level."""
    capacity = lambda n: sum(capacity(c) for c in n["children"].values()) if n["children"] else n["tokens"] * epochs
    if not node["children"]:
        return {(): min(budget, capacity(node))}
    kids = sorted(node["children"].items())
    total = min(budget, sum(capacity(c) for _, c in kids))
    even = not any(c["weight"] for _, c in kids)
    weight = {k: 1.0 if even else c["weight"] for k, c in kids}
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(capacity(c), mid * weight[k]) for k, c in kids) < total else (low, mid)
    share = {k: min(capacity(c), high * weight[k]) for k, c in kids}
    whole = {k: int(share[k] + 1e-6) for k, _ in kids}
    for k in sorted((k for k, c in kids if whole[k] < capacity(c)), key=lambda k: (whole[k] - share[k], k))[: total - sum(whole.values())]:
        whole[k] += 1
    return {(k, *path): n for k, c in kids for path, n in budgets(c, whole[k], epochs).items()}


def mixture(spark, op, rows, share, epochs):
    """Counter of (id, epoch) for rows (id, text, lang, source): budgets, then the seeded order up to each budget."""
    tree = {"weight": 1.0, "tokens": 0, "children": {}}
    leaf_rows = {}
    for i, t, lang, source in rows:
        n = len((t or "").translate({ord(c): " " for c in "\t\n\x0b\f\r"}).split(" ")) - (t or "").translate({ord(c): " " for c in "\t\n\x0b\f\r"}).split(" ").count("")
        path = ("low" if (source or "")[-1:] in list("01234") else "high", *("" if v is None else "=" + v for v in (lang, source)))
        node = tree
        for level, name in zip(op.LEVELS, path, strict=True):
            node = node["children"].setdefault(name, {"weight": float(op.WEIGHTS[level].get(name.removeprefix("="), 1.0)), "tokens": 0, "children": {}})
        node["tokens"] += n
        leaf_rows.setdefault(path, []).append((i, t, n))
    given = budgets(tree, int(share * sum(n for v in leaf_rows.values() for _, _, n in v)), epochs)
    out = Counter()
    for path, mine in leaf_rows.items():
        tokens = sum(n for _, _, n in mine)
        full, rest = divmod(given[path], tokens) if tokens else (epochs, 0)
        ranges = max(1, len(mine) // op.RANGE_DOCS)
        h = spark.createDataFrame([(i, t) for i, t, _ in mine], "i long, t string").select("i", "t", F.xxhash64("t").alias("s"), F.xxhash64(F.lit(op.SEED), F.lit(full).cast("long"), "i", F.xxhash64("t")).alias("h")).collect()
        place = {(x.i, x.t): ((x.h >> 24) % ranges, x.h, x.i, x.s) for x in h}
        spent = 0
        for i, t, n in sorted(mine, key=lambda x: place[x[0], x[1]]):
            out.update((i, e) for e in range(full))
            if spent < rest:
                out[i, full] += 1
            spent += n
    return out


def mixing_case():
    r = random.Random(33)
    rows = [(i, words(r, r.randint(0, 25)), r.choice(["en", "en", "fr", "de", None, ""]), r.choice(["src0", "src0", "src0", "src1", "src7", None, ""])) for i in range(300)]
    return rows + [(300, None, "en", "src0"), (301, "a\tb\nc", "es", "src9")]


@pytest.mark.parametrize("share,epochs,ranges", [(0.8, 2, 2048), (0.3, 1, 15), (1.7, 2, 40)])
def test_mixing_draw(spark, monkeypatch, share, epochs, ranges):
    from keyframe.llm import op6_mixing as op

    monkeypatch.setattr(op, "RANGE_DOCS", ranges)
    rows = mixing_case()
    docs = frame(spark, [x[1] for x in rows], [x[2] for x in rows], [x[3] for x in rows])
    got = op.mix(docs, share=share, epochs=epochs).collect()
    assert Counter((x.doc_id, x.epoch) for x in got) == mixture(spark, op, rows, share, epochs)
    by = {x[0]: x for x in rows}
    assert all((x.lang, x.source) == by[x.doc_id][2:] for x in got)


# ---------------------------------------------------------------- odd tables

OPERATORS = {
    "op1": lambda d, lb: __import__("keyframe.llm.op1_ngram_jaccard", fromlist=["x"]).jaccard_components(d),
    "op2": lambda d, lb: __import__("keyframe.llm.op2_suffix_dedup", fromlist=["x"]).remove_repeats(d),
    "op3": lambda d, lb: __import__("keyframe.llm.op3_toxicity", fromlist=["x"]).toxicity(d, lb),
    "op4": lambda d, lb: __import__("keyframe.llm.op4_quality", fromlist=["x"]).resample(d, lb),
    "op5": lambda d, lb: __import__("keyframe.llm.op5_language_id", fromlist=["x"]).identify(d),
    "op8": lambda d, lb: __import__("keyframe.llm.op8_packing", fromlist=["x"]).packed(d.sparkSession, d, ""),
    "op9": lambda d, lb: __import__("keyframe.llm.op9_winnowing", fromlist=["x"]).fingerprints(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(spark, name):
    """Nulls, repeats, empties, ties, one very long text and extreme ids: every row has its result."""
    r = random.Random(34)
    long = words(r, 60_000)
    texts = [None, "", " ", "a", "same text here", "same text here", "same text here", "same text here", long, long + " end", words(r, 30)]
    ids = [None, 1, 2, None, 5, 5, 6, None, 2**62, -(2**62), 7]
    labels = spark.createDataFrame([(5, 1, 1, "z"), (7, 0, 0, "z"), (7, 0, 0, "z"), (None, 1, 1, "z"), (1, None, None, "z")], "doc_id long, toxic int, quality int, text string")
    got = OPERATORS[name](frame(spark, texts, ids=ids), labels).collect()
    rows = [x for x in got if name != "op8" or x.start == 0]
    assert Counter(x.doc_id for x in rows) == Counter(ids)
    if name == "op1":
        assert {x.component_id for x in rows if x.doc_id in (2**62, -(2**62))} == {-(2**62)}
        assert {x.component_id for x in rows if x.doc_id in (5, 6)} == {5}
    if name == "op2":
        by = {x.doc_id: x for x in rows}
        assert by[-(2**62)].n_removed == 0 and by[2**62].n_removed == len(long)
    if name == "op8":
        total = Counter()
        for x in got:
            total[x.doc_id] += x.length
        assert total[2**62] == next(x.doc_tokens for x in got if x.doc_id == 2**62) > 60_000
    if name == "op9":
        by = {x.doc_id: x for x in rows}
        assert by[2**62].n_chars == len(long) and by[2**62].fingerprint == by[2**62].fingerprint.lower()


def test_vectors_of_any_kind(spark):
    """Short, long, tiny and huge vectors, clusters, ties and repeated ids: as many as there are, the nearest first."""
    from keyframe.llm import op10_permutation_ann as op

    r = np.random.default_rng(35)
    centres = r.normal(size=(8, 12))
    x = np.concatenate([centres[np.arange(120) % 8] + 0.01 * r.normal(size=(120, 12))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, [0.5] * 12), (1000, [1e-200] * 12), (1001, [1e150] * 12), (1020, [3.0, 4.0]), (1021, [1.0, 0.0]), (1040, [2.0] * 7)]
    got = {}
    for s in op.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(s.query_id, []).append((s.rank, s.vec_id))
    assert set(got) == {0, 20, 40, 60, 80, 100, 1000, 1020}
    assert all([f[0] for f in got[q]] == list(range(1, 21)) for q in (0, 20, 40, 60, 80, 100, 1000)) and got[1020] == [(1, 1021)]
    y = {i: np.array(v) for i, v in rows[:120]} | {1000: np.array([1e-200] * 12), 1001: np.array([1e150] * 12)}
    y[5] = np.array(min(rows[5][1], [0.5] * 12))
    hits = []
    for q in (0, 20, 40, 60, 80, 100):
        want = sorted((i for i in y if i != q), key=lambda i: (-float(y[i] @ y[q]), i))[:20]
        hits.append(len({v for _, v in got[q]} & set(want)))
    assert np.mean(hits) >= 18


def test_crc_of_ids():
    assert held(2) == (zlib.crc32(b"2") % 4 == 2)
