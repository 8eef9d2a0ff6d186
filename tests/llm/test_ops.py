"""Small tests of each operator against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, g int, label string, kind string"


def frame(spark, texts, langs=None, sources=None, ids=None):
    rows = []
    for i, t in enumerate(texts):
        d = ids[i] if ids else i
        rows.append((d, t, langs[i] if langs else "en", sources[i] if sources else f"src{i % 3}", len(t or ""), 1, 2, "x", "y"))
    return spark.createDataFrame(rows, SCHEMA)


def words(r, n, alphabet="abcdefgh"):
    return " ".join("".join(r.choices(alphabet, k=r.randint(1, 5))) for _ in range(n))


# ---------------------------------------------------------------- 1


def shingles(t):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(sets, ids):
    up = {i: i for i in ids if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (ids[i], ids[j]) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(ids[i]), find(ids[j])
                up[max(x, y)] = min(x, y)
    return [None if i is None else find(i) for i in ids]


def check_jaccard(spark, texts, ids=None):
    from keyframe.llm.op1_ngram_jaccard import jaccard_components

    ids = ids or list(range(len(texts)))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, texts, ids=ids)).collect())
    sets = [shingles(t) for t in texts]
    want = sorted((i is None, i or 0, len(s), c) for i, s, c in zip(ids, sets, components_of(sets, ids), strict=True))
    assert got == want


def near_texts():
    r = random.Random(1)
    texts = [None, "", " \t\n", "One", "one", "a b c d", "A b c d", "a b c d e", "É b c d e f", "é b c d e f"]
    for n in (12, 40, 300):
        for _ in range(4):
            base = words(r, n).split()
            for _ in range(4):
                w = list(base)
                for _ in range(r.randint(0, max(1, n // 40))):
                    w[r.randrange(n)] = "zz"
                texts.append(" ".join(w))
    return texts


def test_jaccard(spark):
    texts = near_texts()
    check_jaccard(spark, texts)
    check_jaccard(spark, ["a b c d e f g"] * 3 + ["x"], ids=[5, 5, None, 7])
    check_jaccard(spark, [])


def test_jaccard_large_blocks(spark, monkeypatch):
    """Blocks far beyond BLOCK and WIDE: chunks, anchors and pairs of chunks are all used."""
    from keyframe.llm import op1_ngram_jaccard as op

    for name, value in (("BLOCK", 8), ("WIDE", 10), ("GROUP_BYTES", 4000), ("ID_BLOCK", 5), ("MAX_BROADCAST", 20)):
        monkeypatch.setattr(op, name, value)
    r = random.Random(2)
    base, passage = words(r, 120).split(), words(r, 40)
    texts = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = f"q{i}"
        texts.append(" ".join(w))
    texts += [passage + " " + words(r, r.choice([8, 30, 100])) for _ in range(60)]
    check_jaccard(spark, texts)


def test_signature_tree_is_exact():
    from keyframe.llm.signature_tree import Links, join

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))).astype(np.uint64) for _ in range(120)]
    links = Links()
    join(np.arange(120), np.array([len(s) for s in sets]), sets, lambda a, b: (75 * (a + b) + 174) // 175, links)
    want = Links()
    for i in range(120):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                want.join(i, j)
    assert [links.find(i) for i in range(120)] == [want.find(i) for i in range(120)]


@pytest.mark.parametrize("local", [7, 10**6])
def test_components(spark, monkeypatch, local):
    from keyframe.llm import components as module
    from keyframe.llm.components import components

    monkeypatch.setattr(module, "LOCAL", local)

    r = random.Random(4)
    edges = [(i, i + 1) for i in range(30)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(45)] + [(500, x) for x in range(501, 560)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# ---------------------------------------------------------------- 2


def removed(texts, ids, kept_too=False):
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i]))
    first, out = {}, {}
    raw = [(texts[i] or "").encode() for i in range(len(texts))]
    for i in order:
        if ids[i] is not None:
            for p in range(len(raw[i]) - 49):
                first.setdefault(raw[i][p : p + 50], ids[i])
    for i in order:
        b, gone = raw[i], bytearray(len(raw[i]))
        for p in range(len(b) - 49):
            if ids[i] is not None and first[b[p : p + 50]] < ids[i]:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), *([kept] if kept_too else []))
    return out


def check_suffixes(spark, texts, ids=None):
    from keyframe.llm.op2_suffix_dedup import remove_repeats

    ids = ids or list(range(len(texts)))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame(spark, texts, ids=ids)).collect())
    want = removed(texts, ids)
    assert got == sorted((i is None, i or 0, *want[k]) for k, i in enumerate(ids))


def repeat_texts():
    r = random.Random(5)
    passages = [words(r, n) for n in (9, 12, 25, 60)]
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 51, "x" * 200, "ab" * 70, "é" * 60, "é" * 61, "\0" * 55, "\0" * 60]
    for _ in range(40):
        t = words(r, r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            t += r.choice(["", " ", "\n", "é"]) + r.choice(passages) + words(r, r.randint(0, 10))
        texts.append(t)
    return texts + [texts[-1], texts[-1] + "!", texts[20], passages[3]]


def test_suffixes(spark):
    texts = repeat_texts()
    check_suffixes(spark, texts)
    check_suffixes(spark, texts, ids=[i // 2 for i in range(len(texts))])
    check_suffixes(spark, texts[::-1], ids=[None if i % 9 == 0 else 3 * i for i in range(len(texts))])
    check_suffixes(spark, [])


def test_suffixes_without_repeats(spark, monkeypatch):
    """Clean tables, and clean groups beside others."""
    from keyframe.llm import op2_suffix_dedup as op

    r = random.Random(61)
    check_suffixes(spark, ["one short text"])
    check_suffixes(spark, [None, "", None])
    check_suffixes(spark, [words(r, 40) for _ in range(3)])
    monkeypatch.setattr(op, "GROUP_BYTES", 400)
    monkeypatch.setattr(op, "ID_BLOCK", 2)
    check_suffixes(spark, [words(r, 40) for _ in range(20)] + [words(r, 20) + "x" * 60 for _ in range(3)])
    check_suffixes(spark, [words(r, 40) for _ in range(9)] + ["z" * 90] * 9, ids=[7] * 5 + [None] * 4 + list(range(9)))


def test_suffixes_many_groups(spark, monkeypatch):
    from keyframe.llm import op2_suffix_dedup as op

    monkeypatch.setattr(op, "GROUP_BYTES", 3000)
    monkeypatch.setattr(op, "ID_BLOCK", 3)
    monkeypatch.setattr(op, "SEGMENT", 700)
    r = random.Random(6)
    check_suffixes(spark, repeat_texts() + [words(r, 1500), words(r, 20)])


def test_loser_tree():
    from keyframe.llm.op2_suffix_dedup import LENGTH, decode_run, encode_run, merge_runs

    r = np.random.default_rng(7)
    for k in (1, 2, 5):
        runs, every = [], []
        for _ in range(k):
            rows = np.unique(r.integers(0, 2, (r.integers(1, 30), LENGTH + 28), dtype=np.uint8) * r.integers(0, 2, LENGTH + 28, dtype=np.uint8), axis=0)
            lcp, right, side, doc = decode_run(encode_run(rows, np.arange(len(rows))))
            assert (right == rows[:, :LENGTH]).all() and (side == rows[:, LENGTH:]).all() and (doc == np.arange(len(rows))).all()
            text = [x.tobytes() for x in right]
            runs.append((text, lcp.tolist()))
            every += text
        order, lcps = merge_runs(runs)
        at, out = [0] * k, []
        for s in order:
            out.append(runs[s][0][at[s]])
            at[s] += 1
        assert out == sorted(every)
        for a, b, n in zip(out, out[1:], lcps[1:], strict=False):
            assert a[:n] == b[:n] and (n == LENGTH or a[n] != b[n])


# ---------------------------------------------------------------- 3, 5


def learn_texts(r, n):
    out = []
    for i in range(n):
        lang = ["en", "xx"][i % 2]
        toxic = i % 5 == 0
        body = words(r, r.randint(5, 60), "abcdefg" if lang == "en" else "éèùôîklm")
        out.append((body + (" scumbag moron " + words(r, 3) if toxic else ""), lang, int(toxic)))
    return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity(spark):
    from keyframe.llm.op3_toxicity import toxicity

    data = learn_texts(random.Random(8), 400)
    docs = frame(spark, [d[0] for d in data] + [None, ""])
    labels = spark.createDataFrame([(i, d[2], 1, "a") for i, d in enumerate(data)] + [(0, 1, 1, "a"), (None, 1, 1, "a"), (7, None, 1, "a")], "doc_id long, toxic int, quality int, text string")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in got.values())
    wrong = [i for i, d in enumerate(data) if held(i) and got[i].predicted != d[2]]
    assert len(wrong) <= 2
    none = toxicity(docs.limit(0), labels.limit(0))
    assert none.count() == 0
    assert {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}


def test_language(spark):
    from keyframe.llm.op5_language_id import identify

    data = learn_texts(random.Random(9), 300)
    texts = [d[0] for d in data] + [None, "", "123 !?", "a" * 2000]
    langs = [None if i == 3 else d[1] for i, d in enumerate(data)] + ["en"] * 4
    got = {r.doc_id: r for r in identify(frame(spark, texts, langs)).collect()}
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and got[300].score == 0
    right = [got[i].lang_pred == d[1] for i, d in enumerate(data) if held(i)]
    assert sum(right) >= 0.95 * len(right)
    assert {r.lang_pred for r in identify(frame(spark, ["abc"], [None])).collect()} == {"und"}
    odd = identify(frame(spark, [*texts[:40], "½ ² ① Ⅷ", "中", "x²"], [*langs[:40], *["en"] * 3])).collect()
    assert [r.lang_pred == "und" for r in sorted(odd, key=lambda r: r.doc_id)[40:]] == [True, False, False]


def test_language_of_few_documents(spark):
    """A language of a few documents among many of another is learned too."""
    from keyframe.llm import op5_language_id as op

    r = random.Random(91)
    texts = [words(r, 30, "abcdefg") for _ in range(300)] + [words(r, 30, "жщшыэю") for _ in range(12)]
    got = {x.doc_id: x.lang_pred for x in op.identify(frame(spark, texts, ["en"] * 300 + ["ru"] * 12)).collect()}
    assert all(got[i] == "ru" for i in range(300, 312)) and sum(got[i] == "en" for i in range(300)) >= 295


def test_language_tables_equal_the_network():
    from keyframe.llm.op5_language_id import LENGTH, WIDTHS, ByteNet, windows

    net = ByteNet(3)
    data = np.random.default_rng(1).integers(0, 256, 1300, dtype=np.uint8)
    seen = 0
    for x, row, n in windows(data, np.array([0, 1300])):
        seen += int(n.sum())
        e = net.p["e"][x]
        peaks = [max_of @ net.p[f"w{w}"] for w in WIDTHS for max_of in [np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * e.shape[2])]]
        z = np.concatenate([p.max(axis=1) + net.p[f"c{w}"] for p, w in zip(peaks, WIDTHS, strict=True)], axis=1)
        logit = np.maximum(z, 0) @ net.p["o"] + net.p["b"]
        want = logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))
        assert x.shape[1] == LENGTH and np.allclose(want, net.log_probabilities(x, net.tables()), atol=1e-4)
    assert seen == 1300


# ---------------------------------------------------------------- 4


def test_quality(spark):
    from keyframe.llm.op4_quality import resample

    r = random.Random(10)
    texts, quality = [], []
    for i in range(300):
        bad = i % 6 == 0
        w = words(r, r.randint(20, 80))
        texts.append(" ".join(x + "!!" for x in w.upper().split()) if bad and i % 4 else " ".join(["junk"] * 60) if bad else w)
        quality.append(int(not bad))
    docs = frame(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality) if i < 200] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in resample(docs, labels).collect()}
    good = [got[i].selected for i, q in enumerate(quality) if q]
    bad = [got[i].selected for i, q in enumerate(quality) if not q]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert {x.doc_id: x.selected for x in resample(docs, labels).collect()} == {k: v.selected for k, v in got.items()}
    assert all(x.selected for x in resample(docs, labels.limit(0)).collect())
    assert resample(docs.limit(0), labels).count() == 0


def test_top_k_bound(spark, monkeypatch):
    from keyframe.llm import op4_quality as op

    monkeypatch.setattr(op, "BINS", 16)
    r = random.Random(11)
    values = [r.gauss(0, 100) for _ in range(700)] + [3.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 300, 360, 749, 750, 900):
        assert op.top_k_bound(df, "x", k) == ranked[min(k, 750) - 1]
    assert op.top_k_bound(df, "x", 0) == math.inf


# ---------------------------------------------------------------- 6


def test_budgets():
    from keyframe.llm.op6_mixing import grow, leaves_of, spread

    leaves = [("a", "x", "1", 100), ("a", "x", "2", 10), ("a", "y", "1", 50), ("b", "x", "1", 1000)]
    root = grow(leaves, {"domain": {"a": 3, "b": 1}, "source": {"1": 1, "2": 1}})
    spread(root, 200, 1)
    got = {x[:3]: x[4] for x in leaves_of(root)}
    # a: 150 of its 160; x and y 75 each, y holds 50, so its 25 go to its sibling; below x, source 2 holds 10, the rest to source 1
    assert got == {("a", "x", "1"): 90, ("a", "x", "2"): 10, ("a", "y", "1"): 50, ("b", "x", "1"): 50}
    spread(root, 10**9, 2)
    assert sum(x[4] for x in leaves_of(root)) == 2 * 1160


def test_mixing(spark):
    from keyframe.llm import op6_mixing as op

    r = random.Random(12)
    texts = [words(r, r.randint(0, 30)) for _ in range(400)] + [None, ""]
    sources = ["src0" if i % 3 else f"src{i % 7}" for i in range(401)] + [None]
    docs = frame(spark, texts, ["en", "fr"] * 201, sources)
    got = op.mix(docs, share=1.3, epochs=3).collect()
    taken = {}
    for x in got:
        taken.setdefault((x.domain, x.lang, x.source or ""), []).append(x)
    tokens = {}
    for i, t in enumerate(texts):
        s = sources[i] or ""
        tokens.setdefault(("low" if s[-1:] in "01234" and s else "high", ["en", "fr"][i % 2], s), []).append(len((t or "").split()))
    root = op.grow([(*k, sum(v)) for k, v in tokens.items()], op.WEIGHTS)
    op.spread(root, int(1.3 * sum(map(sum, tokens.values()))), 3)
    for *path, total, budget in op.leaves_of(root):
        mine = taken.get(tuple(path), [])
        spent = sum(x.tokens for x in mine)
        assert budget <= spent < budget + 31 or not total
        epochs = [x.epoch for x in mine]
        assert all(sum(1 for e in epochs if e == k) == len(tokens[tuple(path)]) for k in range(budget // total if total else 0))
        assert len({(x.doc_id, x.epoch) for x in mine}) == len(mine)
    again = op.mix(docs, share=1.3, epochs=3).collect()
    assert sorted((x.doc_id, x.epoch) for x in again) == sorted((x.doc_id, x.epoch) for x in got)
    assert op.mix(docs.limit(0)).count() == 0


def test_mixing_ranges_equal_one_sort(spark, monkeypatch):
    from keyframe.llm import op6_mixing as op

    r = random.Random(13)
    docs = frame(spark, [words(r, r.randint(1, 9)) for _ in range(300)], sources=["src0"] * 300)
    monkeypatch.setattr(op, "RANGE_DOCS", 20)
    found = op.mix(docs, share=0.5, epochs=1).collect()
    total = sum(x.tokens for x in op.mix(docs, share=1.0, epochs=1).collect())
    spent = sum(x.tokens for x in found)
    assert int(0.5 * total) <= spent < int(0.5 * total) + 9


# ---------------------------------------------------------------- 7


@pytest.fixture(scope="module")
def tree_model():
    from keyframe.llm.op7_html_extract import fit, labelled_pages

    return fit(labelled_pages())


def test_extract_held_out(tree_model):
    from keyframe.llm.op7_html_extract import extract, labelled_pages

    hit = miss = false = 0
    for page, content in labelled_pages(80, 1234):
        got = set(extract(page, *tree_model).split("\n")) - {""}
        hit, miss, false = hit + len(got & content), miss + len(content - got), false + len(got - content)
    assert miss <= 0.03 * (hit + miss) and false <= 0.03 * (hit + false)


def test_extract_page(tree_model):
    from keyframe.llm.op7_html_extract import extract

    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav>
    <!-- note --><div class="ad">Buy now. Cheap things.</div><article><h1>The &amp; title</h1><p><b>First  paragraph of the
    text, long enough to be one.<br><p>Second &lt;paragraph&gt; of it, with more words in it.</p></article><section class="comments"><div class="comment"><p>I disagree with this.</p></div></section><footer>&copy; site</footer></body></html>"""
    assert extract(page, *tree_model) == "The & title\nFirst paragraph of the text, long enough to be one.\nSecond <paragraph> of it, with more words in it."
    assert extract(None, *tree_model) == "" and extract("", *tree_model) == "" and extract("<p", *tree_model) == ""
    deep = "<div>" * 3000 + "<p>Some words that stand very deep in a page.</p>"
    assert isinstance(extract(deep, *tree_model), str)


def test_messages_equal_enumeration(tree_model):
    import itertools

    from keyframe.llm.op7_html_extract import Graph, marginals

    weights, pair = tree_model
    g = Graph("<body><nav><a href=x>go</a></nav><article><p>One two three.</p><p>Four.</p></article></body>")
    q, _ = marginals(g, weights, pair)
    total, ones = 0.0, [0.0] * len(g.nodes)
    for y in itertools.product((0, 1), repeat=len(g.nodes)):
        e = sum(sum(weights[k] for k in f) for f, s in zip(g.features, y, strict=True) if s)
        e += sum(pair[g.kind[i]][y[g.parent[i]]][y[i]] for i in range(1, len(y)))
        total += math.exp(e)
        for i, s in enumerate(y):
            ones[i] += s * math.exp(e)
    assert np.allclose(q, np.array(ones) / total)


def test_extract_parsing():
    """What is hidden, broken or cut off; by blocks, before the model decides."""
    from keyframe.llm.op7_html_extract import nodes_of, parse

    def blocks(page):
        return [b.text for b in nodes_of(parse(page)) if b.tag == "#"]

    assert blocks("<script>for(i=0;i<n;i++){} // don't</script><p>It's the 'quoted' one.</p>") == ["It's the 'quoted' one."]
    assert blocks("<script>var s='<!-- ';</script><p>A</p><p>B</p>") == ["A", "B"]
    assert blocks("<p>First.</p><button>Share<p>Second.</p>") == ["First.", "Second."]
    assert blocks("<p>First.</p><button>Share</button><p>Second.</p>") == ["First.", "Second."]
    assert blocks("<p>a<svg/>b</p><p>c<svg><text>no</text><svg>no</svg></svg>d</p>") == ["a b", "c d"]
    assert blocks("<p>x <math><mi>y</mi></math> z</p><object><p>kept</p></object>") == ["x y z", "kept"]
    assert blocks('<div class="x>bad</div><p>good</p>') == ["bad", "good"]
    assert blocks('<p title="a > b" data-x=\'>\'>text</p>') == ["text"]
    assert blocks("<p title=don't>text, don't</p>") == ["text, don't"]
    assert blocks("<select><option>1<option>2</select><p>text</p>") == ["text"]
    assert blocks("<head><title>T</title><p>a</p>") == ["a"]
    assert blocks("<p>a</p><div cla") == ["a"] and blocks("<p>a &lt; b &#38; c</p>") == ["a < b & c"]


#: Pages in layouts that the training generator does not make, and their main texts.
LAYOUTS = [
    ("""<body><div id="wrapper"><div class="topbar"><a href=/>Home</a> | <a href=/x>News</a> | <a href=/y>Sport</a></div><div class="post-body"><h2>River levels rise after a week of rain</h2><p>Water rose by two metres overnight, the council said on Monday.</p><p>Roads along the bank were closed, and residents were asked to move their cars.</p></div><div class="related-links"><h4>More</h4><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div></div></body>""",
     "River levels rise after a week of rain\nWater rose by two metres overnight, the council said on Monday.\nRoads along the bank were closed, and residents were asked to move their cars."),
    ("""<html><body><header class="site-header"><h1>The Daily</h1><nav><a href="/">Home</a><a href="/w">World</a></nav></header><main><article class="entry"><h1>On keeping bees in small gardens</h1><p>Bees need water, shade and a clear line of flight, which is why a corner of the garden suits them.</p><blockquote><p>Start with one hive, and learn from it for a year.</p></blockquote><p>Neighbours should hear of it first.</p></article><section id="comments"><h3>3 comments</h3><div class="comment"><p>Great article, thanks for sharing it.</p></div></section></main><footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer></body></html>""",
     "On keeping bees in small gardens\nBees need water, shade and a clear line of flight, which is why a corner of the garden suits them.\nStart with one hive, and learn from it for a year.\nNeighbours should hear of it first."),
]


@pytest.mark.parametrize("page,text", LAYOUTS)
def test_extract_other_layouts(tree_model, page, text):
    from keyframe.llm.op7_html_extract import extract

    assert extract(page, *tree_model) == text


def test_extract_query(spark):
    from keyframe.llm.op7_html_extract import main_text

    pages = spark.createDataFrame([(1, "u", "<article><p>Some text that is the main one.</p></article>", "x"), (None, None, None, "x"), (3, "v", "", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in main_text(pages).collect()}
    assert got[1][1] == "Some text that is the main one." and got[1][2] == 31 and got[None] == (None, "", 0) and got[3][1:] == ("", 0)


# ---------------------------------------------------------------- 8


def test_token_ids_equal_the_library():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    from keyframe.llm.common import text_buffer
    from keyframe.llm.tokens import token_rows

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    own = Tokenizer.from_file(path)
    r = random.Random(14)
    parts = ["a", "b", "s", "t", "re", "ve", "ll", "d", "m", "'", "''", " ", "  ", "\n", "\t", "1", "½", "é", "ß", "中", "!", "_", "don't", "I'll", "　", "\x1c", "²", "😀", "<|endoftext|>", "É", " "]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(1500)] + ["", " ", "'", "'s", " 's"]
    got = [x.tolist() for x in token_rows(path, *text_buffer(pa.array(texts)))]
    assert got == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit():
    from keyframe.llm.op8_packing import best_fit_decreasing

    r = np.random.default_rng(15)
    sizes = r.integers(1, 65, 500)
    number, offset = best_fit_decreasing(sizes, 64)
    room = {}
    for i in np.argsort(-sizes, kind="stable"):  # the same by a linear search
        fits = [(left, w) for w, left in room.items() if left >= sizes[i]]
        if fits:
            least = min(fits)[0]
            assert 64 - offset[i] == least and room[number[i]] == least
        else:
            assert offset[i] == 0 and number[i] not in room
        room[number[i]] = 64 - offset[i] - sizes[i]
    assert sizes.sum() / (64 * len(room)) > 0.97


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from keyframe.llm.op8_packing import pack

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    own = Tokenizer.from_file(path)
    r = random.Random(16)
    texts = [None, "", "a", *[words(r, r.randint(1, 200)) for _ in range(40)]]
    got = pack(frame(spark, texts), path, 64).collect()
    ids = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    pieces, windows = {}, {}
    for x in got:
        assert x.doc_tokens == len(ids[x.doc_id]) and x.ids_crc32 == zlib.crc32(ids[x.doc_id][x.start : x.start + x.length].tobytes())
        pieces.setdefault(x.doc_id, []).append((x.start, x.length))
        windows.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for found, size in [(v, len(ids[k])) for k, v in pieces.items()] + [(v, None) for v in windows.values()]:
        at = 0
        for s, n in sorted(found):
            assert s == at
            at += n
        assert at == size if size is not None else at <= 64
    assert len(pieces) == len(texts)
    assert pack(frame(spark, []), path).count() == 0


# ---------------------------------------------------------------- 9


def marks_in(fingerprint):
    from keyframe.llm.op9_winnowing import POSITION_BITS

    return {int(m, 16) >> POSITION_BITS for m in fingerprint.split()}


def test_winnowing(spark):
    from keyframe.llm.op9_winnowing import BUCKET, fingerprints

    r = random.Random(17)
    texts = [None, "", "one", "one two", *[words(r, r.randint(1, 60)) for _ in range(30)]]
    texts += [texts[-1], "é" * 9]
    ids = [i * (BUCKET // 3) - 2000 for i in range(len(texts))]
    rows = fingerprints(frame(spark, texts, ids=ids)).collect()
    got = {x.doc_id: x for x in rows}
    assert len(rows) == len(texts)
    for i, d in enumerate(ids):
        t, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, following = (marks_in(f) for f in (got[d].fingerprint, got[d].edited_fingerprint, got[ids[(i + 1) % len(ids)]].fingerprint))
        assert bool(own) == bool(t)
        for value, other in ((got[d].near_edited, changed), (got[d].near_next, following)):
            assert value == (len(own & other) / len(own | other) if own | other else 1.0)
    assert got[ids[-3]].fingerprint == got[ids[-2]].fingerprint and got[ids[-3]].near_next == 1.0
    alone = fingerprints(frame(spark, ["a b c d", None], ids=[7, None])).collect()
    assert {x.doc_id: x.near_next for x in alone} == {7: 1.0, None: 1.0}
    assert fingerprints(frame(spark, [])).count() == 0


def test_winnowing_short_and_blank_free(spark):
    """Marks in code points: what keeps its first half shares a mark, with few words or none."""
    from keyframe.llm.op9_winnowing import BASE, CHARS, HASH_BITS, POSITION_BITS, PRIME, SPAN, WINDOWS, fingerprints, with_char_marks

    r = random.Random(20)
    texts = ["".join(r.choices("abcdefg ", k=n)) for n in (15, 16, 17, 23, 40, 60, 134, 135, 300)]
    texts += ["".join(chr(0x4E00 + r.randrange(5000)) for _ in range(n)) for n in (15, 20, 80)] + ["".join(r.choices("ab", k=200)), "😀" * 30, "short", "x"]
    got = fingerprints(frame(spark, texts)).collect()
    assert all(x.near_edited > 0 for x in got if x.n_chars >= 15 and x.n_chars == len(texts[x.doc_id]))
    a = "".join(chr(0x4E00 + r.randrange(5000)) for _ in range(200))
    pair = fingerprints(frame(spark, [a, a[:100] + "x" + a[101:]])).collect()
    assert all(x.near_next > 0.6 for x in pair)

    found = [x.m for x in with_char_marks(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "m").collect()]
    whole = [[t[i : i + CHARS] for i in range(max(1, len(t) - CHARS + 1))] for t in texts]
    grams = sorted({g for w in whole for g in w})
    chars = sorted({c for t in texts for c in t})
    code = {x.c: x.h % PRIME for x in spark.createDataFrame([(c,) for c in chars], "c string").select("c", F.xxhash64(F.encode("c", "UTF-32")).alias("h")).collect()}

    def rolled(g):
        h = 0
        for c in g:
            h = (h * BASE + code[c]) % PRIME
        return h

    short = spark.createDataFrame([(g,) for g in grams if len(g) < CHARS], "g string").select("g", F.xxhash64(F.encode("g", "UTF-32")).alias("h")).collect()
    full = spark.createDataFrame([(g, rolled(g)) for g in grams if len(g) == CHARS], "g string, r long").select("g", F.xxhash64("r").alias("h")).collect()
    hashed = {x.g: x.h & ((1 << HASH_BITS) - 1) for x in short + full}
    for w, m in zip(whole, found, strict=True):
        n = next((n for n in (16, 8, 4, 2) if n <= SPAN and len(w) >= n * WINDOWS), 1)
        want = {min((hashed[w[j]], -j) for j in range(i, i + n)) for i in range(len(w) - n + 1)}
        assert {(v >> POSITION_BITS, (v & ((1 << POSITION_BITS) - 1)) - ((1 << POSITION_BITS) - 1)) for v in m} == want and len(m) == len(want)


def test_winnowing_compiled_and_shared(spark):
    """No code point goes through an interpreted lambda; marks of edited texts, mostly taken over, are those of the texts."""
    from keyframe.llm.op9_winnowing import BLOCK, as_text, fingerprints, with_char_marks

    r = random.Random(23)
    lengths = [134, 135, 136, 268, 269, BLOCK + 6, BLOCK + 7, BLOCK + 8, 2 * BLOCK + 22, 2 * BLOCK + 23, 3 * BLOCK + 7, 5000, 20, 5000, 135, 700, 0, 900, 140, 140]
    texts = ["".join(r.choices("abcdefg é😀", k=n)) for n in lengths] + ["a" * 1000, "a" * 400, "ab" * 300, words(r, 300)]
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    plain = with_char_marks(spark.createDataFrame([(i, t) for i, t in enumerate(texts + edited)], "i long, text string"), "text", "m")
    assert "lambda" not in plain._jdf.queryExecution().executedPlan().toString()
    found = [x.f for x in plain.select("i", as_text("m").alias("f")).orderBy("i").collect()]
    for x in fingerprints(frame(spark, texts)).collect():
        assert x.fingerprint == found[x.doc_id] and x.edited_fingerprint == found[len(texts) + x.doc_id]


# ---------------------------------------------------------------- 10


def test_neighbours(spark):
    from keyframe.llm.op10_permutation_ann import nearest

    r = np.random.default_rng(19)
    x = r.normal(size=(600, 16)) + 2 * r.normal(size=(8, 16))[r.integers(0, 8, 600)]
    x[7] = x[8]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    bad = [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (620, [None] * 16, 1), (640, [float("inf")] * 16, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n int")
    got = {}
    for s in nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(s.query_id, []).append((s.rank, s.vec_id, s.score))
    assert sorted(got) == list(range(0, 600, 20))
    hits = []
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(600), -score))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits.append(len(set(want) & {v for _, v, _ in found}))
    assert np.mean(hits) >= 18
    few = nearest(df.where("vec_id < 5 or vec_id >= 600")).collect()
    assert sorted((s.query_id, s.vec_id) for s in few) == [(0, v) for v in range(1, 5)]
    assert nearest(df.limit(0)).count() == 0


def test_neighbours_of_unequal_length(spark):
    from keyframe.llm.op10_permutation_ann import nearest

    r = np.random.default_rng(21)
    x = r.normal(size=(6000, 32))
    x *= np.exp(r.normal(size=(6000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for s in nearest(df, mod=100).collect():
        got.setdefault(s.query_id, set()).add(s.vec_id)
    want = {q: {int(v) for v in np.argsort(-np.where(np.arange(6000) == q, -np.inf, x @ x[q]))[:20]} for q in range(0, 6000, 100)}
    assert np.mean([len(got[q] & want[q]) for q in want]) >= 18
