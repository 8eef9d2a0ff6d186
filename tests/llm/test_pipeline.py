"""The pipeline's stages, each against a brute-force version on its own input."""

import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from test_brute import drawn, mixture  # noqa: E402
from test_ops import components_of, removed, shingles, words  # noqa: E402

DIR = "/root/testdata/sf0.001"
#: The columns of documents, and two whose names the stages use themselves.
WIDE = "doc_id long, text string, lang string, source string, n_chars long, g int, _id string"


def corpus():
    """Rows of all kinds: copies, near copies, shared passages, nulls, blanks, repeated rows, shared ids."""
    r = random.Random(40)
    passage = words(r, 20)
    rows = [(None, None), (None, "no id here at all"), (0, None), (1, ""), (2, "  "), (3, "one"), (3, "one"), (4, "é" * 60)]
    for i in range(5, 120):
        kind = i % 6
        t = words(r, r.randint(1, 40), "xyzw!" if kind == 0 else "abcdefg")
        if kind == 1:
            t += " " + passage
        if kind == 2:
            t = next(x for k, x in reversed(rows) if x and len(x) > 5) + (" more" if i % 4 else "")
        rows.append((i, t))
    rows += [(200, rows[20][1]), (21, rows[40][1]), rows[50], rows[50], (4, "é" * 60)]
    return [(i, t, r.choice(["en", "fr", None]), r.choice(["src0", "src1", "src7", ""]), len(t or ""), 1, "x") for i, t in rows]


def key(rows):
    return Counter(tuple(r) for r in rows)


def expect_quality(spark, rows, labels):
    from keyframe.llm import op4_quality as op

    got, _, _ = drawn(spark, op, [r[1] for r in rows], [r[0] for r in rows], labels, op.SEED)
    return Counter(r for r in rows if (r[0], r[1]) in got)


def expect_near(spark, rows, labels):
    """Each component's smallest id; of its rows in that component, one: with words first, then by the text's hash."""
    from pyspark.sql import functions as F

    component = components_of([shingles(r[1]) for r in rows], [r[0] for r in rows])
    hashes = {x.t: x.h for x in spark.createDataFrame([(t,) for t in {r[1] or "" for r in rows}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    out, best = Counter(r for r in rows if r[0] is None), {}
    for r, c in zip(rows, component, strict=True):
        if r[0] is not None and c == r[0]:
            rank = (not shingles(r[1]), hashes[r[1] or ""])
            if r[0] not in best or rank < best[r[0]][0]:
                best[r[0]] = (rank, r)
    out.update(("once", i, x[1][1] or "") for i, x in best.items())
    return out


def expect_repeats(spark, rows, labels):
    found = removed([r[1] for r in rows], [r[0] for r in rows], kept_too=True)
    out = Counter()
    for k, r in enumerate(rows):
        t = found[k][4].decode("utf-8", "ignore")
        if t.strip(" "):
            out[(r[0], t, *r[2:4], len(t), *r[5:])] += 1
    return out


def expect_mixing(spark, rows, labels):
    from keyframe.llm import op6_mixing as op

    times = Counter()
    for (i, _), n in mixture(spark, op, [r[:4] for r in rows], op.SHARE, op.MAX_EPOCHS).items():
        times[i] += n
    out = Counter()
    for r in rows:
        out[r] += times[r[0]]
    return +out


def unique(rows):
    """Rows with ids of their own, for rules in which rows of one id meet."""
    seen = set()
    return [r for r in rows if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]


STAGES = {"quality": (expect_quality, list), "near_duplicates": (expect_near, list), "repeats": (expect_repeats, list), "mixing": (expect_mixing, unique)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, 0, int(i % 6 != 0)) for i in range(5, 90)]
    spark.createDataFrame([*labels, (5, 1, None), (None, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path, {i: q for i, _, q in labels}


@pytest.mark.parametrize("name", STAGES)
def test_stage(spark, folder, name):
    import corpus_pipeline as p
    from keyframe.llm.common import prepare

    prepare(spark)
    stage, (expect, pick) = dict(p.STAGES)[name], STAGES[name]
    rows = pick(corpus())
    out = stage(spark, spark.createDataFrame(rows, WIDE), folder[0])
    assert out.columns == [c.split()[0] for c in WIDE.split(", ")]
    got = [tuple(r) for r in out.collect()]
    if name == "near_duplicates":
        assert set(got) <= set(rows)
        got = [r if r[0] is None else ("once", r[0], r[1] or "") for r in got]
    assert key(got) == expect(spark, rows, folder[1])


def test_packing_stage(spark, folder):
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = corpus()
    own = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want, windows = Counter(), {}
    for r in rows:
        ids = np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want[(r[0], 0, len(ids), zlib.crc32(ids.tobytes()), len(ids))] += 1
    got = p.STAGES[-1][1](spark, spark.createDataFrame(rows, WIDE), folder[0]).collect()
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want
    for x in got:
        windows.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for w in windows.values():
        w.sort()
        assert w[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(w, w[1:], strict=False)) and w[-1][0] + w[-1][1] <= 1024


def test_stages_of_nothing(spark, folder):
    import corpus_pipeline as p

    empty = spark.createDataFrame([], WIDE)
    for _, stage in p.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0


def test_run(spark):
    """Each stage keeps some of what it is given, and run() gives the last one's rows."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "packing"]
    out = p.run(spark, DIR).collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0 < len({r.doc_id for r in out}) < len(ids) and {r.doc_id for r in out} <= ids


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(pairs)], SCHEMA)


def test_repeats_keep_rows_apart(spark):
    """Rows that share an id, repeated rows and rows without id: each once, with its own text."""
    from keyframe.llm.op2_suffix_dedup import drop_repeats

    pairs = [(1, "one text"), (1, "another"), (1, "one text"), (2, "two"), (None, "lost"), (None, "lost"), (None, "gone astray"), (3, " "), (None, None)]
    out = drop_repeats(spark, rows_of(spark, pairs), DIR).collect()
    assert sorted((str(r.doc_id), r.text, r.source, r.n_chars) for r in out) == sorted((str(i), t, f"s{k}", len(t)) for k, (i, t) in enumerate(pairs) if (t or "").strip())


def test_near_duplicates_keep_one_row(spark):
    """Rows without id stay; repeated rows and rows of a shared id are one; a row of another component goes."""
    from keyframe.llm.op1_ngram_jaccard import keep_one

    a, b = "a b c d e f g h", "p q r s t u v w"
    pairs = [(None, a), (None, None), (1, a), (1, a), (2, a), (2, b), (3, a), (4, "alone in the world here"), (5, None), (5, None), (6, "")]
    out = [(str(r.doc_id), r.text or "") for r in keep_one(spark, rows_of(spark, pairs), DIR).collect()]
    want = [("1", a), ("2", b), ("4", "alone in the world here"), ("5", ""), ("6", ""), ("None", ""), ("None", a)]
    assert sorted(out) == want


def test_registered():
    import __spark_entry__ as e

    q = e.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert "pipeline" in q


def test_held_out_rule(spark):
    from pyspark.sql import functions as F

    from keyframe.llm.common import held_out

    got = {r.id: r.h for r in spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
