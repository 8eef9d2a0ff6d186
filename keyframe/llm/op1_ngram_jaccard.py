"""N-gram Jaccard self-join by signature trees (operator 1).

Sets of hashed word 5-grams (64 bits) link at Jaccard similarity >= 0.75.  The search is exact:

1. Shared tokens.  Every document posts its tokens, per (hash bucket, document group), as sorted
   24-bit remainders with their number; a bucket answers with the logarithm of how many
   documents hold each (0: no other; clashes only make a token look shared).  A set needs
   three quarters of its tokens in common with a partner, so one with more lonely tokens
   than that leaves has none and is done.
2. Prefixes.  The rest is ordered from rare to common.  Of a linked pair, the larger set has a
   token among its first n - ceil(3n/4) + 1 that the smaller has among its first
   n - ceil(6n/7) + 1, and the larger's size is at most 4/3 of the smaller's.  Sets for which
   this holds are joined to candidate components, through the least set of each (token, size class).
3. Links.  Each component's whole sets meet once; signature trees with exact bitmaps,
   joined by dual traversal, decide every pair by 100*i >= 75*u.

A component of more than BLOCK rows (a long set counts as several) is dealt into salted chunks.
Chunks are joined one by one, then each with the first; then chunks of WIDE rows in
pairs, as far as they hold sets that are not yet connected, so no pair is left out.  Equal sets are folded first, so
no pairs inside a group of copies are listed.

Null doc_id: the row is returned with a null component.  Null, empty or blank
text: an empty set, linked with nothing.  Repeated rows are returned as often as
they come.  Other columns are ignored.  A text of any length is one row: its task holds
some 50 bytes for each of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ID_BLOCK, U64, Groups, boxed, cut, mix, release, shingle_hashes, slices, table, text_buffer, trim, trimmed, written
from .components import components
from .signature_tree import Links, join

WORDS, THRESHOLD = 5, 75
GROUP_BYTES, SLICE = 12 << 20, 8 << 20
BLOCK, WIDE, LONG = 256, 1024, 4096
LOW_BITS = 24
#: Rows of (block, node) that are broadcast to the texts; more are joined by a shuffle.
MAX_BROADCAST = 200_000


def token_sets(column, words: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    data, offs = text_buffer(column)
    for lo, hi in slices(offs):
        s, at = shingle_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], words)
        for r in range(hi - lo):
            yield np.unique(s[at[r] : at[r + 1]])


def _bucket_keys(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << LOW_BITS | remainder of each token hash."""
    return (tokens >> U64(LOW_BITS)) % U64(buckets) << U64(LOW_BITS) | tokens & U64((1 << LOW_BITS) - 1)


def _low_bytes(keys: np.ndarray) -> np.ndarray:
    return keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : LOW_BITS // 8]


def _post_tokens(buckets: int):
    """Rows (g, text) -> rows (bucket, g, n, data): remainders, ascending, and how many sets hold each (at most 255)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            group = np.asarray(b.column(0))
            _, offs = text_buffer(b.column(1))
            for lo, hi in slices(offs, SLICE):
                sets = list(token_sets(b.column(1).slice(lo, hi - lo)))
                if not sum(map(len, sets)):
                    continue
                here, number = np.unique(group[lo:hi], return_inverse=True)
                key = _bucket_keys(np.concatenate(sets), buckets) | np.repeat(number.astype(U64) << U64(48), [len(s) for s in sets])
                key, many = np.unique(key, return_counts=True)
                many = np.minimum(many, 255).astype(np.uint8)
                run_of = key >> U64(LOW_BITS)
                at = np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1]]))
                low = _low_bytes(key & U64((1 << LOW_BITS) - 1))
                out = [low[s:e].tobytes() + many[s:e].tobytes() for s, e in zip(at, np.append(at[1:], len(key)), strict=True)]
                bucket = (run_of[at] & U64((1 << (48 - LOW_BITS)) - 1)).astype(np.int32)
                g, n = here[(key[at] >> U64(48)).astype(np.int64)].astype(np.int32), np.diff(np.append(at, len(key))).astype(np.int32)
                for i in range(0, len(at), 4000):
                    j = slice(i, i + 4000)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[j]), pa.array(g[j]), pa.array(n[j]), pa.array(out[j], pa.binary())], names=["bucket", "g", "n", "data"])

    return trimmed(run)


def _count_tokens(key, t):
    """Of one bucket: to each group, for each of its remainders in ascending order, the level (logarithm) of its number."""
    import pyarrow as pa

    groups, sizes, blobs = t.column("g").to_pylist(), t.column("n").to_pylist(), t.column("data").to_pylist()
    low, many = [], []
    for n, d in zip(sizes, blobs, strict=True):
        x = np.zeros((n, 4), np.uint8)
        x[:, : LOW_BITS // 8] = np.frombuffer(d, np.uint8, n * (LOW_BITS // 8)).reshape(n, -1)
        low.append(x.view("<u4").ravel())
        many.append(np.frombuffer(d, np.uint8, n, n * (LOW_BITS // 8)))
    total = np.zeros(1 << LOW_BITS, np.uint32)
    for x, m in zip(low, many, strict=True):  # distinct in each
        total[x] += m
    by: dict[int, list] = {}
    for g, x in zip(groups, low, strict=True):
        by.setdefault(g, []).append(x)
    out = []
    for g, own in by.items():
        x = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
        out.append(np.floor(np.log2(total[x])).astype(np.uint8).tobytes())
    del total
    bucket = key[0].as_py()
    return pa.table({"g": pa.array(list(by), pa.int32()), "id": pa.array([bucket] * len(by), pa.int64()), "data": pa.array(out, pa.binary())})


def index_tokens(n: int) -> int:
    """How many first tokens the smaller set of a pair needs: one more than those that may be outside the overlap."""
    return n + (-2 * THRESHOLD * n) // (100 + THRESHOLD) + 1


def probe_tokens(n: int) -> int:
    return n + (-THRESHOLD * n) // 100 + 1


def _survivors(buckets: int):
    """Of one group: each row with its set's size and 128-bit hash; with prefix, text if it may have a partner."""

    def run(key, t):
        import pyarrow as pa
        import pyarrow.compute as pc

        d = t.filter(pc.equal(t.column("kind"), 0))
        ids, salts, column = d.column("id").to_pylist(), d.column("t").to_pylist(), d.column("data").combine_chunks()
        sets = list(token_sets(column))
        size = np.array([len(s) for s in sets], np.int64)
        usable = [s for s, i in zip(sets, ids, strict=True) if i is not None]
        flat = np.concatenate([np.zeros(0, U64), *usable])
        answers = t.filter(pc.equal(t.column("kind"), 1))
        answers = sorted(zip(answers.column("id").to_pylist(), answers.column("data").to_pylist(), strict=True))
        level = np.frombuffer(b"".join(x for _, x in answers), np.uint8)
        if len(flat):
            _, number = np.unique(_bucket_keys(flat, buckets), return_inverse=True)
            level = level[number]
        out, seen, at = [], {}, 0
        with np.errstate(over="ignore"):
            hashes = [(int(mix(s + U64(1)).sum(dtype=U64).astype(np.int64)), int(mix(s + U64(0x51ED270B)).sum(dtype=U64).astype(np.int64))) for s in sets]
        for i in sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: ids[i], reverse=True):
            seen[hashes[i]] = i  # the least id of each set
        for i, s in enumerate(sets):
            prefix = early = text = None
            if ids[i] is not None:
                mine = level[at : at + len(s)]
                at += len(s)
                alone, n = int((mine == 0).sum()), len(s)
                if n and alone < probe_tokens(n) and seen[hashes[i]] == i:
                    order = np.lexsort((s, mine))[alone : probe_tokens(n)]
                    prefix, early, text = s[order].astype(np.int64), max(0, index_tokens(n) - alone), column[i]
            out.append((ids[i], salts[i], int(size[i]), *hashes[i], prefix, early, text))
        x = list(zip(*out, strict=True)) or [()] * 8
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        out = pa.table({n: pa.array(v, k) for n, v, k in zip(["doc_id", "t", "n", "h1", "h2", "prefix", "early", "text"], x, types, strict=True)})
        trim()
        return out

    return run


def _least_whole(a, b):
    """Common tokens that two sets of these sizes need."""
    return (THRESHOLD * (a + b) + 99 + THRESHOLD) // (100 + THRESHOLD)


def _blocks(batches):
    """Rows (block, node, n, payload) sorted by block -> links (a, b)."""
    import pyarrow as pa

    links, sent = Links(), 0
    block, ids, sizes, held = None, [], [], []

    def close():
        if len(ids) > 1:
            tokens = [t for column in held for t in token_sets(column)]
            join(np.array(ids, np.int64), np.array([len(t) for t in tokens], np.int64), tokens, _least_whole, links)

    for b in batches:
        at = np.asarray(b.column(0))
        cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]]) if len(at) else [0]
        node = np.asarray(b.column(1))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if at[lo] != block:
                close()
                block, ids, sizes, held = at[lo], [], [], []
            ids.extend(node[lo:hi].tolist())
            held.append(b.column(2).slice(lo, hi - lo))
        if len(links.made) - sent > 5000:
            out, sent = links.made[sent:], len(links.made)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
    close()
    if out := links.made[sent:]:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])


def _linked(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links found within each block of rows (block, node); texts (node, data) come along."""
    rows = cut(rows)
    few = rows.count() <= MAX_BROADCAST  # two integers each
    t = texts.join(F.broadcast(rows) if few else rows, "node").select("block", "node", "data")
    return t.repartition("block").sortWithinPartitions("block").mapInArrow(trimmed(_blocks), "a long, b long")


def _chunked(rows: DataFrame, n: DataFrame) -> DataFrame:
    """Rows (block, node) and n (node, weight) -> (block, node, weight, chunk, chunks): salted chunks of a weight of about BLOCK."""
    rows = rows.join(n, "node")
    chunks = rows.groupBy("block").agg(F.ceil(F.sum("weight") / BLOCK).cast("long").alias("chunks"))
    return rows.join(chunks, "block").select("block", "node", "weight", F.pmod(F.xxhash64("node", "block"), "chunks").alias("chunk"), "chunks")


def _within(c: DataFrame) -> DataFrame:
    return c.select(F.xxhash64("block", "chunk").alias("block"), "node")


def _anchored(c: DataFrame) -> DataFrame:
    """Chunk 0 of each large block beside each other chunk: linear in the block."""
    first = c.where("chunk = 0").select("block", "node", F.explode(F.sequence(F.lit(1), F.col("chunks") - 1)).alias("chunk"))
    return first.union(c.where("chunk > 0").select("block", "node", "chunk")).select(F.xxhash64(F.lit("anchor"), "block", "chunk").alias("block"), "node")


def _across(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of chunks for what is still apart: rows (block, node, weight) of one label share families of chunks,
    and no pair of chunks of one same label is made."""
    t = rows.join(labels, "node", "left").select("block", "node", "weight", F.coalesce("label", "node").alias("label"))
    size = t.groupBy("block", "label").agg(F.sum("weight").alias("w"))
    mixed = size.groupBy("block").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("w") < WIDE // 2, F.col("w")).otherwise(0)).alias("rest")).where("labels > 1")
    size = size.join(mixed, "block").select("block", "label", F.when(F.col("w") >= WIDE // 2, F.col("label")).alias("family"), F.when(F.col("w") >= WIDE // 2, F.col("w")).otherwise(F.col("rest")).alias("size"))
    t = t.join(size, ["block", "label"])
    chunks = F.ceil(F.col("size") / WIDE).cast("long")
    t = cut(t.select("block", "node", "family", F.when(F.col("family").isNull(), F.pmod(F.xxhash64("label"), chunks)).otherwise(F.pmod(F.xxhash64("node", "block"), chunks)).alias("chunk")))
    c = t.select("block", "family", "chunk").distinct().withColumn("id", F.xxhash64("block", "family", "chunk"))
    d = c.select("block", F.col("family").alias("family2"), F.col("id").alias("id2"))
    pairs = c.join(d, "block").where("id <= id2 and not (family is not null and family2 is not null and family = family2)")
    pairs = pairs.select("id", "id2", F.xxhash64("id", "id2").alias("pair"))
    pairs = pairs.select("id", "pair").union(pairs.where("id <> id2").select("id2", "pair"))
    return t.withColumn("id", F.xxhash64("block", "family", "chunk")).join(pairs, "id").select(F.col("pair").alias("block"), "node")


def _edges(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def _all_links(c: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels (node, label) after chunks, anchors and, for what stays apart, pairs of chunks."""
    labels = components(_linked(_within(c), texts))
    large = cut(c.where("chunks > 1"))
    if large.isEmpty():
        return labels
    labels = components(_edges(labels).union(_linked(_anchored(large), texts)))
    return components(_edges(labels).union(_linked(_across(large.select("block", "node", "weight"), labels), texts)))


def _candidates(left: DataFrame) -> DataFrame:
    """left (node, n, prefix, early) -> edges (a, b) that join what may be linked, through hubs."""
    size = F.floor(F.log(F.col("n")) / math.log(1.34)).cast("short")  # sizes of a linked pair, at most 4/3 apart, are in one class or two neighbours
    posted = left.select("node", size.alias("size"), F.posexplode("prefix").alias("at", "token"), "early")
    hubs = posted.where("at < early").groupBy("token", "size").agg(F.min("node").alias("hub"))
    hubs = hubs.select("token", "hub", F.explode(F.array("size", (F.col("size") + 1).cast("short"))).alias("size"))
    probes = posted.select("node", "token", "size")
    return probes.join(hubs, ["token", "size"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def _text_hash(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row per row: doc_id, n_shingles, component_id."""
    return _components(docs).drop("t")


def _components(docs: DataFrame) -> DataFrame:
    """The same with t, the hash of the row's text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("t"))
    groups = Groups(docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes")), GROUP_BYTES, ID_BLOCK)
    buckets = 2 * groups.groups
    docs = groups.deal(docs, F.col("t"))
    posted = docs.where("doc_id is not null").select("g", "text").mapInArrow(_post_tokens(buckets), "bucket int, g int, n int, data binary")
    levels = posted.groupBy("bucket").applyInArrow(_count_tokens, "g int, id long, data binary")
    rows = docs.select("g", F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "t", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    rows = rows.union(levels.select("g", F.lit(1), "id", F.lit(0).cast("long"), "data"))
    base = written(rows.groupBy("g").applyInArrow(_survivors(buckets), "doc_id long, t long, n long, h1 long, h2 long, prefix array<long>, early int, text binary"))
    release(spark)

    sets = base.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    left = base.where("prefix is not null").withColumnRenamed("doc_id", "node")  # of each set, one row of each group
    weight = F.greatest(F.lit(1), F.ceil(F.col("n") / LONG)).cast("long")
    reps = left.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.max(weight).alias("weight")).groupBy("node").agg(F.sum("weight").alias("weight"))
    near = components(_candidates(left.select("node", "n", "prefix", "early")))
    chunks = cut(_chunked(near.select("node", F.col("label").alias("block")), reps))
    labels = _all_links(chunks, left.select("node", F.col("text").alias("data")))

    classes = sets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("component"))
    out = base.select("doc_id", "t", F.col("n").alias("n_shingles"), "h1", "h2").join(classes, ["h1", "h2"], "left")
    return out.select("doc_id", "t", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row with the smallest id stays.

    Rows that share that id and belong to its component (as op1 has it, by id) are
    one document: one with words stays before an empty one, then the least text
    hash, and of repeated rows any one.  Rows without id have no component and stay.
    """
    found = _components(docs).where("doc_id = component_id")
    found = found.groupBy("doc_id", "t").agg(F.count("*").alias("rows"), F.min(F.col("n_shingles") == 0).alias("empty"))
    best = found.groupBy("doc_id").agg(F.min(F.struct("empty", "t", "rows")).alias("best"))
    best = best.select(F.col("doc_id").alias("_id"), F.col("best.t").alias("_t"), (F.col("best.rows") > 1).alias("_again"))
    rows = boxed(docs)
    found = rows.join(best, (F.col("row.doc_id").cast("long") == F.col("_id")) & (_text_hash("row.text") == F.col("_t")))
    once = found.where("not _again").select("row").union(found.where("_again").dropDuplicates(["_id"]).select("row"))
    return once.union(rows.where("row.doc_id is null")).select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL) JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * i >= 75 * (nx.n + ny.n - i)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
