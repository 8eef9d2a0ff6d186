"""Approximate nearest neighbours by a permutation index (operator 10).

PIVOTS vectors, sampled by the hash of their id, are the pivots.  Each vector is
represented by the order of all pivots by their nearness to it, and is posted in
the inverted file of each of its POSTED nearest, or of more if it is long: the
number grows with the square of its length over the median length, up to all
pivots.  A query visits the files of its VISITED nearest pivots, ranks what is
posted there by its length times the cosine that the footrule distance between
the two orders stands for, and reranks the nearest RERANK_SHARE of it (RERANK at
least) by the exact inner product in double precision.  A query that has found
fewer vectors than it may visits all files, so none comes short.

Every vector is indexed; only the pivots are a sample.  The files of every
SHARDS-th pivot travel together, so a vector or query is sent once to each of few shards.
A shard is cut into blocks of about BLOCK vectors and, where it draws many queries,
of QUERIES queries, so no pivot's popularity decides the size of a task.  A pair that meets in several
shards is ranked in the first of them.  The share applies to a block, so the
candidates grow with the input: with vectors that have no structure nothing less gives
a recall of 0.9, and the work grows as queries times vectors.

A vector that is null, zero or holds a null or non-finite component takes no
part, nor does one without id.  Vectors are near only to those with as many
components; each number of components is searched by itself.
Ties in score go to the smaller vec_id.  Rows that share a vec_id count once
(the smallest vector).  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, table, trim, trimmed

PIVOTS, POSTED, VISITED, SHARDS = 128, 2, 64, 8
BLOCK, QUERIES, RERANK, RERANK_SHARE, NEAREST = 8192, 4096, 200, 0.2, 20
QUERY_MOD = 20
FOUND = "query_id long, vec_id long, score double"


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivots of each row by cosine, nearest first, ties to the smaller number."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components stay in range
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")


def places(order: np.ndarray) -> np.ndarray:
    """Each pivot's place in each order."""
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=order.dtype)[None, :].repeat(len(order), 0), axis=1)
    return out


def footrule(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sum over pivots of the difference in place."""
    return np.abs(vectors - query).sum(axis=1, dtype=np.int32)


def files(x: np.ndarray, median: float, pivots: int) -> np.ndarray:
    """In how many files each row is posted."""
    with np.errstate(all="ignore"):
        share = np.nan_to_num(np.minimum(np.linalg.norm(x, axis=1) / median, pivots), nan=1.0)
    return np.clip(np.ceil(POSTED * share**2 - 1e-6), min(POSTED, pivots), pivots).astype(np.int64)


def _post(pivots: np.ndarray, median: float, visited: int, dtype: str):
    """Rows (vec_id, e, asks, answers) -> a row for each shard that holds a file which the vector is posted in or asks."""

    def run(batches):
        import pyarrow as pa

        shard_of = np.arange(len(pivots)) % SHARDS
        for b in batches:
            if not len(b):
                continue
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(len(b), -1)
            ids, asks, answers = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in (0, 2, 3))
            place = places(orders(x, pivots)).astype(np.int16)
            many = files(x, median, len(pivots))
            who, where, kind = [], [], []
            for query, rows, limit in ((False, answers, many), (True, asks, np.full(len(b), visited))):
                within = (place < limit[:, None]) & rows[:, None]
                for s in range(SHARDS):
                    hit = np.flatnonzero(within[:, shard_of == s].any(axis=1))
                    who.append(hit)
                    where.append(np.full(len(hit), s, np.int32))
                    kind.append(np.full(len(hit), query))
            who, where, kind = map(np.concatenate, (who, where, kind))
            code = np.concatenate([place.astype(np.uint8), many[:, None].astype(np.uint8)], axis=1)
            code, data = [c.tobytes() for c in code], [v.tobytes() for v in x.astype(dtype)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array(kind), pa.array(ids[who]), pa.array([code[i] for i in who], pa.binary()), pa.array([data[i] for i in who], pa.binary())],
                names=["shard", "query", "vec_id", "code", "data"],
            )

    return trimmed(run)


def _search(nearest: int, visited: int, dtype: str):
    """Of one block of a shard: each query's nearest of what is posted in the files that it visits there."""

    def run(key, t):
        import pyarrow as pa

        shard = key[0].as_py()
        is_query, ids = t.column("query").to_numpy(), t.column("vec_id").to_numpy()
        place = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        place, many = place[:, :-1].astype(np.int16), place[:, -1]
        x = np.frombuffer(b"".join(t.column("data").to_pylist()), dtype).reshape(len(ids), -1).astype(np.float64)
        q, v = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        v = v[np.argsort(ids[v], kind="stable")]
        vp, vx, vid = place[v], x[v], ids[v]
        norm, pivots = np.linalg.norm(vx, axis=1), place.shape[1]
        posted = vp < many[v][:, None]
        file = {p: np.flatnonzero(posted[:, p]) for p in range(shard, pivots, SHARDS)}
        before = (np.arange(pivots) % SHARDS) < shard
        posted_before = (posted & before).astype(np.float32)
        out_q, out_v, out_s = [], [], []
        for lo in range(0, len(q) if len(v) else 0, 256):
            some = q[lo : lo + 256]
            met = posted_before @ (place[some] < visited).astype(np.float32).T > 0  # in a shard before this one
            for j, i in enumerate(some):
                seen = np.zeros(len(v), bool)
                for p, rows in file.items():
                    if place[i, p] < visited:
                        seen[rows] = True
                seen &= ~met[:, j]
                seen &= vid != ids[i]
                c = np.flatnonzero(seen)
                keep = max(RERANK, int(RERANK_SHARE * len(c)))
                if len(c) > keep:
                    d = -norm[c] * np.maximum(1 - 3 * footrule(place[i], vp[c]) / pivots**2, 1e-9)  # unrelated orders differ by a third of the square
                    c = c[d <= np.partition(d, keep - 1)[keep - 1]]
                s = np.einsum("ij,j->i", vx[c], x[i])
                best = np.lexsort((vid[c], -s))[:nearest]
                out_q.append(np.full(len(best), ids[i]))
                out_v.append(vid[c[best]])
                out_s.append(s[best])
        cat = lambda a, k: np.concatenate(a) if a else np.zeros(0, k)
        out = pa.table({"query_id": pa.array(cat(out_q, np.int64), pa.int64()), "vec_id": pa.array(cat(out_v, np.int64), pa.int64()), "score": pa.array(cat(out_s, np.float64), pa.float64())})
        trim()
        return out

    return run


def _found(v: DataFrame, pivots: np.ndarray, median: float, visited: int, k: int, dtype: str) -> DataFrame:
    """v (vec_id, e, asks, answers) -> (query_id, vec_id, score): of each block the k nearest of each query."""
    posted = cut(v.select("vec_id", "e", "asks", "answers").mapInArrow(_post(pivots, median, visited, dtype), "shard int, query boolean, vec_id long, code binary, data binary"))
    size = posted.groupBy("shard").agg(F.count(F.when(~F.col("query"), 1)).alias("n"), F.count(F.when(F.col("query"), 1)).alias("q"))
    sizes = {r.shard: (max(1, -(-r.n // BLOCK)), max(1, -(-r.q // QUERIES))) for r in size.collect()}  # one row for each shard
    if not sizes:
        return v.sparkSession.createDataFrame([], FOUND)
    width = F.create_map(*[F.lit(x) for i, s in sizes.items() for x in (i, s[0])])[F.col("shard")]
    depth = F.create_map(*[F.lit(x) for i, s in sizes.items() for x in (i, s[1])])[F.col("shard")]
    own_v, own_q = F.pmod(F.xxhash64("vec_id"), width).cast("int"), F.pmod(F.xxhash64("vec_id"), depth).cast("int")
    columns = ["shard", "query", "vec_id", "code", "data"]
    queries = posted.where("query").select(*columns, F.explode(F.sequence(F.lit(0), width - 1)).alias("vb"), own_q.alias("qb"))
    others = posted.where("not query").select(*columns, own_v.alias("vb"), F.explode(F.sequence(F.lit(0), depth - 1)).alias("qb"))
    return cut(queries.unionByName(others).groupBy("shard", "vb", "qb").applyInArrow(_search(k, visited, dtype), FOUND))


def _nearest(v: DataFrame, n: int, k: int, dtype: str) -> DataFrame:
    """The same for vectors v (vec_id, e, asks) of one number of components, n of them."""
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    p = np.array([r.e for r in sample], np.float64)
    p /= np.abs(p).max(axis=1, keepdims=True)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, c: a + c * c))
    median = v.agg(F.percentile_approx(length, 0.5)).first()[0]
    found = _found(v.withColumn("answers", F.lit(True)), p, median, VISITED, k, dtype)
    if VISITED >= len(p):
        return found
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = cut(v.where("asks").join(enough, "vec_id", "left_anti").select("vec_id"))
    if short.isEmpty():
        return found
    rest = v.select("vec_id", "e").join(short.withColumn("asks", F.lit(True)), "vec_id", "left")
    rest = rest.select("vec_id", "e", F.coalesce("asks", F.lit(False)).alias("asks"), F.lit(True).alias("answers"))
    return found.union(_found(rest, p, median, len(p), k, dtype))


def nearest(vectors: DataFrame, mod: int = QUERY_MOD, k: int = NEAREST) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score for the queries vec_id % mod = 0."""
    kind = vectors.schema["embedding"].dataType
    dtype = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"  # as they come: nothing is rounded
    e = F.col("embedding").cast("array<double>")
    sound = F.expr("exists(e, c -> c <> 0) and not exists(e, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and e is not null").where(sound)
    v = cut(v.groupBy("vec_id").agg(F.min("e").alias("e")).withColumn("asks", F.col("vec_id") % mod == 0))
    sizes = [(r.d, r.n) for r in v.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]  # one row for each number of components
    found = vectors.sparkSession.createDataFrame([], FOUND)
    for d, n in sizes:
        if n > 1:
            found = found.union(_nearest(v.where(F.size("e") == d), n, k, dtype))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
