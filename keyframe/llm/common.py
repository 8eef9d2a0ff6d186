"""Shared pieces: table access, lineage cuts, vectorised hashing of text batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Fraction that holds a document out of training, as the contracts fix it.
HELD_OUT_MOD, HELD_OUT_REMAINDER = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Set a checkpoint folder only where the cluster names none (tests, local runs)."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def boxed(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, `row`, so that names which a stage adds meet none of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def written(df: DataFrame) -> DataFrame:
    """The same as a compressed table, of which later steps read only the columns that they need."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of steps that nothing refers to any more.

    It does so when the driver's JVM collects their handles, which in a loop of
    many small steps may be long after they are done.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give a Python worker's freed memory back to the machine; workers are reused by later tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """run (batches -> batches), which gives its memory back at its end."""

    def inner(batches):
        yield from run(batches)
        trim()

    return inner


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the bytes of df, for the number of tasks; 0 if it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves the held-out remainder."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_MOD)) == HELD_OUT_REMAINDER, F.lit(False))


#: Ids that follow each other are dealt to groups in blocks, so that a batch has rows for few groups.
ID_BLOCK = 512
#: Blocks of too many bytes that are broadcast; more are joined by a shuffle.
HOT_BLOCKS = 100_000


class Groups:
    """Deals documents into groups of about group_bytes of text, by id and text hash.

    A block of ids whose rows hold more than twice that, for the length or the number of its
    rows, is spread over several groups by text; so are the rows without id.  Where there is
    little text, groups are smaller, down to LEAST, so that there is one for each partition.
    """

    LEAST = 1 << 20

    def __init__(self, rows: DataFrame, group_bytes: int, id_block: int) -> None:
        """rows (doc_id, bytes)"""
        self.id_block = id_block
        sums = rows.groupBy(self._block(F.col("doc_id")).alias("block")).agg(F.sum("bytes").alias("bytes"))
        sums = cut(sums)
        total = sums.agg(F.sum("bytes")).first()[0] or 0
        self.groups = max(1, -(-total // group_bytes), min(parts(rows.sparkSession), -(-total // min(self.LEAST, group_bytes))))
        self.hot = sums.where(F.col("block").isNotNull() & (F.col("bytes") > 2 * group_bytes)).select(F.col("block").alias("_block"), F.ceil(F.col("bytes") / group_bytes).alias("_spread"))
        self.n_hot = self.hot.count()

    def _block(self, doc_id: Column) -> Column:
        return F.floor(doc_id / self.id_block)

    def deal(self, rows: DataFrame, text_hash: Column) -> DataFrame:
        """rows with doc_id -> the same with their group, g."""
        block = self._block(F.col("doc_id"))
        spread = F.lit(None).cast("long")
        if self.n_hot:
            hot = F.broadcast(self.hot) if self.n_hot <= HOT_BLOCKS else self.hot
            rows = rows.join(hot, block == F.col("_block"), "left")
            spread = F.col("_spread")
        salt = F.when(F.col("doc_id").isNull(), text_hash).when(spread.isNotNull(), F.pmod(text_hash, spread)).otherwise(F.lit(0))
        return rows.withColumn("g", F.pmod(F.xxhash64(block, salt), F.lit(self.groups)).cast("int")).drop("_block", "_spread")


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker (functions are shipped by value)."""
    return sys.__dict__.setdefault("_keyframe_llm_cache", {})


# --------------------------------------------------------------------------- text batches


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and its int64 offsets; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, limit: int = 1 << 20):
    """Row ranges (lo, hi) of at most `limit` bytes, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random odd uint64 multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes other than 0x20 and 0x09-0x0D, never across rows."""
    sep = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~sep
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    start = word.copy()
    start[1:] &= sep[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= sep[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Multilinear 64-bit hash of each span of small integers (bytes or code points)."""
    lens = ends - starts
    if not len(starts):
        return np.zeros(0, U64)
    at = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    taken = values[pos + np.repeat(starts, lens)]
    if taken.dtype == np.uint8:
        taken = stream(seed + 1, 256)[taken]
    else:
        taken = mix(taken.astype(U64) + U64(seed + 1))
    taken = taken * stream(seed + 2, int(lens.max()))[pos]
    return mix(np.add.reduceat(taken, at) + lens.astype(U64) * U64(0x9E3779B97F4A7C15))


def shingle_hashes(data: np.ndarray, offs: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (lower-cased A-Z) in text order, and int64 offsets by row.

    A row with 1 to k-1 words has its whole sequence as one shingle; a row without words has none.
    """
    starts, ends = word_spans(data, offs)
    wh = span_hashes(lower_table()[data], starts, ends, seed)
    at = np.searchsorted(starts, offs)  # word offsets by row
    m = np.diff(at)
    c = stream(seed + 3, k)
    n = len(wh)
    if n >= k:
        s = wh[: n - k + 1] * c[0]
        for j in range(1, k):
            s = s + wh[j : n - k + 1 + j] * c[j]
        s = mix(s)
    else:
        s = np.zeros(0, U64)
    count = np.where(m >= k, m - k + 1, (m > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(out_at[-1]), U64)
    full = np.flatnonzero(m >= k)
    if len(full):
        cnt = count[full]
        base = np.cumsum(cnt) - cnt
        rel = np.arange(int(cnt.sum())) - np.repeat(base, cnt)
        out[rel + np.repeat(out_at[full], cnt)] = s[rel + np.repeat(at[full], cnt)]
    for r in np.flatnonzero((m > 0) & (m < k)):
        w = wh[at[r] : at[r + 1]]
        out[out_at[r]] = mix(np.array([(w * c[: len(w)]).sum(dtype=U64) + U64(len(w))], U64))[0]
    return out, out_at


def crc(text: str) -> int:
    return zlib.crc32(text.encode())
