"""Connected components by local contraction and alternating star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release
from .signature_tree import Links

#: Edges that one task contracts.
LOCAL = 1_000_000


def _contract(batches):
    """Edges of one task -> each of its nodes with the smallest node that it reaches in them."""
    import pyarrow as pa

    links, nodes = Links(), set()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            nodes.add(u)
            nodes.add(v)
            links.join(u, v)
    out = [(u, r) for u in nodes if (r := links.find(u)) != u]
    for i in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[i : i + 50_000], strict=True)], names=["u", "v"])


def _large(e: DataFrame) -> DataFrame:
    s = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = s.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return s.join(m, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    t = e.join(m, "u")
    return t.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node reached.

    Tasks of at most LOCAL edges contract what they hold to stars.  As long as
    there is more than one, star steps, which are shuffles over what is left,
    bring the stars of different tasks together, and the round begins anew.  Hubs are
    joined by a sort-merge join that Spark may split.  No edge or label reaches the driver.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        tasks = max(1, -(-e.count() // LOCAL))
        dealt = e.coalesce(tasks) if tasks <= e.rdd.getNumPartitions() else e.repartition(tasks)
        e = cut(dealt.mapInArrow(_contract, "u long, v long"))
        if tasks == 1:
            break
        e = cut(_small(_large(e)))
        n, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
        # stars: each node points at one other, which points nowhere
        if n == nodes and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        release(e.sparkSession)
    release(e.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
