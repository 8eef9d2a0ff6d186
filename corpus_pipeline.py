"""A corpus pipeline of five stages; each stage's rows are written and read again for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keyframe.llm.common import prepare, table
from keyframe.llm.op1_ngram_jaccard import keep_one
from keyframe.llm.op2_suffix_dedup import drop_repeats
from keyframe.llm.op4_quality import keep_good
from keyframe.llm.op6_mixing import mixed
from keyframe.llm.op8_packing import packed

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("repeats", drop_repeats), ("mixing", mixed), ("packing", packed)]
#: Gumbel sampling, suffix merging, budgets and byte-level BPE have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what lies between them is written under the checkpoint folder."""
    prepare(spark)
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{top}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
