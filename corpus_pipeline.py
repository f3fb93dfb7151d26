"""The corpus pipeline: stages over `documents`, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sagelode.llm.byte_bpe import bpe_stage
from sagelode.llm.common import shared_dir
from sagelode.llm.decontaminate import decontamination_stage
from sagelode.llm.line_dedup import line_stage
from sagelode.llm.minhash_dedup import minhash_stage
from sagelode.llm.quality_rules import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", minhash_stage),
    ("decontaminate", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: Connected groups of fuzzy links can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
