"""The corpus pipeline: documents to cleaned, mixed and sharded documents.

STAGES are applied in order; each stage's result is written as Parquet to the
shared folder and read again as the next stage's documents. What a stage writes
on its way goes as soon as its result is there.

Nulls in any column, empty and very long texts, repeated rows, repeated or null
doc_ids, empty tables and extra columns of any name and type pass through every
stage: rows are numbered, the caller's columns travel as one struct, and each
stage's module says what it makes of such rows. Ties are broken by doc_id, then
by row number. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleloom.llm.common import materialize, scratch
from tripleloom.llm.decontamination import stage_decontaminate
from tripleloom.llm.mixing import stage_mix
from tripleloom.llm.sharding import stage_shard
from tripleloom.llm.simhash import stage_near_duplicates
from tripleloom.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mix),
    ("sharding", stage_shard),
]

#: The toxicity network can't be put in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
