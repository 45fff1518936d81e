"""The corpus pipeline: each stage reads what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.session import scratch_path
from lexiloom.llm import stages

STAGES = [
    ("toxicity", stages.toxicity),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("mixing_sources", stages.mixing_sources),
    ("token_output", stages.token_output),
]
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
# Tokenizing and a learned score are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # whole texts go to Python: smaller batches than the default of 10,000 rows, for the stages only
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(int(before), BATCH_ROWS)) if int(before) > 0 else str(BATCH_ROWS))
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
