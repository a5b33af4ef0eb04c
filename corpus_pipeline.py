"""Corpus pipeline: documents pass quality rules, near-dedup, sanitisation and mixing, and end as token ids."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddsmill.llm import bpe, mixing, pii, quality, simhash
from oddsmill.llm.common import materialise

#: Each takes (spark, docs, sf_dir); what one returns is written and reread as the next one's docs.
STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("bpe_encoding", bpe.stage),
]

#: No SQL expresses the learned rules and fingerprints; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
