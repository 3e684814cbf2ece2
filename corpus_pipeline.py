"""A training corpus from ``documents``: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed pieces. A stage
works on all rows that its predecessor kept, read back from the Parquet table they were written to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import mixing, packing, pii, quality, simhash
from gleaner.sources.shared import written

STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: Fingerprints, learned classifiers and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
