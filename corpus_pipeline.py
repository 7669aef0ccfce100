"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing, in this order.

Each stage works on what the one before kept. Between stages run() stores the documents in the shared
folder, so that a stage that reads its input twice doesn't redo those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import stages
from quillon.llm.common import materialize, table
from quillon.plans.ship import ship

STAGES = [
    ("quality classifier", stages.drop_low_quality),
    ("near-duplicates", stages.drop_near_duplicates),
    ("benchmark decontamination", stages.drop_contaminated),
    ("secret scans", stages.redact_secrets),
    ("best-fit packing", stages.pack),
]

#: SQL can't express the language model, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i:
            docs = materialize(spark, docs, f"stage{i}")
        docs = stage(spark, docs, sf_dir)
    return docs
