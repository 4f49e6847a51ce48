"""The corpus pipeline: quality, toxicity, near copies, mixing, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import staged
from tessera.llm.jaccard import jaccard_stage
from tessera.llm.mixture import mixture_stage
from tessera.llm.pieces import pieces_stage
from tessera.llm.quality import quality_stage
from tessera.llm.toxicity import toxicity_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("mixture", mixture_stage),
    ("pieces", pieces_stage),
]

#: The toxicity model and the pieces are beyond SQL; the tests hold the Jaccard stage, and each operator, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
