"""The corpus pipeline: documents to packed training sequences.

Language ID rejects documents without an identified language, the quality classifier rejects poor ones, one document of
each near-duplicate group stays, and what is left is packed. Every stage is written as Parquet and read by the next; its
files go when the next is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veritab.llm._common import remove, shared_dir, table
from veritab.llm.stages import STAGES

#: No SQL can express the classifiers; tests/llm hold the stages against brute force and labels.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
