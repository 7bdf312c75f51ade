"""Where lineage is cut, and the input table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.plans.shared import new_path, remove, shared_dir, staged

__all__ = ["documents", "new_path", "remove", "shared_dir", "staged"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
