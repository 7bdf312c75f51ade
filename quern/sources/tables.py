"""The engine's own tables: as Parquet snapshots, or in a relational store over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "sources": "id bigint, name string, url string, rss_url string, source_type string, is_active boolean",
    "news": "id bigint, source_id bigint, cluster_id bigint, title string, text string, url string, published_at timestamp, collected_at timestamp, embedding array<double>, is_primary boolean",
    "clusters": "id bigint, summary_text string, tags string, cluster_size int, status string, created_at timestamp, updated_at timestamp, embedding array<double>, title string",
    "posts": "id bigint, cluster_id bigint, post_text string, published_at timestamp, status string, max_message_id string",
}


def create(spark: SparkSession, database: str = "default") -> None:
    """Tables that aren't there yet, empty."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")


def scan(spark: SparkSession, name: str, folder: str | None = None, jdbc: dict[str, str] | None = None, key: str = "id", parts: int = 64) -> DataFrame:
    """A table in full: of ``folder`` (Parquet), of a store (``jdbc`` options; cut into ``parts`` by
    ranges of ``key``, so that executors read side by side) or else of the catalog."""
    if folder is not None:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    if jdbc is None:
        return spark.table(name)
    read = spark.read.format("jdbc").options(**jdbc)
    lo, hi = read.option("query", f"SELECT min({key}) AS lo, max({key}) AS hi FROM {name}").load().first()
    read = spark.read.format("jdbc").options(**jdbc).option("dbtable", name)
    if lo is not None:
        read = read.option("partitionColumn", key).option("lowerBound", lo).option("upperBound", hi + 1).option("numPartitions", parts)
    return read.load()


def active(sources: DataFrame) -> DataFrame:
    return sources.where("is_active")


def with_url(news: DataFrame, url: str | None) -> DataFrame:
    """The rows of one URL; none for an empty one."""
    return news.where(F.lit(bool(url)) & (F.col("url") == F.lit(url)))
