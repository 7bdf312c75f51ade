"""The fixture tables seen as the engine's own: news, clusters, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: titles are first sentences, five neighbours make a cluster."""
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + F.col("doc_id") * 60)
    return d.select(
        F.col("doc_id").alias("id"), "source", "lang", F.btrim(F.split_part("text", F.lit("."), F.lit(1))).alias("title"), "text",
        F.concat(F.lit("https://www."), "source", F.lit(".example/"), "lang", F.lit("/news/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("url"),
        F.when(F.col("doc_id") % 3 != 0, at).alias("published_at"), at.alias("collected_at"), F.floor(F.col("doc_id") / 5).alias("cluster_id"), (F.col("doc_id") % 5 == 2).alias("is_primary"),
    )


NEWS_SQL = f"""news AS (SELECT doc_id AS id, source, lang, trim(split_part(text, '.', 1)) AS title, text,
  'https://www.' || source || '.example/' || lang || '/news/' || doc_id || '.html' AS url,
  CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '{EPOCH}' + to_minutes(doc_id) END AS published_at, TIMESTAMP '{EPOCH}' + to_minutes(doc_id) AS collected_at,
  doc_id // 5 AS cluster_id, doc_id % 5 = 2 AS is_primary FROM documents)"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster per five articles, with a state by a fixed rule."""
    n = news(spark, sf_dir)
    c = n.groupBy("cluster_id").agg(F.min("collected_at").alias("created_at"), F.max("collected_at").alias("updated_at"), F.min_by("title", "id").alias("title"), F.count(F.lit(1)).alias("cluster_size"))
    k = F.col("cluster_id") % 4
    return c.withColumns({"status": F.when(k == 0, "new").when(k == 1, "ready").when(k == 2, "not_for_publication").otherwise("published"), "summary_text": F.when(k != 0, F.concat(F.lit("About "), "title")), "tags": F.when(k.isin(1, 3), F.lit("heavy industry, up-stream"))})


CLUSTERS_SQL = """clusters AS (SELECT *, CASE cluster_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'ready' WHEN 2 THEN 'not_for_publication' ELSE 'published' END AS status,
  CASE WHEN cluster_id % 4 <> 0 THEN 'About ' || title END AS summary_text, CASE WHEN cluster_id % 4 IN (1, 3) THEN 'heavy industry, up-stream' END AS tags
  FROM (SELECT cluster_id, min(collected_at) AS created_at, max(collected_at) AS updated_at, arg_min(title, id) AS title, count(*) AS cluster_size FROM news GROUP BY cluster_id))"""
