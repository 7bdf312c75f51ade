"""RSS feeds and labelled CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T

ITEM = "struct<title:string,link:string,pubDate:string,updated:string,summary:string,description:string,content:string>"


def rss_previews(feeds: DataFrame, limit: int = 10) -> DataFrame:
    """(source, pos, title, url, published_at, text) out of (source, xml): the first ``limit``
    entries of each feed, then less those without a title or link."""
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))
    rows = feeds.select("source", F.posexplode(F.slice(items, 1, limit)).alias("pos", "item"))
    e = rows.withColumn("e", F.from_xml("item", ITEM, {"rowTag": "item"}))
    text = F.coalesce(*(F.nullif(F.col(f"e.{c}"), F.lit("")) for c in ("summary", "description", "content")), F.lit(""))
    out = e.select("source", "pos", T.normalize_title(F.col("e.title"), F.col("source")).alias("title"), F.col("e.link").alias("url"), T.rss_datetime(F.coalesce("e.pubDate", "e.updated")).alias("published_at"), T.normalize_article_text(text).alias("text"))
    return out.where("title <> '' and url <> ''")


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file's text and label columns as strings, without nulls; other files are an error."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := {"text", "label"} - set(df.columns):
        raise ValueError(f"the file lacks {sorted(missing)}")
    return df.select("text", "label").dropna()
