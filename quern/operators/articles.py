"""Filtering, deduplication and storing of collected articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.text import contains_any, let

MIN_CHARS = 250


def folded(c: Column) -> Column:
    return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е"))


def is_valid(titles: Sequence[str] = fixed.BAD_TITLES, urls: Sequence[str] = fixed.BAD_PAGE_URLS, content: Sequence[str] = fixed.BAD_CONTENT, least: int = MIN_CHARS) -> Column:
    """Title and url given, no bad needle in title, url or text, and a text of ``least`` characters."""
    given = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    named = lambda c, needles: let(folded(F.col(c)), lambda t: contains_any(t, needles))
    bad = named("title", titles) | named("url", urls) | named("text", content)
    return given & (F.length(F.coalesce("text", F.lit(""))) >= least) & ~bad


def filter_report(articles: DataFrame, valid: Column, by: str = "source") -> DataFrame:
    return articles.groupBy(by).agg(F.count(F.lit(1)).alias("collected"), F.count_if(valid).alias("kept"), F.count_if(~valid).alias("removed"))


def removed(articles: DataFrame, valid: Column) -> DataFrame:
    return articles.where(~valid)


def first_wins(rows: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.  Each task keeps its own first before the shuffle
    (the rank filter is pushed below it), so hot keys move one row per task."""
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def unknown(articles: DataFrame, news: DataFrame) -> DataFrame:
    """Articles whose URL isn't stored; those without a URL count as unknown."""
    return articles.join(news.select("url").where("url <> ''").distinct(), "url", "left_anti")


def to_store(articles: DataFrame, news: DataFrame, sources: DataFrame) -> DataFrame:
    """New rows of news: the first article of each URL not yet stored, from a known source."""
    first = first_wins(articles, F.col("url"), [F.col("ord")])
    known = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return unknown(first, news).join(known, "source").withColumns({"cluster_id": F.lit(None).cast("long"), "is_primary": F.lit(False)})


def upserted(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """``old`` with the rows of ``new``: matched rows are overwritten, others added (a snapshot to
    write in place of the old one)."""
    others = [c for c in old.columns if c != key]
    o, n = old.withColumn("_o", F.lit(1)).alias("o"), new.withColumn("_n", F.lit(1)).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    pick = lambda c: F.when(F.col("n._n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c)
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(pick(c) for c in others))
