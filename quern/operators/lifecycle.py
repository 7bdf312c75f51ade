"""States of clusters: what is due at each step, posts, clean-up and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.text import hashtags
from quern.operators.clusters import ranked_members


def to_summarize(clusters: DataFrame) -> DataFrame:
    return clusters.where("summary_text is null")


def to_tag(clusters: DataFrame, again: bool = False) -> DataFrame:
    """Clusters with a summary (an empty one counts) that have no tags or were rejected; with
    ``again`` all with a summary."""
    due = clusters.where("summary_text is not null")
    return due if again else due.where("tags is null or status = 'not_for_publication'")


def ready(clusters: DataFrame, limit: int = 30) -> DataFrame:
    return clusters.where("status = 'ready' and summary_text is not null").orderBy("created_at", "cluster_id").limit(limit)


def posts(clusters: DataFrame, news: DataFrame) -> DataFrame:
    """(cluster_id, post_title, body) of each cluster: summary, source link, hashtags."""
    first = ranked_members(news, most=1).select("cluster_id", F.col("url").alias("_url"))
    tail = lambda c, mark: F.when(c != "", F.concat(F.lit("\n\n" + mark), c)).otherwise("")
    tags = hashtags(F.col("tags"))
    body = F.concat(F.coalesce("summary_text", F.lit("")), tail(F.coalesce("_url", F.lit("")), fixed.SOURCE_LABEL), tail(tags, ""))
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit(fixed.DEFAULT_TITLE))
    return clusters.join(first, "cluster_id", "left").select("cluster_id", title.alias("post_title"), F.btrim(body, F.lit(" \n\t\r")).alias("body"))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped_posts(clusters: DataFrame, news: DataFrame) -> DataFrame:
    """(cluster_id, post): title in bold and body as one HTML-escaped text."""
    p = posts(clusters, news)
    parts = F.concat(F.lit("<b>"), html_escaped(F.col("post_title")), F.lit("</b>\n\n"), html_escaped(F.col("body")))
    return p.select("cluster_id", F.btrim(parts, F.lit(" \n\t\r")).alias("post"))


def delivered(due: DataFrame, send: Callable[[str, str], None]) -> DataFrame:
    """(cluster_id, error) of every post after ``send(title, body)``, which workers call; a post that
    fails holds its error and stops no other.  Write the result before use: reading it twice
    sends twice.  ``published(clusters, delivered.where("error is null"))`` is the next snapshot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for title, body in zip(pdf["post_title"], pdf["body"], strict=True):
                try:
                    send(title, body)
                    errors.append(None)
                except Exception as e:  # the sender is the caller's: whatever it raises is that post's result
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"cluster_id": pdf["cluster_id"], "error": pd.Series(errors, dtype=object)})

    kind = dict(due.dtypes)["cluster_id"]
    return due.select("cluster_id", "post_title", "body").mapInPandas(run, f"cluster_id {kind}, error string")


def published(clusters: DataFrame, sent: DataFrame) -> DataFrame:
    """The snapshot after sending: clusters that were sent change state, the others stay."""
    done = sent.select("cluster_id", F.lit(True).alias("_sent")).distinct()
    return clusters.join(done, "cluster_id", "left").withColumn("status", F.when(F.col("_sent"), "published").otherwise(F.col("status"))).drop("_sent")


def victims(clusters: DataFrame, as_of, hours: int = 48) -> DataFrame:
    return clusters.where((F.col("status") == "not_for_publication") & (F.col("updated_at") < F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))))


def cleaned(clusters: DataFrame, news: DataFrame, as_of, hours: int = 48) -> tuple[DataFrame, DataFrame]:
    """Both tables without old rejected clusters and their members."""
    gone = victims(clusters, as_of, hours).select("cluster_id")
    return clusters.join(gone, "cluster_id", "left_anti"), news.join(gone, "cluster_id", "left_anti")


def cleanup_report(clusters: DataFrame, news: DataFrame, as_of, hours: int = 48) -> DataFrame:
    gone = victims(clusters, as_of, hours)
    return gone.join(sizes(news), "cluster_id", "left").agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("members"), F.lit(0)).alias("news"))


def sizes(news: DataFrame) -> DataFrame:
    return news.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))


def newest(clusters: DataFrame, limit: int = 20) -> DataFrame:
    """The last clusters by time of founding, oldest of them first."""
    return clusters.orderBy(F.desc("created_at"), F.desc("cluster_id")).limit(limit).orderBy("created_at", "cluster_id")


def latest(clusters: DataFrame, news: DataFrame, limit: int = 20) -> DataFrame:
    """The last clusters by id, with their sizes, 0 for those without members."""
    return clusters.orderBy(F.desc("cluster_id")).limit(limit).join(sizes(news), "cluster_id", "left").withColumn("members", F.coalesce("members", F.lit(0)))
