"""The periodic run as a stream: each micro-batch of articles is filtered, made unique against what
is stored and appended.  Batches never overlap, and a batch that is run again stores nothing twice,
since known URLs are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.articles import first_wins, is_valid, unknown


def stored(spark: SparkSession, table: str) -> bool:
    """Whether a batch was stored already: a table that is there but can't be read is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and any(s.getPath().getName().startswith("part-") for s in fs.listStatus(at))


def ingest(articles: DataFrame, table: str, checkpoint: str, valid: Column | None = None, every: str | None = "30 minutes") -> StreamingQuery:
    """``articles``: a stream with title, url, text and ord.  With ``every`` None it takes what
    there is and ends."""
    ok = is_valid() if valid is None else valid

    def store(batch: DataFrame, _: int) -> None:
        new = first_wins(batch.where(ok), F.col("url"), [F.col("ord")])
        if stored(batch.sparkSession, table):
            new = unknown(new, batch.sparkSession.read.parquet(table))
        new.write.mode("append").parquet(table)

    out = articles.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def late(articles: DataFrame, as_of, hours: int = 6) -> DataFrame:
    """How many articles of a batch, per source, came too late for the window that ends at ``as_of``."""
    out = F.col("collected_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    return articles.groupBy("source").agg(F.sum(out.cast("long")).alias("skipped_late"))


def unique_recent(articles: DataFrame, hours: int = 6) -> DataFrame:
    """A stream's articles once per URL within the window; later ones than it are dropped."""
    return articles.withWatermark("collected_at", f"{hours} hours").dropDuplicatesWithinWatermark(["url"])
