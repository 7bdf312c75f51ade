"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregation by node and a join back to it, so no neighbourhood is ever gathered
in one place; after each round the edges are written to the shared folder and the round before
is deleted.  At the end every node but a root has one edge, to the smallest node it reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import new_path, remove


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that isn't the smallest of its component; edges: (u, v)."""
    spark = edges.sparkSession
    kept, state = None, None
    e = edges.select("u", "v").where("u <> v")
    while True:
        path = new_path(spark, "stars")
        _small(_large(e) if kept else e).write.parquet(path)
        e = spark.read.schema("u long, v long").parquet(path)
        found = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.max("u")).first())
        if kept:
            remove(spark, kept)
        kept = path
        if found == state or found[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = found
