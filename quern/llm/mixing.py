"""Mixing sources to target weights by systematic sampling.

Sources, by code point with null last, weigh 3, 1, 2, 3, 1, 2 and so on.  They share ``share``
(150 %) of all words by weight; a target stops at twice its source's words and the excess is
shared again by weight.  Within a source each document expects target / source_size copies.
Prefix-summing the expected copies and adding the source's random offset, a document is emitted
once per integer boundary that its interval crosses.

The order of the prefix sum is (bucket, size, doc_id): sorting by size spreads short and long
documents evenly over the draws, so that taken words come near the target, and buckets (hash of
the id; about BUCKET_ROWS documents each) cut a large source so that no task holds all of it.
The offset is a hash of the seed and the source's name: reruns agree.  Only DataFrame functions.

Sources are dealt over tasks by their rows (counts, then windows of a bucket each); the table of
targets has one row per source, and Spark broadcasts it only if it is small.

Defined cases: null and blank texts have size 0 and can still be taken, which takes no words;
a source of size 0 has target 0; rows without an id are dealt over the buckets by their text; repeated rows and
ties in size take their places one after the other; very long texts count whole; an empty table gives an
empty one; columns whose names clash with those added (size, source_size, target, copies) are
replaced by ``mixed`` and kept by ``emitted``, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.exprs import n_words
from quern.llm.spans import row_of
from quern.llm.store import staged

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BUCKET_ROWS = 2048
SEED = "mix"
UNIT = float(1 << 32)


def _hash(text: Column) -> Column:
    """32 bits of the MD5, as a number that any SQL engine can make."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = SHARE) -> DataFrame:
    """Rows (source, source_size, n, target) out of (source, source_size, n).

    The resharing has a closed form: sources reach their ceiling in the order of ceiling per
    weight, so a source is capped if the rest of the words, were it shared among those not yet
    passed, would exceed its ceiling.  The order of all sources is needed here, so these one-row-a-source
    tables meet in one task; it holds names and four numbers each, no texts."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    df = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * MOST)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    rest = F.sum("source_size").over(every) * share - before("cap")
    df = df.withColumns({"rest": rest, "weights": F.sum("w").over(every) - before("w")})
    df = df.withColumn("capped", F.col("cap") * F.col("weights") <= F.col("rest") * F.col("w"))
    free = lambda c: F.max(F.when(~F.col("capped"), F.col(c))).over(every)
    level = F.col("w") * free("rest") / free("weights")
    return df.select("source", "source_size", "n", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def mixed(docs: DataFrame, share: float = SHARE, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents with size, source_size, target and copies (0, 1 or 2 each)."""
    added = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c not in added]
    name = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))  # never null, to join on
    identity = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).otherwise(""))
    held = [F.col(f"`{c}`").alias(f"held_{i}") for i, c in enumerate(kept)]  # plain columns, so that those not asked for are pruned
    sized = docs.select(*held, "doc_id", name.alias("s"), n_words(F.col("text")).alias("size"), _hash(identity).alias("h"))
    sizes = sized.groupBy("s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("source", F.when(F.col("s") != "n", F.substring("s", 2, 1 << 30)))
    plan = targets(sizes, share).withColumn("buckets", F.ceil(F.col("n") / bucket_rows))
    plan = plan.withColumn("s", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")))
    plan = staged(plan.select("s", "source", "source_size", "target", "buckets"), "targets")
    bucket = F.pmod(F.col("h"), F.col("buckets"))
    counts = sized.select("s", "h").join(plan, "s").groupBy("s", bucket.alias("b")).agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("s", "b", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("ahead"))
    out = sized.join(plan, "s").withColumn("b", bucket).join(ahead, ["s", "b"])
    at = F.col("ahead") + F.row_number().over(Window.partitionBy("s", "b").orderBy("size", F.col("doc_id").asc_nulls_first()))
    offset = _hash(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("\x00")))) / F.lit(UNIT)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = out.withColumns({"i": at, "u": offset, "c": each})
    crossed = F.floor(F.col("u") + F.col("i") * F.col("c")) - F.floor(F.col("u") + (F.col("i") - 1) * F.col("c"))
    columns = [F.col(f"held_{i}").alias(c) for i, c in enumerate(kept)]
    return out.select(*columns, "size", "source_size", "target", F.least(crossed, F.lit(MOST)).cast("int").alias("copies"))


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it was drawn, with the columns it came with."""
    held = docs.select(row_of(docs.columns).alias("row"), "doc_id", "source", "text")
    out = mixed(held, **how).where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("again"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
