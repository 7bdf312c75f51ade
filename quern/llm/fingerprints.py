"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the ``k`` smallest distinct shingle hashes of a text.  The hash
of a shingle is the first 48 bits of its MD5 in hex, so that sorting strings sorts numbers and
any SQL engine can make the same sketch.  Sketches of parts merge into the sketch of the whole,
and two sketches estimate resemblance, containment and distinct shingle counts.

Defined cases: null and blank texts have the empty sketch; a text of fewer words than a shingle
has one shingle, all its words; two empty sketches resemble each other fully (1.0), an empty and
a non-empty one not at all (0.0); very long texts are sketched whole; equal hashes count once, in a text as in a merge; of
documents with equal ids the one with the smaller hash of its text comes first, and repeated rows follow each
other; an empty table gives an empty one; only doc_id and text are read, so other columns can't
clash.  Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.exprs import let, lower_ascii, words
from quern.llm.spans import LOWEST, place, text_check
from quern.llm.store import staged

K = 128
WORDS = 5
DIGITS = 12
#: Documents in a bucket of neighbouring ids, and cells that ids are cut into first.
BUCKET_ROWS, CELLS = 256, 1 << 16


def shingle_hashes(text: Column, size: int = WORDS) -> Column:
    """The hash of every run of ``size`` words, in order, repeats included."""

    def hashes(w: Column) -> Column:
        one = lambda i: F.substring(F.md5(F.concat_ws(" ", F.slice(w, i, size))), 1, DIGITS)
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, one))

    return let(words(lower_ascii(text)), hashes)


def sketch(text: Column, k: int = K, size: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, size))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets, from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both sketches hold.
    It is exact when the union has at most ``k`` shingles."""
    both = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(merged(a, b, k), both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for sketches that are not full."""
    largest = F.conv(F.element_at(a, -1), 16, 10).cast("double") + 1.0
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(16**DIGITS) / largest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that the second one holds."""
    union = distinct_count(merged(a, b, k), k)
    shared = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(a, "")


def from_text(a: Column) -> Column:
    n = F.length(a) / DIGITS
    cut = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.substr(a, i * DIGITS + 1, F.lit(DIGITS)))
    return F.when(a == "", F.array().cast("array<string>")).otherwise(cut)


def merge_parts(df: DataFrame, key: str, column: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per ``key`` out of the sketches of its parts.

    Parts are merged in two steps, first within ``salts`` groups of each key, so that neither step
    gathers more than k hashes a group in a task whatever the number of parts."""
    hashes = df.select(F.col(key).alias("key"), F.pmod(F.xxhash64(column), F.lit(salts)).alias("salt"), F.explode(column).alias("h"))
    for group in (["key", "salt"], ["key"]):
        hashes = hashes.select(*group, "h").distinct()
        place = F.row_number().over(Window.partitionBy(*group).orderBy("h"))
        hashes = hashes.withColumn("r", place).where(F.col("r") <= k).drop("r")
    return hashes.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list("h")).alias(column))


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds k and check (the order of documents) and the bucket (cell, sub) of each.

    Ids are first cut into at most CELLS cells of equal width, whose counts and bounds are a table that
    can be broadcast.  A cell of more rows than a bucket should have is cut further: between its own
    smallest and largest id, or, where few ids have many rows, each id by the hash of its text."""
    keyed = docs.withColumns({"k": F.col("doc_id").cast("long"), "check": text_check(F.col("text"))})
    lo, hi, n = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long")), F.count(F.lit(1))).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    cells = max(1, min(CELLS, -(-n // BUCKET_ROWS)))
    # null ids are a cell of their own, before all others
    cell = F.when(F.col("k").isNull(), F.lit(-1)).otherwise(F.floor((F.col("k").cast("double") - float(lo)) / F.lit((hi - lo + 1) / cells))).cast("long")
    keyed = keyed.withColumns({"cell": cell, "k": F.coalesce("k", F.lit(LOWEST).cast("long"))})
    held = staged(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("least"), F.max("k").alias("most")), "cells")
    keyed = keyed.join(F.broadcast(held), "cell")
    several = F.ceil(F.col("rows") / BUCKET_ROWS)
    wide = (F.col("most").cast("double") - F.col("least").cast("double") + 1.0).alias("wide")
    by_id = F.floor((F.col("k").cast("double") - F.col("least").cast("double")) * several / wide)
    by_text = (F.col("k") - F.col("least")) * several + F.floor(F.col("check") / F.lit(float(1 << 60)) * several)
    sub = F.when(several <= 1, F.lit(0)).when(wide * 2 >= F.col("rows"), by_id).otherwise(by_text).cast("long")
    return keyed.withColumn("sub", sub).drop("rows", "least", "most")


def _heads(keyed: DataFrame) -> DataFrame:
    """The first document (k, check) of each bucket, and the bucket before it (of the very first one, the last).

    Buckets follow each other within their cell; only cells, at most CELLS, are put in order as a whole."""
    head = keyed.groupBy("cell", "sub").agg(F.min(place("k", "check")).alias("p"))
    head = staged(head, "heads")
    cells = head.groupBy("cell").agg(F.max("sub").alias("last"))
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(F.struct("cell", "last")).over(Window.orderBy("cell")), F.last(F.struct("cell", "last")).over(whole))
    cells = cells.select("cell", before.alias("other"))
    inner = F.lag("sub").over(Window.partitionBy("cell").orderBy("sub"))
    out = head.withColumn("inner", inner).join(F.broadcast(cells), "cell")
    return out.select("p", F.when(F.col("inner").isNull(), F.col("other.cell")).otherwise(F.col("cell")).alias("before_cell"), F.coalesce("inner", "other.last").alias("before_sub"))


def with_next(docs: DataFrame, columns: dict[str, Column], derived) -> DataFrame:
    """Adds to each document (doc_id, text) what its successor in ascending doc_id holds; the last one's
    successor is the first.  ``columns`` are taken from the successor as ``next_<name>``;
    ``derived(df)`` may then add columns and name those wanted of the successor as well.

    Each window holds one bucket of about BUCKET_ROWS documents of neighbouring ids; the first document
    of a bucket is sent to the bucket before it as well.  Null ids stand before all others; equal ids
    follow each other by a hash of their texts."""
    keyed = _numbered(docs)
    heads = staged(_heads(keyed), "before")
    # a row per bucket: Spark broadcasts it if it is small
    sent = keyed.withColumn("p", place("k", "check")).join(heads, "p", "left")
    own = F.struct(F.col("cell").alias("cell"), F.col("sub").alias("sub"), F.lit(0).alias("copy"))
    guest = F.struct(F.col("before_cell").alias("cell"), F.col("before_sub").alias("sub"), F.lit(1).alias("copy"))
    sent = sent.select("doc_id", "text", "k", "check", F.explode(F.when(F.col("before_cell").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("to"))
    sent = sent.select("doc_id", "text", "k", "check", "to.*")
    order = Window.partitionBy("cell", "sub").orderBy("copy", "k", "check")
    out = sent.withColumns({f"next_{c}": F.lead(v).over(order) for c, v in columns.items()})
    out, more = derived(out)
    out = out.withColumns({f"next_{c}": F.lead(c).over(order) for c in more})
    return out.where(F.col("copy") == 0)


def edited_fingerprints(docs: DataFrame, k: int = K, size: int = WORDS) -> DataFrame:
    """Fingerprints of each whole text and of its edited text: the last half of its code points
    replaced by as many of the next document's first ones."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def derived(df: DataFrame):
        n = F.length("text")
        half = F.floor(n / 2).cast("int")
        edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
        kept = ["doc_id", "cell", "sub", "k", "check", "copy"]
        df = df.select(*kept, n.cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text"), k, size).alias("sketch"))
        df = df.select(*kept, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), k, size).alias("edited_sketch"))
        return df, ["sketch"]

    out = with_next(docs, {"text": F.col("text")}, derived)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
