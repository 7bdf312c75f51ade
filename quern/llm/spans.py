"""Which documents come first, and which of their repeated stretches are later ones.

Documents are ordered by doc_id (null before all), and rows that share an id by a hash of their
text.  Rows equal in both are one document.  The order of the two numbers is packed into one decimal, so that
the first of many is found by a hash aggregation with partial sums on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.store import staged

LOWEST = -(2**63)
_CHECK_BITS = 60


def order_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LOWEST).cast("long"))


def text_check(text: Column) -> Column:
    """60 bits of a hash of the text, to tell rows apart that share an id."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - _CHECK_BITS)


def place(k: str, check: str) -> Column:
    """(k, check) as one number of the same order."""
    return F.col(k).cast("decimal(20,0)") * F.lit(1 << _CHECK_BITS).cast("decimal(19,0)") + F.col(check).cast("decimal(19,0)")


def row_of(columns: list[str]) -> Column:
    """Columns that an operator passes on, in one struct: their names can't clash with its own."""
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def later_spans(spans: DataFrame) -> DataFrame:
    """Per document (k, check) where its later spans begin, from rows (a, b, k, check, loc) whose loc is
    twice the place in the document, and one more if the document has an equal span before.

    The first occurrence of each span is aggregated on the map side first.  The join back has one
    row per span on the other side; as that side is a table of its own, Spark can split partitions
    that hold a very frequent span."""
    first = spans.groupBy("a", "b").agg(F.min(place("k", "check")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = staged(first, "first")
    again = F.col("loc").bitwiseAND(F.lit(1)) == 1
    later = spans.join(first, ["a", "b"]).where(again | (place("k", "check") > F.col("first")))
    return later.groupBy("k", "check").agg(F.collect_set(F.shiftright("loc", 1)).alias("spans"))
