"""Line dedup by winnowing over line hashes.

A window is the shortest run of lines with ``window`` characters (code points, outer blanks aside; blank lines
count none), and its line with the smallest hash (the last of equal ones) is a guaranteed fingerprint:
two equal runs of that many characters share at least one, and a line that long is always one.

Each fingerprint's positions are joined to the position of its first occurrence, and the match is
extended line by line both ways, up to and with the next fingerprint on either side, whose own match goes on
from there.  Lines of a document in such matches are repeated; stretches of them with at least
``window`` characters are deleted.  Every deleted line equals one that stands earlier in the corpus, and the
first of equal lines always stays.

First is the smallest doc_id (null before all), then the text with the smaller hash where rows
share an id, then the position.  Only DataFrame functions are used.

Defined cases: null texts stay null; texts with fewer characters than a window stay whole; blank lines
go only inside a stretch; very long texts are whole; rows equal in id and text are one document
and stay alike; an empty table gives an empty one; columns whose names clash with those added (n_lines,
n_removed) are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.exprs import SPACE, exploded, let
from quern.llm.spans import order_key, place, row_of, text_check
from quern.llm.store import staged

WINDOW = 32
DIGITS = 15  # hex digits, 60 bits


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def solid(line: Column) -> Column:
    """Characters of a line, blanks at its ends aside."""
    return F.length(F.btrim(line, F.lit(SPACE)))


def _hashed(line: Column, at: Column) -> Column:
    """Two numbers of 60 bits out of the line's MD5, its characters and its position."""
    half = lambda m, i: F.conv(F.substring(m, i, DIGITS), 16, 10).cast("long")
    return let(F.md5(line.cast("binary")), lambda m: F.struct(half(m, 1).alias("a"), half(m, 1 + DIGITS).alias("b"), solid(line).alias("size"), at.alias("at")))


def _winnowed(lines: Column, window: int) -> Column:
    """Positions of the window minima, of hashed lines that aren't blank."""

    def window_of(i: Column) -> Column:
        grown = lambda acc, x: F.when(acc["c"] >= window, acc).otherwise(F.struct((acc["c"] + x["size"]).alias("c"), (acc["n"] + 1).alias("n")))
        # lines of a character each at least, so a window has no more lines than characters
        n = F.aggregate(F.slice(lines, i + 1, window), F.struct(F.lit(0).alias("c"), F.lit(0).alias("n")), grown, lambda acc: F.when(acc["c"] >= window, acc["n"]).otherwise(0))
        return F.when(F.get(lines, i)["size"] >= window, 1).otherwise(n)

    def minimum(i: Column) -> Column:
        ranked = lambda n: F.array_min(F.transform(F.slice(lines, i + 1, n), lambda x: F.struct(x["a"].alias("a"), (-x["at"]).alias("at"))))
        return let(window_of(i), lambda n: F.when(n > 0, -ranked(n)["at"]))

    every = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), minimum)
    none = F.array().cast("array<int>")
    return F.when(F.size(lines) == 0, none).otherwise(F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull()))))


def fingerprints(text: Column, window: int = WINDOW) -> Column:
    """Array of (a, b, at, before, after, again): the hashes and positions of a text's fingerprints, the hashes
    of the lines from each to the next fingerprint on either side, nearest first, and whether an
    equal fingerprint stands earlier in the text."""

    def rows(h: Column, s: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            lo = F.when(i == 0, 0).otherwise(F.get(s, i - 1))
            hi = F.when(i == F.size(s) - 1, F.size(h) - 1).otherwise(F.get(s, i + 1))
            before = F.transform(F.reverse(F.slice(h, lo + 1, p - lo)), lambda x: x["a"])
            after = F.transform(F.slice(h, p + 2, hi - p), lambda x: x["a"])
            return F.struct(F.get(h, p)["a"].alias("a"), F.get(h, p)["b"].alias("b"), p.alias("at"), before.alias("before"), after.alias("after"))

        return let(F.sort_array(F.transform(s, one)), marked)

    def marked(r: Column) -> Column:
        again = lambda x, i: F.coalesce((i > 0) & (F.get(r, i - 1)["a"] == x["a"]) & (F.get(r, i - 1)["b"] == x["b"]), F.lit(False))
        return F.transform(r, lambda x, i: F.struct(*[x[c].alias(c) for c in ("a", "b", "at", "before", "after")], again(x, i).alias("again")))

    winnowed = lambda h: let(_winnowed(F.filter(h, lambda x: x["size"] > 0), window), lambda s: rows(h, s))
    return let(F.transform(lines_of(F.coalesce(text, F.lit(""))), _hashed), winnowed)


def matches(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document (k, check) the bounds (lo, hi) of its lines that match earlier ones."""
    prints = docs.select(order_key(F.col("doc_id")).alias("k"), text_check(F.col("text")).alias("check"), fingerprints(F.col("text"), window).alias("r"))
    prints = staged(exploded(prints, "r", "r").select("k", "check", "r.*"), "fingerprints")
    first = prints.groupBy("a", "b").agg(F.min(place("k", "check")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = staged(prints.join(staged(first, "first"), ["a", "b"]).withColumn("earliest", ~F.col("again") & (place("k", "check") == F.col("first"))), "hits")
    # a table of its own, one row per fingerprint: Spark can split partitions that hold a very frequent one
    source = hits.where("earliest").select("a", "b", F.col("before").alias("before0"), F.col("after").alias("after0")).dropDuplicates(["a", "b"])
    both = hits.where("not earliest").join(staged(source, "sources"), ["a", "b"])

    def equal(one: str, two: str) -> Column:
        """How many of the nearest lines are equal; the shorter side is filled up with nulls."""
        same = F.zip_with(one, two, lambda x, y: x.eqNullSafe(y))
        at = F.array_position(same, False).cast("int")
        return F.when(at == 0, F.size(same)).otherwise(at - 1)

    bounds = both.select("k", "check", F.struct((F.col("at") - equal("before", "before0")).alias("lo"), (F.col("at") + equal("after", "after0")).alias("hi")).alias("m"))
    return bounds.groupBy("k", "check").agg(F.collect_set("m").alias("m"))


def stretches(found: Column, sizes: Column, window: int) -> Column:
    """Bounds (lo, hi) of the stretches of matched lines that have ``window`` characters, in order."""

    def of(g: Column) -> Column:
        starts = F.filter(g, lambda x, i: (i == 0) | (F.get(g, i - 1) != x - 1))
        ends = F.filter(g, lambda x, i: (i == F.size(g) - 1) | (F.get(g, i + 1) != x + 1))
        return F.zip_with(starts, ends, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))

    positions = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: F.sequence(x["lo"], x["hi"])))))
    long = lambda x: F.aggregate(F.slice(sizes, x["lo"] + 1, x["hi"] - x["lo"] + 1), F.lit(0), lambda c, z: c + z) >= window
    return F.filter(let(positions, of), long)


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with ``text`` less its later repeated lines, n_lines and n_removed."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(row_of(kept).alias("row"), order_key(F.col("doc_id")).alias("k"), text_check(F.col("text")).alias("check"))
    both = keyed.join(matches(docs.select("doc_id", "text"), window), ["k", "check"], "left").select("row", "m")
    both = both.withColumn("lines", lines_of(F.col("row.text")))
    gone = let(F.transform("lines", solid), lambda sizes: stretches(F.col("m"), sizes, window))
    both = both.withColumn("gone", F.when(F.col("m").isNotNull(), gone))

    def piece(x: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get("gone", i - 1)["hi"] + 1)
        return F.slice("lines", begin + 1, x["lo"] - begin)

    n = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    end = F.array(F.struct(F.size("lines").alias("lo"), F.size("lines").alias("hi")))
    left = F.flatten(F.transform(F.concat("gone", end), piece))
    removed = F.coalesce(F.aggregate("gone", F.lit(0), lambda c, x: c + x["hi"] - x["lo"] + 1), F.lit(0)).cast("long")
    text = F.when(F.size("gone") > 0, F.array_join(left, "\n")).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept]
    return both.select(*columns, n.alias("n_lines"), removed.alias("n_removed"))
