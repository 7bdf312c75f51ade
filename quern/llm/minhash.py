"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard, components.

Two permutations of the 32-bit universe serve all K coordinates: the first scatters the shingle
hashes, the second is read circularly shifted by k for coordinate k.  Consecutive coordinates make
a band; documents that agree on a band share a bucket.  ``percent`` sets the coordinates a band
has: 6 at 80 %, where a pair at the limit misses all 42 bands once in 340,000 times.

Texts with equal shingle sets form one class from the start and only its smallest id goes on, so
thousands of exact copies cost one row.  In a bucket nothing is paired with everything:

1. every member is paired with the bucket's smallest id; pairs whose sizes rule the similarity out,
   or whose 256 one-bit coordinates put it seven standard deviations away (odds of 10^-12 against
   a pair at the limit), are dropped; the first pair of each document is confirmed on the full
   sets, then those of its others that still join two components;
2. where a bucket still holds several components, the smallest id of its largest one is its head.
   Members near the head are compared by their differences from it (``beside``), others by their
   rarest shingles (``across``): both are prefix filters, which lose no link and pair only
   documents that share an element rare among them.

All links are confirmed by intersecting full sets of 64-bit shingle hashes.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing, however
many there are; a text of fewer words than a shingle has one shingle; a very long text is hashed a
part at a time and its sets and signature cover all of it; rows without a doc_id can't be named, so
they are their own component (null); rows that share a doc_id are one node, linked with what any of
their texts is linked with; repeated rows get equal results; of equal sets the smallest id is
kept; an empty table gives an empty one.  Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textblocks as tb
from quern.llm.components import components
from quern.llm.store import staged

K = 256
WORDS, PERCENT = 5, 80
#: The odds that a pair at the limit shares no band.
MISS = 3e-6
_CHUNK = 1 << 18
_WORDS = 16
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in UTF-8, A-Z in lower case, a few MB at a time."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        buf = np.frombuffer(raw[at:end].lower(), dtype=np.uint8)
        inside = np.concatenate(([False], ~_SPACE[buf], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        out.append(tb.mix(tb.Hashes(buf).of(edge[::2], edge[1::2])))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), dtype=np.uint64)
    for j in range(min(size, len(w))):
        h = tb.mix(h * np.uint64(0xD6E8FEB86659FD93) + w[j : j + n])
    return np.unique(h)


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


_SHIFTS = np.arange(K, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """K circulant minima."""
    s = _permute((shingles >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    low = np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(s), 256):
        block = s[at : at + 256, None] + _SHIFTS
        np.minimum(low, _permute(block, 0x7FEB352D, 0x846CA68B).min(axis=0), out=low)
    return low


def band_rows(percent: int) -> int:
    """As many coordinates a band as leave a pair at ``percent`` undetected less than once in 1 / MISS."""
    fits = [r for r in range(1, K + 1) if (1 - (percent / 100) ** r) ** (K // r) <= MISS]
    if not fits:
        raise ValueError(f"{K} coordinates can't tell pairs of {percent} % from others")
    return max(fits)


def most_bits(percent: int) -> int:
    """Bits of K in which a pair at ``percent`` may differ: half of the coordinates that differ do,
    and seven standard deviations more."""
    p = (1 - percent / 100) / 2
    return int(K * p + 7 * sqrt(K * p * (1 - p))) + 1


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    n = K // rows
    part = sig[: n * rows].reshape(n, rows).astype(np.uint64)
    h = np.arange(1, n + 1, dtype=np.uint64)
    for j in range(rows):
        h = tb.mix(h * np.uint64(0xD6E8FEB86659FD93) + part[:, j])
    return h.view(np.int64)


_SKETCH = "doc_id long, n long, a long, b long, bands array<long>, bits array<long>"


def sketches(docs: DataFrame, size: int = WORDS, rows: int = band_rows(PERCENT)) -> DataFrame:
    """Per row its number of shingles, two hashes that name its set, its bands and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            cols: list[list] = [[], [], [], [], []]
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), size)
                sig = signature(s) if len(s) else None
                for c, v in zip(cols, (len(s), *_name(s), [] if sig is None else bands(sig, rows), [] if sig is None else np.packbits((sig & 1).astype(bool)).view(np.int64)), strict=True):
                    c.append(v)
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], names=["doc_id", "n", "a", "b", "bands", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH)


def _name(s: np.ndarray) -> list[int]:
    """128 bits that stand for a whole set."""
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist()


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """Full sets of rows (doc, a, b, text); rows of the same id whose set is another one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            docs, sets = [], []
            for doc, a, b, t in zip(*(batch.column(c) for c in ("doc", "a", "b", "text")), strict=True):
                s = shingle_set(t.as_py(), size)
                if _name(s) == [a.as_py(), b.as_py()]:
                    docs.append(doc.as_py())
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "s"])

    return texts.select("doc", "a", "b", "text").mapInArrow(run, "doc long, s array<long>")


def _possible(percent: int) -> Column:
    """Sizes and bits allow the pair (x, y) to be similar enough."""
    apart = sum((F.bit_count(F.get("x_bits", F.lit(i)).bitwiseXOR(F.get("y_bits", F.lit(i)))) for i in range(K // 64)), F.lit(0))
    return (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent) & (apart <= most_bits(percent))


class _Search:
    """One near-duplicate search; its tables are written once and read by several steps."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
        self.rows = staged(sketches(docs, size, band_rows(percent)), "sketches")
        some = self.rows.where("n > 0 and doc_id is not null").withColumnRenamed("doc_id", "doc")
        self.classes = staged(some.groupBy("a", "b").agg(F.min("doc").alias("doc")), "classes")
        # joined by id and set together, so that a set with many copies is dealt over all tasks
        heads = some.join(self.classes, ["doc", "a", "b"], "left_semi").dropDuplicates(["doc", "a", "b"])
        self.heads = staged(heads.select("doc", "n", "a", "b", "bands", "bits"), "heads")

    def named(self, side: str) -> DataFrame:
        return self.heads.select(F.col("doc").alias(side), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """Full sets of the documents ``doc``."""
        wanted = wanted.distinct().join(self.heads.select("doc", "a", "b"), "doc")
        return staged(_sets(self.docs.join(wanted, "doc"), self.size), "sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that reach the similarity on their full sets, as edges."""
        x, y = sets.select(F.col("doc").alias("x"), F.col("s").alias("xs")), sets.select(F.col("doc").alias("y"), F.col("s").alias("ys"))
        met = pairs.select("x", "y").join(x, "x").join(y, "y").withColumn("both", F.size(F.array_intersect("xs", "ys")))
        enough = F.col("both") * 100 >= (F.size("xs") + F.size("ys") - F.col("both")) * self.percent
        return staged(met.where(enough).select(F.col("x").alias("u"), F.col("y").alias("v")), "links")

    def roots(self) -> DataFrame:
        """(node, root) of all classes but those that are linked with no smaller one."""
        buckets = self.heads.select("doc", F.explode("bands").alias("key"))
        live = buckets.groupBy("key").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last")).where("pivot < last").drop("last")
        members = staged(buckets.join(live, "key"), "members")
        tried = members.where("doc <> pivot").select(F.col("doc").alias("x"), F.col("pivot").alias("y")).distinct()
        tried = staged(tried.join(self.named("x"), "x").join(self.named("y"), "y").where(_possible(self.percent)).select("x", "y"), "tried")
        sets = self.sets(_ends(tried))
        links = self.confirmed(tried.groupBy("x").agg(F.min("y").alias("y")), sets)
        found = components(links)
        more = self.confirmed(_rooted(_rooted(tried, "x", found), "y", found).where("x_root <> y_root"), sets)
        if not more.isEmpty():
            links = links.union(more)
            found = components(links)
        return self.across(members, links, found)

    def across(self, members: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
        """Links between the components that still share a bucket, and the components with them.

        A bucket's strays are its members outside its largest component; that component's smallest
        id is the bucket's head.  Strays and members near one head are left to ``beside``.  All
        documents of buckets that hold one which is not near the head are joined on the shingles
        of their prefixes, unless they have a near head in common."""
        placed = _rooted(members.select("key", F.col("doc").alias("x")), "x", found)
        parts = placed.groupBy("key", "x_root").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least"))
        split = parts.groupBy("key").agg(F.max(F.struct("c", "x_root", "least")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        split = split.select("key", F.col("top.x_root").alias("most"), F.col("top.least").alias("y"))
        mixed = placed.join(split, "key").join(self.named("x"), "x").join(self.named("y"), "y")
        mixed = mixed.select("key", "x", "x_root", F.col("y").alias("head"), _possible(self.percent).alias("x_near"), (F.col("x_root") != F.col("most")).alias("stray"))
        mixed = staged(mixed, "mixed")
        near = mixed.where("x_near").groupBy("head", "x").agg(F.first("x_root").alias("x_root"), F.max("stray").alias("stray"))
        open_ = near.where("stray").select("head").distinct()
        near = staged(near.join(open_, "head").select(F.col("head").alias("y"), "x", "x_root", "stray"), "near")
        loose = mixed.groupBy("key").agg(F.min("x_near").alias("all_near")).where("not all_near").select("key")
        far = mixed.join(loose, "key", "left_semi").groupBy("x").agg(F.first("x_root").alias("x_root"))
        homes = mixed.where("x_near").groupBy("x").agg(F.min("head").alias("home"))
        far = staged(far.join(homes, "x", "left").select("x", "x_root", F.coalesce("home", "x_root").alias("home")), "far")
        sets = self.sets(_ends(near.select("x", "y")).union(far.select(F.col("x").alias("doc"))))
        more = self.apart(far, sets).union(self.beside(near, sets))
        return found if more.isEmpty() else components(links.union(more))

    def apart(self, far: DataFrame, sets: DataFrame) -> DataFrame:
        """Links of documents that have no near head in common: a similarity of p % means that at least
        p % of either set is shared, hence one of the rarest (100 - p) % and one more."""
        d = far.join(sets.select(F.col("doc").alias("x"), F.col("s").alias("d")), "x").withColumn("nd", F.size("d"))
        share = F.ceil(F.col("nd") * self.percent / F.lit(100.0)).cast("int")
        rows = d.select(F.lit(0).cast("long").alias("y"), "x", "x_root", "home", F.col("nd").alias("n"), "nd", "d", F.lit(True).alias("asks"), share.alias("share"), share.alias("ask_share"))
        return self.confirmed(self.shared(rows, "apart"), sets)

    def beside(self, near: DataFrame, sets: DataFrame) -> DataFrame:
        """Links of strays with other members near the same head, without pairing them all.

        With D(x) the symmetric difference of x and the head h, |x ^ y| = |D(x)| + |D(y)| -
        2 |D(x) & D(y)|, and a similarity of p % means |x ^ y| <= r (|x| + |y|), r = (100 - p) /
        (100 + p).  A stray that isn't linked with h has |D(x)| > r (|x| + |h|), so it is linked
        with y only if the two share more than (|D(y)| + r (|h| - |y|)) / 2 differences, hence
        one of the rarest |D(y)| + 1 - that many of D(y).  Of a copy in which words were replaced
        these are the new shingles alone, which copies of one text seldom share."""
        x, h = sets.select(F.col("doc").alias("x"), F.col("s").alias("xs")), sets.select(F.col("doc").alias("y"), F.col("s").alias("hs"))
        d = near.where("x <> y").join(x, "x").join(h, "y").select("x", "y", "x_root", "stray", F.size("xs").alias("n"), F.size("hs").alias("hn"), F.concat(F.array_except("xs", "hs"), F.array_except("hs", "xs")).alias("d"))
        d = staged(d.withColumn("nd", F.size("d")), "differences")
        linked = F.col("nd") * (100 + self.percent) <= (F.col("n") + F.col("hn")) * (100 - self.percent)
        direct = d.where(F.col("stray") & linked).select(F.col("x").alias("u"), F.col("y").alias("v"))
        twice = F.col("nd") * (100 + self.percent) + (F.col("hn") - F.col("n")) * (100 - self.percent)
        share = (F.floor(twice / F.lit(2 * (100 + self.percent))) + 1).cast("int")
        rows = d.select("y", "x", "x_root", F.col("x_root").alias("home"), "n", "nd", "d", (F.col("stray") & ~linked).alias("asks"), F.greatest(share, F.lit(1)).alias("share"), F.lit(1).alias("ask_share"))
        return direct.union(self.confirmed(self.shared(rows, "beside"), sets))

    def shared(self, rows: DataFrame, label: str) -> DataFrame:
        """Pairs (x, y) that may be linked, one of which asks, of different homes and components.

        Rows (y, x, x_root, home, n, nd, d, asks, share, ask_share): within the group ``y``, x has
        size n and the nd elements d, and is linked with another only if the two share ``share``
        of them (``ask_share`` where x asks).  Elements are ranked by how many rows of the group
        have them; the first one that a pair shares stands early enough in both."""
        rows = staged(rows, label)
        each = rows.select("y", "x", "home", "nd", "asks", "share", "ask_share", F.explode("d").alias("e"))
        often = each.groupBy("y", "e").agg(F.count(F.lit(1)).alias("df"), F.min("home").alias("h0"), F.max("home").alias("h1"), F.max("asks").alias("asked")).where("df > 1")
        often = often.select("y", "e", "df", ((F.col("h0") < F.col("h1")) & F.col("asked")).alias("joins"))
        # an element that one row alone has joins nothing; it only takes its place in the rank
        ranked = each.join(often, ["y", "e"], "left").withColumn("i", F.row_number().over(Window.partitionBy("y", "x").orderBy(F.coalesce("df", F.lit(1)), "e")))
        least = F.when(F.col("asks"), F.least("share", "ask_share")).otherwise(F.col("share"))
        prefix = staged(ranked.where(F.col("joins") & (F.col("i") <= F.col("nd") + 1 - least)).select("y", "e", "x", "i", "asks", "share", "ask_share"), f"{label}-prefix")
        # the overlap is at most the common bits of two bitmaps and the elements lost in one of them
        bitmap = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda w: F.aggregate(F.filter("d", lambda e: F.shiftright(e, 6).bitwiseAND(F.lit(_WORDS - 1)) == w), F.lit(0).cast("long"), lambda m, e: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e.bitwiseAND(F.lit(63)).cast("int")))))
        marks = staged(rows.select("y", "x", "x_root", "home", "n", "nd", bitmap.alias("m")), f"{label}-marks")
        full = prefix.join(marks, ["y", "x"])
        asked = full.where(F.col("asks") & (F.col("i") <= F.col("nd") + 1 - F.col("ask_share"))).drop("asks", "share", "ask_share")
        other = full.where(F.col("i") <= F.col("nd") + 1 - F.col("share")).select("y", "e", *(F.col(c).alias(f"z{c}") for c in ("x", "i", "x_root", "home", "n", "nd", "m")))
        common = sum((F.bit_count(F.get("m", F.lit(i)).bitwiseAND(F.get("zm", F.lit(i)))) for i in range(_WORDS)), F.lit(0))
        lost = F.col("nd") - sum((F.bit_count(F.get("m", F.lit(i))) for i in range(_WORDS)), F.lit(0))
        # twice the overlap that a link needs, times 100 + percent
        needs = (F.col("nd") + F.col("znd")) * (100 + self.percent) - (F.col("n") + F.col("zn")) * (100 - self.percent)
        at_most = lambda c: c * (2 * (100 + self.percent)) >= needs
        early = at_most(F.least(F.col("nd") - F.col("i"), F.col("znd") - F.col("zi")) + 1)
        fits = (F.col("x_root") != F.col("zx_root")) & (F.col("home") != F.col("zhome")) & early & at_most(common + lost)
        met = asked.join(other, ["y", "e"]).where(fits).select(F.greatest("x", "zx").alias("x"), F.least("x", "zx").alias("y")).distinct()
        return staged(met, f"{label}-pairs")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("doc")).union(pairs.select("y"))


def _rooted(df: DataFrame, side: str, found: DataFrame) -> DataFrame:
    """Adds the root of the component of ``side``."""
    at = found.select(F.col("node").alias(side), F.col("root").alias("_root"))
    return df.join(at, side, "left").withColumn(f"{side}_root", F.coalesce("_root", side)).drop("_root")


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row doc_id, n_shingles, component_id (the smallest id reachable by links) and kept."""
    search = _Search(docs, size, percent)
    found = search.roots()
    # one row per set; the join back has nothing above it, so Spark can split a set with many copies
    named = search.classes.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("a", "b", F.coalesce("root", "doc").alias("component_id"))
    named = staged(named, "named")
    linked = search.rows.where("n > 0 and doc_id is not null").join(named, ["a", "b"]).select("doc_id", "n", "component_id")
    alone = search.rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.union(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
