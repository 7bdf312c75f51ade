"""Words and pairs of words as numbers: what TF-IDF counts in one batch of texts, without a row per term."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.shared import staged


def words(text: Column) -> Column:
    """Word tokens of two characters or more, lower-case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal values, nulls too, by equal numbers."""
    return plain(column).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


class Terms:
    """The terms of texts: entry k says that text ``row[k]`` has ``term[k]`` ``count[k]`` times.

    A term is ``first * base + second``: numbers of words in the order of their code points, the second one more by
    one and 0 for a single word.  As a blank stands before every word's character, terms are ordered like their texts."""

    def __init__(self, listed: pa.Array, unit: np.ndarray):
        flat, sizes = listed.flatten().dictionary_encode(), np.diff(listed.offsets.to_numpy())
        sizes = np.where(listed.is_null().to_numpy(zero_copy_only=False), 0, sizes)
        self.vocabulary = np.array(flat.dictionary.to_pylist(), dtype=object)
        by_name = np.argsort(self.vocabulary, kind="stable")
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        self.vocabulary, self.base = self.vocabulary[by_name], len(by_name) + 1
        w, at = rank[flat.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)
        near = np.flatnonzero(at[1:] == at[:-1])
        term = np.concatenate((w * self.base, w[near] * self.base + w[near + 1] + 1))
        self.row, self.term, self.count = tallied(unit[np.concatenate((at, at[near]))], term)

    def names(self, term: np.ndarray) -> list[str]:
        first, second = self.vocabulary[term // self.base], term % self.base
        return [a if b == 0 else f"{a} {self.vocabulary[b - 1]}" for a, b in zip(first, second, strict=True)]


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers from 0, in the order of the pairs."""
    most = int(b.max()) + 1 if len(b) else 1
    if len(a) and (int(a.max()) + 1) * most >= 1 << 62:
        b = np.unique(b, return_inverse=True)[1]
        most = int(b.max()) + 1
    return a * most + b


def tallied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, with how often they stand there."""
    _, first, count = np.unique(joint(a, b), return_index=True, return_counts=True)
    return a[first], b[first], count


def weighted(row: np.ndarray, count: np.ndarray, df: np.ndarray, n: np.ndarray, units: int) -> np.ndarray:
    """Counts times smoothed idf, of unit length per row."""
    w = count * (np.log((1 + n) / (1 + df)) + 1)
    size = np.sqrt(np.bincount(row, weights=w * w, minlength=units))
    return w / size[row]


#: Groups with more texts or characters than this are joined term by term instead of held in a task.
MOST_UNITS, MOST_CHARS = 256, 4_000_000
#: Words that are worked out together.
MOST_WORDS = 1_000_000


def whole_groups(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    """Rows ordered by their group, some at a time, groups kept whole."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            held.append(part)
            size += len(part.column("words").flatten())
            if size >= MOST_WORDS:
                table = pa.Table.from_batches(held)
                g = codes(table.column(group))
                start = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
                if start:
                    yield table.slice(0, start)
                    held = table.slice(start).to_batches()
                    size = len(plain(table.column("words").slice(start)).flatten())
    if held:
        yield pa.Table.from_batches(held)


def pairs(table: pa.Table, group: str, unit: str, max_df: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rows of the units a and b of a group, and their cosines, where they share a term."""
    g, u = codes(table.column(group)), codes(table.column(unit))
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (u[1:] != u[:-1])))
    of, first = np.cumsum(new) - 1, np.flatnonzero(new)
    n = np.bincount(g)
    t = Terms(plain(table.column("words")), of)
    mine = g[first][t.row]
    key = joint(mine, t.term)
    order = np.argsort(key, kind="stable")
    key, row, count, mine = key[order], t.row[order], t.count[order], mine[order]
    _, inverse, df = np.unique(key, return_inverse=True, return_counts=True)
    kept = df[inverse] <= n[mine] * max_df
    key, row = key[kept], row[kept]
    weight = weighted(row, count[kept], df[inverse][kept], n[mine][kept], len(first))
    found, values, at, lag = [np.zeros(0, np.int64)], [np.zeros(0)], np.arange(len(key)), 1
    while len(at):  # terms met by pairs of entries that stand ``lag`` apart
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        pair, where = np.unique(row[at] * len(first) + row[at + lag], return_inverse=True)
        found.append(pair)
        values.append(np.bincount(where, weights=weight[at] * weight[at + lag], minlength=len(pair)))
        lag += 1
    pair, where = np.unique(np.concatenate(found), return_inverse=True)
    cosine = np.bincount(where, weights=np.concatenate(values), minlength=len(pair))
    return first[pair // len(first)], first[pair % len(first)], cosine


def similar_in_small(rows: DataFrame, group: str, unit: str, max_df: float) -> DataFrame:
    """(group, a, b, cosine) for groups that a task can hold: each group's texts meet in one task, so that texts are
    all that is shuffled."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group):
            a, b, cosine = pairs(table, group, unit, max_df)
            ids = plain(table.column(unit))
            out = [plain(table.column(group)).take(pa.array(a)), ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(cosine)]
            yield pa.RecordBatch.from_arrays(out, names=[group, "a", "b", "cosine"])

    together = rows.select(group, unit, "text").repartition(group).sortWithinPartitions(group, unit)
    schema = f"`{group}` {kinds[group]}, a {kinds[unit]}, b {kinds[unit]}, cosine double"
    return together.select(group, unit, words(F.col("text")).alias("words")).mapInArrow(run, schema)


def large_groups(rows: DataFrame, group: str, most_units: int = MOST_UNITS, most_chars: int = MOST_CHARS) -> DataFrame:
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("text")).alias("_chars"))
    return staged(sizes.where((F.col("_n") > most_units) | (F.col("_chars") > most_chars)).select(group), "large")


#: Characters of the texts that are worked out together, and of those whose terms are counted by one task.
CHUNK_CHARS = 8_000_000


def _hashes(values: list) -> np.ndarray:
    """Two 64-bit numbers (columns) of MD5 for each value."""
    digests = b"".join(hashlib.md5(str(v).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for v in values)
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


class Chunk:
    """The terms of some texts of several groups.  ``term_of`` names each entry's (group, term); these are known to
    other tasks by 96 bits of hashes and stand in the order of their bucket and hash."""

    def __init__(self, table: pa.Table, group: str, unit: str, buckets: int):
        g, u = codes(table.column(group)), codes(table.column(unit))
        _, self.first, of = np.unique(joint(g, u), return_index=True, return_inverse=True)
        self.terms = t = Terms(plain(table.column("words")), of)
        mine = g[self.first][t.row]
        self.n = plain(table.column("_n")).to_numpy()[self.first][t.row]
        _, one, inverse, df = np.unique(joint(mine, t.term), return_index=True, return_inverse=True, return_counts=True)
        named = _hashes(plain(table.column(group)).dictionary_encode().dictionary.to_pylist())[mine[one] - 1]
        of_word = np.concatenate((np.zeros((1, 2), np.uint64), _hashes(t.vocabulary.tolist())))
        first, second = of_word[t.term[one] // t.base + 1], of_word[t.term[one] % t.base]
        mixed = (named ^ first * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + second * np.uint64(0x94D049BB133111EB)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        high, low = mixed[:, 0], (mixed[:, 1] >> np.uint64(32)).astype(np.uint32)
        bucket = (high >> np.uint64(20)) % np.uint64(buckets)
        order = np.lexsort((low, high, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.term_of, self.high, self.low, self.df, self.bucket = place[inverse], high[order], low[order], df[order].astype(np.uint32), bucket[order].astype(np.int64)


def _asked(table: pa.Table, group: str, unit: str, buckets: int) -> pa.Table:
    c = Chunk(table, group, unit, buckets)
    starts = np.flatnonzero(np.diff(c.bucket, prepend=-1))
    ends = np.append(starts[1:], len(c.bucket)).astype(np.int64)
    parts = [pa.array([x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for x in (c.high, c.low, c.df)]
    chunk = pa.array(np.full(len(starts), table.column("_chunk")[0].as_py(), np.int64))
    return pa.table([chunk, pa.array(c.bucket[starts]), *parts], names=["_chunk", "_bucket", "high", "low", "df"])


def _answered(table: pa.Table) -> pa.Table:
    """Document frequencies over all chunks for a bucket's terms, as every chunk asked for them."""
    high, low, df = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]) for c, kind in (("high", np.uint64), ("low", np.uint32), ("df", np.uint32)))
    sizes = np.array([len(x.as_buffer()) // 4 for x in table.column("low")])
    order = np.lexsort((low, high))
    new = np.concatenate(([True], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)))
    total = np.empty(len(order), np.uint32)
    total[order] = np.add.reduceat(df[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    parts = [x.tobytes() for x in np.split(total, np.cumsum(sizes)[:-1])]
    return pa.table([table.column("_chunk"), table.column("_bucket"), pa.array(parts, pa.binary())], names=["_chunk", "_bucket", "df"])


def _top(table: pa.Table, answers: pa.Table, group: str, unit: str, buckets: int, max_df: float, k: int) -> pa.Table:
    c = Chunk(table, group, unit, buckets)
    t, parts = c.terms, answers.sort_by("_bucket").column("df").to_pylist()
    df = np.frombuffer(b"".join(parts), np.uint32).astype(np.int64)[c.term_of]
    kept = df <= c.n * max_df
    row, term, count, df, n = (x[kept] for x in (t.row, t.term, t.count, df, c.n))
    weight = weighted(row, count, df, n, len(c.first))
    order = np.lexsort((term, -np.round(weight, 9), row))
    row, term, weight = row[order], term[order], weight[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, term, weight, rank = (x[rank < k] for x in (row, term, weight, rank))
    at = pa.array(c.first[row])
    return pa.table([plain(table.column(group)).take(at), plain(table.column(unit)).take(at), pa.array(t.names(term), pa.string()), pa.array(weight), pa.array((rank + 1).astype(np.int32))], names=[group, unit, "term", "weight", "rn"])


def top_weighted(rows: DataFrame, group: str, unit: str, k: int, max_df: float, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(group, unit, term, weight, rn): the ``k`` terms of largest weight of every unit.

    Texts are dealt into chunks.  A chunk asks once for each of its terms, by hash and packed by bucket, how many units
    of the group have it; a bucket's task adds up what the chunks counted and answers them.  So no row per text and term is made."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.select(group, unit, "text").where(F.col(group).isNotNull())
    sizes = staged(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("text")).alias("_chars")), "sizes")
    parts = max(1, -(-(sizes.agg(F.sum("_chars")).first()[0] or 0) // chunk_chars))
    dealt = rows.join(sizes.select(group, "_n"), group).withColumn("_chunk", F.pmod(F.xxhash64(group, unit), F.lit(parts))).repartition(parts, "_chunk")
    chunks = dealt.select("_chunk", group, unit, "_n", words(F.col("text")).alias("words")).groupBy("_chunk")
    asked = chunks.applyInArrow(lambda t: _asked(t, group, unit, parts), "_chunk long, _bucket long, high binary, low binary, df binary")
    answers = asked.groupBy("_bucket").applyInArrow(_answered, "_chunk long, _bucket long, df binary")
    schema = f"`{group}` {kinds[group]}, `{unit}` {kinds[unit]}, term string, weight double, rn int"
    return chunks.cogroup(answers.groupBy("_chunk")).applyInArrow(lambda t, a: _top(t, a, group, unit, parts, max_df, k), schema)
