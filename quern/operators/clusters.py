"""Clusters of articles: centroids, representatives, assignment and online leader clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import cosine


def centroids(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, centroid, size): unit mean of the non-null vectors.  Sums per dimension are combined
    on the map side; a key's vectors are never gathered."""
    parts = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    out = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("v"), F.max("n").alias("size"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return out.select(key, F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).alias("centroid"), "size")


def representatives(news: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, id) of the earliest published member, or else the earliest collected one."""
    first = F.struct(F.col("published_at").isNull().alias("late"), F.coalesce("published_at", "collected_at").alias("at"), F.col("id"))
    return news.groupBy(key).agg(F.min(first)["id"].alias("id"))


def with_primary(news: DataFrame, key: str = "cluster_id") -> DataFrame:
    reps = representatives(news, key).select(key, F.col("id").alias("_rep"))
    return news.join(reps, key, "left").withColumn("is_primary", F.coalesce(F.col("id") == F.col("_rep"), F.lit(False))).drop("_rep")


def member_order() -> list[Column]:
    return [F.col("is_primary").desc_nulls_first(), F.col("published_at").asc_nulls_last(), F.col("collected_at").asc(), F.col("id").asc()]


def ranked_members(news: DataFrame, key: str = "cluster_id", most: int | None = 5) -> DataFrame:
    """Members with their place ``rn`` in the cluster, the first ``most``."""
    out = news.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*member_order())))
    return out if most is None else out.where(F.col("rn") <= most)


def members_of(news: DataFrame, cluster_id: int, nulls_first: bool = False) -> DataFrame:
    """One cluster's members by time of publication, for reports."""
    at = F.col("published_at")
    return news.where(F.col("cluster_id") == cluster_id).orderBy(at.asc_nulls_first() if nulls_first else at.asc_nulls_last(), "id")


def by_id(clusters: DataFrame, cluster_id: int) -> DataFrame:
    return clusters.where(F.col("cluster_id") == cluster_id)


def titles(news: DataFrame, key: str = "cluster_id") -> DataFrame:
    """A title per cluster: the primary member's, or the first member's that has one."""
    given = F.when(F.col("title") != "", F.col("title"))
    ranked = ranked_members(news, key, None)
    order = F.struct((~F.col("is_primary")).alias("other"), "rn")
    return ranked.groupBy(key).agg(F.min_by(given, F.when(given.isNotNull(), order)).alias("title"))


def recent(rows: DataFrame, as_of, hours: int, column: str = "collected_at") -> DataFrame:
    return rows.where(F.col(column) >= F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)))


def to_cluster(news: DataFrame, as_of, hours: int) -> DataFrame:
    return recent(news.where("cluster_id is null"), as_of, hours)


#: Bytes of centres that are broadcast at most, and centres in one block beyond that.
BROADCAST_BYTES, BLOCK = 32 << 20, 1024


def totals(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, total): the sum of the non-null vectors, combined on the map side per dimension."""
    parts = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("i", "x"))
    sums = parts.groupBy(key, "i").agg(F.sum(F.col("x").cast("double")).alias("m"))
    return sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("total"))


def nearest(rows: DataFrame, centers: DataFrame, threshold: float, id_: str, vector: str = "embedding", most_bytes: int = BROADCAST_BYTES, block: int = BLOCK) -> DataFrame:
    """(id, center, score): each row's centre of largest cosine above 0, the first of equal ones;
    null where that is below the threshold.

    Centres of up to ``most_bytes`` travel as one broadcast array and the search is a fold over it.
    More of them are cut into blocks of about ``block``; every row meets every block by an
    equi-join on the block's number, dealt over several salts, and its best per block is combined
    on the map side.  Ids must be unique."""
    size = centers.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("dims")).first()
    n = size["n"]
    small = n * (8 * (size["dims"] or 0) + 64) <= most_bytes
    blocks = 1 if small else -(-n // block)
    salts = 1 if small else max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    held = centers.groupBy(F.pmod(F.xxhash64("ord", "center"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct(F.col("ord"), F.col("center"), F.col("centroid"))).alias("c"))
    scores = F.transform("c", lambda c: F.struct(cosine(F.col(vector), c["centroid"]).alias("s"), (-c["ord"]).alias("o"), c["center"].alias("center")))
    asked = rows.select(id_, vector)
    if small:
        met = asked.withColumn("_block", F.lit(0).cast("long")).join(F.broadcast(held), "_block", "left")
        best = met.select(id_, F.array_max(scores).alias("b"))
    else:
        dealt = asked.withColumn("_salt", F.pmod(F.xxhash64(vector), F.lit(salts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        held = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        best = dealt.join(held, ["_block", "_salt"]).select(id_, F.array_max(scores).alias("b")).groupBy(id_).agg(F.max("b").alias("b"))
    good = (F.col("b.s") > 0) & (F.col("b.s") >= threshold)
    return best.select(id_, F.when(good, F.col("b.center")).alias("center"), F.col("b.s").alias("score"))


#: Queries that meet a row in one go, and rows that are scored at once or held by a task.
QUERIES, TILE, HELD = 4096, 1024, 16384
#: What a product of matrices may differ by from the sum that counts.
SLACK = 1e-8


def _units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one as rows, and their numbers of dimensions; null ones are zero."""
    lists = vectors.to_pylist()
    sizes = np.array([-1 if v is None or None in v else len(v) for v in lists], np.int64)
    out = np.zeros((len(lists), max(1, sizes.max(initial=1))))
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        out[at, :n] = [lists[i] for i in at]
    length = np.sqrt(np.sum(out * out, axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0), sizes


def _best(queries: pa.Array, q: np.ndarray, q_sizes: np.ndarray, ids: pa.Array, v: np.ndarray, v_sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best rows per query, by score and id.  Products of matrices name
    the rows that may be among them; their scores are summed up alike wherever a vector stands."""
    asked, named = np.array(queries.to_pylist(), dtype=object), np.array(ids.to_pylist(), dtype=object)
    place = np.empty(len(named), np.int64)
    place[np.argsort(named, kind="stable")] = np.arange(len(named))
    dims = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (q, v))
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    least, same = np.full(len(q), -np.inf), len(np.unique(np.concatenate((q_sizes, v_sizes)))) == 1
    for start in range(0, len(v), TILE):
        tile = slice(start, start + TILE)
        rough = q @ v[tile].T
        if not same:
            rough[q_sizes[:, None] != v_sizes[None, tile]] = 0.0
        if len(v[tile]) > k + 1:  # rows below the (k + 1)st here can't be among the best; one of them may be the query itself
            here = np.maximum(least, np.partition(rough, len(v[tile]) - k - 1, axis=1)[:, -k - 1])
        else:
            here = least
        a, b = np.nonzero(rough >= (here - SLACK)[:, None])
        b += start
        other = asked[a] != named[b]
        a, b = a[other], b[other]
        score = np.empty(len(a))
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            score[i : i + (1 << 16)] = np.where(q_sizes[x] == v_sizes[y], np.sum(q[x] * v[y], axis=1), 0.0)
        a, b, score = (np.concatenate(x) for x in zip(held, (a, b, np.round(score, 9) + 0.0), strict=True))
        order = np.lexsort((place[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        least = np.full(len(q), -np.inf)
        least[a[rank == k - 1]] = score[rank == k - 1]
        held = [x[rank < k] for x in (a, b, score)]
    return tuple(held)


def most_similar(rows: DataFrame, queries: DataFrame, k: int, id_: str, vector: str = "embedding", block: int = QUERIES) -> DataFrame:
    """(query, id, score, rn): for each query the ``k`` rows of largest cosine but itself, the smaller
    id first of equal ones.

    Queries are cut into blocks of about ``block`` and every row meets every block, dealt over
    several salts; a task scores its rows by products of matrices and keeps its own ``k`` of a query.
    Vectors that are null or zero have cosine 0 with all."""
    kind = dict(rows.dtypes)[id_]
    blocks = max(1, -(-queries.count() // block))
    salts = max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks), -(-rows.count() // HELD))
    held = queries.select(F.col(id_).alias("q"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_), F.lit(blocks)).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    asked = rows.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_), F.lit(salts)).cast("int").alias("_salt"))
    asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def met(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, qs = mine.column("id").combine_chunks(), theirs.column("q").combine_chunks()
        a, b, score = _best(qs, *_units(theirs.column("v")), ids, *_units(mine.column("v")), k)
        return pa.table({"query": qs.take(pa.array(a)), "id": ids.take(pa.array(b)), "score": pa.array(score)})

    pairs = asked.groupBy("_block", "_salt").cogroup(held.groupBy("_block", "_salt")).applyInArrow(met, f"query {kind}, id {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)


def with_source(news: DataFrame, sources: DataFrame, default: str = "") -> DataFrame:
    """Articles with their source's name for display, ``default`` where it isn't known."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return news.join(names, "source_id", "left").withColumn("source_name", F.coalesce("source_name", F.lit(default)))


#: Vectors of a sequence that are looked up together, centroids that share a bound, and those multiplied at once.
AHEAD, SHARED, WIDE = 256, 128, 8192


class Leaders:
    """The clusters of one sequence.  The next vectors are multiplied with all centroids at once, in single precision,
    which gives bounds for every ``SHARED`` centroids; a vector's scores are then worked out, from the sums as they
    stand, for the centroids changed meanwhile and for those whose bound reaches the best score found."""

    def __init__(self):
        self.used, self.sums, self.norms, self.rough, self.leaders = 0, None, None, None, []

    def put(self, k: int, total: np.ndarray) -> None:
        n = np.linalg.norm(total)
        self.sums[k], self.norms[k] = total, n if n > 0 else 1.0
        self.rough[k] = total / self.norms[k]

    def found(self, x: np.ndarray, leader) -> None:
        if self.used == 0:
            self.sums, self.norms, self.rough = np.zeros((64, len(x))), np.ones(64), np.zeros((64, len(x)), np.float32)
        elif self.used == len(self.sums):
            more = self.used // 2
            self.sums, self.norms, self.rough = (np.concatenate((m, np.zeros((more, *m.shape[1:]), m.dtype))) for m in (self.sums, self.norms, self.rough))
        self.put(self.used, x)
        self.used += 1
        self.leaders.append(leader)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each vector (row of ``x``) the largest rough score in each ``SHARED`` centroids."""
        parts, x = [np.zeros((0, len(x)), np.float32)], np.ascontiguousarray(x.T, dtype=np.float32)
        for i in range(0, self.used, WIDE):
            score = self.rough[i : min(i + WIDE, self.used)] @ x
            parts.append(np.maximum.reduceat(score, np.arange(0, len(score), SHARED), axis=0))
        return np.ascontiguousarray(np.concatenate(parts).T)

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.sum(self.sums[at] / self.norms[at, None] * x, axis=1)

    def best(self, x: np.ndarray, bound: np.ndarray, changed: np.ndarray) -> tuple[int, float]:
        """The first centroid of the largest cosine with the unit vector ``x``, and that."""
        slack = 1e-5 + 2e-7 * len(x)
        at, top, seen = -1, -np.inf, [changed] if len(changed) else []
        open_ = bound >= -np.inf
        if not seen:
            seen = [self.members(int(bound.argmax()), open_)]
        while seen:
            for part in seen:
                score = self.scores(part, x)
                k = int(np.argmax(score))
                if score[k] > top or (score[k] == top and part[k] < at):
                    at, top = int(part[k]), float(score[k])
            left = np.flatnonzero(open_ & (bound >= top - slack))
            seen = [self.members(int(left[bound[left].argmax()]), open_)] if len(left) else []
        return at, top

    def members(self, group: int, open_: np.ndarray) -> np.ndarray:
        open_[group] = False
        per = -(-WIDE // SHARED)
        start = group // per * WIDE + group % per * SHARED
        return np.arange(start, min(start + SHARED, self.used))

    def taken(self, keys: list, ids: list, vectors: list[np.ndarray], new: list[bool], threshold: float) -> list[tuple]:
        size = [float(np.linalg.norm(x)) for x in vectors]
        asked = [i for i, n in enumerate(size) if n > 0 and new[i]]
        bound = dict(zip(asked, self.bounds(np.array([vectors[i] / size[i] for i in asked])), strict=True)) if self.used and asked else {}
        out, base, changed = [], self.used, set()
        for i, x in enumerate(vectors):
            at, score = -1, 0.0
            if new[i] and self.used and size[i] > 0:
                moved = np.concatenate((np.fromiter(changed, np.int64, len(changed)), np.arange(base, self.used)))
                moved.sort()
                at, score = self.best(x / size[i], bound.get(i, np.zeros(0, np.float32)), moved)
            if at >= 0 and score > 0 and score >= threshold:
                self.put(at, self.sums[at] + x)
                if at < base:
                    changed.add(at)
            else:
                at = -1
                if size[i] > 0:
                    self.found(x, ids[i])
                    at = self.used - 1
                score = max(score, 0.0)
            if new[i]:
                out.append((keys[i], ids[i], self.leaders[at] if size[i] > 0 else ids[i], score))
        return out


def leader_clusters(rows: DataFrame, threshold: float, order: str, id_: str, block: str, vector: str = "embedding", existing: DataFrame | None = None) -> DataFrame:
    """(block, id, leader, score): online leader clustering in ``order`` within each block.

    Each row joins the cluster whose centroid (unit mean of its members so far) has the largest
    cosine above 0, the earliest of equal ones, if that reaches the threshold; otherwise it founds
    a cluster.  The result depends on the order, so a block is one sequence: its rows stream
    through one task in order and only the centroids are held.  Blocks run side by side.

    ``existing``: clusters (block, leader, total) of earlier runs, ``total`` the sum of their
    members' vectors; they come before all new ones, by leader."""
    schema = rows.select(block, id_).schema.add("leader", "long").add("score", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:
            out, keys = [], pdf[block].tolist()
            same = lambda a, b: a == b or (pd.isna(a) and pd.isna(b))
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and end - start < AHEAD and same(keys[start], keys[end]):
                    end += 1
                if state is None or not same(at, keys[start]):
                    at, state = keys[start], Leaders()
                part = pdf.iloc[start:end]
                vectors = [np.zeros(0) if v is None else np.asarray(v, dtype=float) for v in part[vector]]
                out += state.taken(keys[start:end], part[id_].tolist(), vectors, part["_new"].tolist(), threshold)
                start = end
            yield pd.DataFrame(out, columns=[block, id_, "leader", "score"])

    asked = rows.select(F.col(block), F.col(id_), F.col(order).alias("_order"), F.col(vector).cast("array<double>").alias(vector), F.lit(True).alias("_new"))
    if existing is not None:
        kinds = dict(asked.dtypes)
        seeds = existing.select(F.col(block).cast(kinds[block]).alias(block), F.col("leader").cast(kinds[id_]).alias(id_), F.lit(None).cast(kinds["_order"]).alias("_order"), F.col("total").alias(vector), F.lit(False).alias("_new"))
        asked = asked.union(seeds)
    return asked.repartition(block).sortWithinPartitions(block, "_new", "_order", id_).select(block, id_, vector, "_new").mapInPandas(run, schema)
