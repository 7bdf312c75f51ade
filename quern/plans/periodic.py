"""The periodic run over snapshots: filter, store, cluster, summarise, tag, render what is ready.

Each step's table is written below ``folder`` and read again before the next one uses it, so a
step is worked out once and a lost executor costs tasks, not steps.  Nothing reads the clock."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import articles as A
from quern.operators import clusters as C
from quern.operators import lifecycle as L
from quern.operators import summaries as S
from quern.operators import tags as G
from quern.plans.shared import staged

NEWS = "id long, source string, title string, url string, text string, published_at timestamp, collected_at timestamp, cluster_id long, is_primary boolean, embedding array<double>"
CLUSTERS = "cluster_id long, title string, summary_text string, tags string, status string, cluster_size long, created_at timestamp, updated_at timestamp"

#: Characters of each member's text that a cluster's summary reads.
MOST_MEMBER_CHARS = 2500


@dataclass
class Rules:
    """What a run decides by.  ``tags``: {tag, vector, positive, negative} each, in order of rank."""

    tags: Sequence[dict] = ()
    foreign: Sequence[str] = ()
    home: Sequence[str] = ()
    banned: Sequence[str] = ()
    threshold: float = 0.7
    sentences: int = 4
    most_chars: int = 800
    least_score: float = 0.35
    most_posts: int = 30
    #: Lists of needles for ``articles.is_valid``, where they aren't the fixed ones.
    valid: dict = field(default_factory=dict)
    encode: object = None


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")))


def stored(news: DataFrame, articles: DataFrame, sources: DataFrame, rules: Rules) -> DataFrame:
    """``news`` and the new valid articles (id, source, title, url, text, published_at, collected_at, ord)."""
    fresh = A.to_store(articles.where(A.is_valid(**rules.valid)), news, sources)
    return news.unionByName(_shaped(fresh.withColumn("embedding", F.lit(None)), NEWS))


def encoded(news: DataFrame, as_of, hours: int, rules: Rules, block: str | None = None) -> DataFrame:
    """(id, at, block, vector) of recent articles without a cluster; vectors that are there stay."""
    encode = rules.encode or V.encoder()
    made = encode(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit(""))))
    return C.to_cluster(news, as_of, hours).select("id", F.col("collected_at").alias("at"), _block(block).alias("block"), F.coalesce("embedding", made).alias("vector"))


def _block(name: str | None) -> Column:
    return F.lit(0) if name is None else F.col(name)


def assigned(due: DataFrame, news: DataFrame, clusters: DataFrame, as_of, hours: int, rules: Rules, block: str | None = None) -> DataFrame:
    """(id, vector, leader) of the articles ``encoded``.  A cluster's id is that of the article that
    founded it.  ``block`` names a column of news within which articles are clustered; without
    one all are a single sequence, as the result depends on their order."""
    live = C.recent(clusters, as_of, hours, "updated_at").select("cluster_id")
    members = news.where("cluster_id is not null").withColumn("block", _block(block)).join(live, "cluster_id", "left_semi")
    where = members.groupBy("cluster_id").agg(F.min("block").alias("block"))
    existing = C.totals(members, "cluster_id").join(where, "cluster_id").withColumnRenamed("cluster_id", "leader")
    found = C.leader_clusters(due, rules.threshold, "at", "id", "block", "vector", existing)
    return due.select("id", "vector").join(found.select("id", "leader"), "id")


def attached(news: DataFrame, found: DataFrame) -> DataFrame:
    """``news`` with clusters and vectors of this run, and one primary article per cluster."""
    out = news.join(found, "id", "left").withColumns({"cluster_id": F.coalesce("leader", "cluster_id"), "embedding": F.coalesce("embedding", "vector")})
    return _shaped(C.with_primary(out), NEWS)


def grown(clusters: DataFrame, news: DataFrame, found: DataFrame, as_of) -> DataFrame:
    """Clusters with those founded and changed in this run."""
    changed = found.select(F.col("leader").alias("cluster_id")).distinct()
    now = news.join(changed, "cluster_id", "left_semi").groupBy("cluster_id").agg(
        F.count("embedding").alias("_size"), F.max(F.when(F.col("is_primary"), F.nullif("title", F.lit("")))).alias("_title")
    )
    out = clusters.join(now, "cluster_id", "full")
    hit, at = F.col("_size").isNotNull(), F.lit(as_of).cast("timestamp")
    new = {
        "title": F.coalesce("_title", "title"), "cluster_size": F.coalesce("_size", "cluster_size"), "status": F.coalesce("status", F.lit("new")),
        "created_at": F.coalesce("created_at", at), "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
    }
    return _shaped(out.withColumns(new), CLUSTERS)


def summarised(clusters: DataFrame, news: DataFrame, as_of, rules: Rules) -> DataFrame:
    """Clusters without a summary get one of their first five articles' texts, and its title.  A
    cluster without any text stays without; one without fit sentences gets ''."""
    due = L.to_summarize(clusters).select("cluster_id")
    mine = news.join(due, "cluster_id", "left_semi")
    part = F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif(F.substring("text", 1, MOST_MEMBER_CHARS), F.lit("")))
    parts = mine.select("cluster_id", "is_primary", "published_at", "collected_at", "id", part.alias("t"))
    texts = C.ranked_members(parts).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rn", "t"))).alias("m"))
    texts = texts.select("cluster_id", F.array_join(F.transform("m", lambda x: x["t"]), "\n").alias("text")).where("trim(text) <> ''")
    titles = C.titles(mine)
    made = S.text_summaries(texts.join(titles, "cluster_id"), "cluster_id", rules.sentences, rules.most_chars).join(titles.withColumnRenamed("title", "_title"), "cluster_id")
    out = clusters.join(made, "cluster_id", "left")
    hit = F.col("summary").isNotNull()
    new = {"summary_text": F.coalesce("summary", "summary_text"), "title": F.when(hit, F.coalesce("_title", "title")).otherwise(F.col("title")), "updated_at": F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))}
    return _shaped(out.withColumns(new), CLUSTERS)


def tagged(clusters: DataFrame, news: DataFrame, as_of, rules: Rules, again: bool = False) -> DataFrame:
    """Clusters due for tags get them and a state; with ``again`` all that have a summary.  What was
    published stays so."""
    encode = rules.encode or V.encoder()
    due = L.to_tag(clusters, again)
    members = C.ranked_members(news.join(due.select("cluster_id"), "cluster_id", "left_semi"), most=None)
    texts = G.filter_text(members, due).join(G.has_content(members), "cluster_id", "left")
    rows = staged(G.prepared(texts.withColumn("vector", encode(F.col("tag_text"))), rules.foreign, rules.home, rules.banned), "tagged")
    chosen = G.selected(G.scored(rows, list(rules.tags), "cluster_id"), "cluster_id", rules.least_score).select("cluster_id", F.array_join("tags", ", ").alias("_tags"))
    state = rows.select("cluster_id", "has_content", "foreign", "home", "banned").join(chosen, "cluster_id", "left")
    state = state.select("cluster_id", "_tags", G.decision(F.col("foreign"), F.col("home"), F.col("has_content"), F.col("banned"), F.col("_tags")).alias("_state"))
    out = clusters.join(state, "cluster_id", "left")
    new: dict[str, Column] = {
        "tags": F.when(F.col("_state") == "ready", F.col("_tags")).otherwise(F.col("tags")), "status": F.when(F.col("status") == "published", F.col("status")).otherwise(F.coalesce("_state", "status")),
        "updated_at": F.when(F.col("_state").isNotNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at")),
    }
    return _shaped(out.withColumns(new), CLUSTERS)


def run(news: DataFrame, clusters: DataFrame, articles: DataFrame, sources: DataFrame, as_of, folder: str, rules: Rules, hours: int = 6, block: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new snapshots of news and clusters, and the posts that are due.  After sending posts the
    caller applies ``lifecycle.published``."""
    kept = _written(stored(_shaped(news, NEWS), articles, sources, rules), f"{folder}/stored")
    clusters = _shaped(clusters, CLUSTERS)
    due = _written(encoded(kept, as_of, hours, rules, block), f"{folder}/encoded")
    found = _written(assigned(due, kept, clusters, as_of, hours, rules, block), f"{folder}/assigned")
    news = _written(attached(kept, found), f"{folder}/news")
    step = _written(grown(clusters, news, found, as_of), f"{folder}/grown")
    step = _written(summarised(step, news, as_of, rules), f"{folder}/summarised")
    clusters = _written(tagged(step, news, as_of, rules), f"{folder}/clusters")
    return news, clusters, _written(L.posts(L.ready(clusters, rules.most_posts), news), f"{folder}/posts")
