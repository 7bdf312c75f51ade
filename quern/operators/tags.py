"""Tags by vectors and keywords, and the decision to publish."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import plain as P
from quern.functions import text as T
from quern.functions.vectors import cosine

BOOST, MOST_BOOST, PENALTY, MOST_PENALTY = 0.03, 0.09, 0.05, 0.15


def keyword_count(text: Column, keywords: Column) -> Column:
    """Entries of the list that the text contains; an entry listed twice counts twice."""
    return F.size(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: (k != "") & F.contains(text, k)))


def boost(text: Column, keywords: Column) -> Column:
    return F.least(BOOST * keyword_count(text, keywords), F.lit(MOST_BOOST))


def penalty(text: Column, keywords: Column) -> Column:
    return F.least(PENALTY * keyword_count(text, keywords), F.lit(MOST_PENALTY))


def scored(rows: DataFrame, tags: list[dict], id_: str, with_penalty: bool = True) -> DataFrame:
    """(id, tag, ord, embedding_score, keyword_boost, keyword_penalty, final_score) of rows (id,
    text normalised, vector) for a list of tags {tag, vector, positive, negative}; the list is
    fixed and small, so it becomes a literal array that each row is exploded over."""
    kind = "array<struct<ord:int,tag:string,vector:array<double>,positive:array<string>,negative:array<string>>>"
    lists = lambda xs, t: F.array(*map(F.lit, xs)).cast(f"array<{t}>")
    held = F.array(*[F.struct(F.lit(i), F.lit(t["tag"]), lists(t["vector"], "double"), lists(t["positive"], "string"), lists(t["negative"], "string")) for i, t in enumerate(tags)]).cast(kind)
    df = rows.select(id_, "text", "vector", F.explode(held).alias("t"))
    df = df.select(id_, F.col("t.tag").alias("tag"), F.col("t.ord").alias("ord"), cosine(F.col("vector"), F.col("t.vector")).alias("embedding_score"), boost(F.col("text"), F.col("t.positive")).alias("keyword_boost"), penalty(F.col("text"), F.col("t.negative")).alias("keyword_penalty"))
    less = F.col("keyword_penalty") if with_penalty else F.lit(0.0)
    return df.withColumn("final_score", F.round(F.col("embedding_score") + F.col("keyword_boost") - less, 9))


def embedded(tags: DataFrame, encode) -> list[dict]:
    """The tags {tag, vector, positive, negative}, in order of ``ord``, with vectors of their descriptions;
    ``tags``: (ord, tag, description, positive, negative), a small table made by hand, one row per tag."""
    rows = tags.select("ord", "tag", encode(F.col("description")).alias("vector"), "positive", "negative").orderBy("ord").collect()
    return [dict(tag=r["tag"], vector=list(r["vector"]), positive=list(r["positive"] or []), negative=list(r["negative"] or [])) for r in rows]


def foreign_of_sources(members: DataFrame, clusters: DataFrame, sources: list[str], markers: list[str], most: int = 1000) -> DataFrame:
    """(cluster_id, hit): whether a cluster has a member of one of the sources and its title, summary or
    members' titles and beginnings name one of the markers."""
    part = F.concat_ws(" ", "title", F.substring("text", 1, most))
    texts = members.groupBy("cluster_id").agg(F.max(F.coalesce(F.col("source").isin(sources), F.lit(False))).alias("theirs"), F.max(T.contains_any(F.lower(part), [m.lower() for m in markers])).alias("named"))
    own = T.contains_any(F.lower(F.concat_ws(" ", "title", "summary_text")), [m.lower() for m in markers])
    out = clusters.join(texts, "cluster_id", "left")
    return out.select("cluster_id", (F.coalesce("theirs", F.lit(False)) & (F.coalesce("named", F.lit(False)) | own)).alias("hit"))


def selected(scores: DataFrame, id_: str, least: float = 0.35, most: int = 2, gap: float | None = 0.05) -> DataFrame:
    """(id, tags): tags of enough score and near the best one, the best ``most``, list order on ties."""
    best = F.max("final_score").over(Window.partitionBy(id_))
    ok = scores.withColumn("_best", best).where(F.col("final_score") >= least)
    if gap is not None:
        ok = ok.where(F.col("_best") - F.col("final_score") <= gap)
    ok = ok.withColumn("rn", F.row_number().over(Window.partitionBy(id_).orderBy(F.col("final_score").desc(), "ord"))).where(F.col("rn") <= most)
    return ok.groupBy(id_).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "tag"))), lambda x: x["tag"]).alias("tags"))


def filter_text(members: DataFrame, clusters: DataFrame, most: int = 5) -> DataFrame:
    """(cluster_id, filter_text, tag_text): the texts that markers and tags are looked up in."""
    def texts(squeezed: Column) -> Column:
        cut = lambda n: F.nullif(T.cut_squeezed(squeezed, n), F.lit(""))
        one = F.concat_ws(" ", F.nullif("title", F.lit("")), cut(4000), F.nullif("url", F.lit("")))
        own = F.when((F.col("rn") == 1) | F.col("is_primary"), cut(5000)).otherwise(cut(2500))
        head = F.nullif(T.cut_text(F.col("title"), 500), F.lit(""))
        return F.struct("rn", one.alias("f"), F.concat_ws("\n", head, head, own).alias("t"))

    member = T.let(T.squeezed(F.coalesce("text", F.lit(""))), texts)
    parts = members.where(F.col("rn") <= most).select("cluster_id", member.alias("m")).groupBy("cluster_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    title, summary = F.nullif("title", F.lit("")), F.nullif("summary_text", F.lit(""))
    h, s = T.cut_text(title, 500), T.cut_text(summary, 1500)
    full = F.concat_ws(" ", title, summary, F.array_join(F.transform("m", lambda x: x["f"]), " "))
    tags = F.concat_ws("\n", *[F.nullif(h, F.lit(""))] * 3, *[F.nullif(s, F.lit(""))] * 2, F.array_join(F.transform("m", lambda x: x["t"]), "\n"))
    return clusters.join(parts, "cluster_id", "left").select("cluster_id", F.lower(full).alias("filter_text"), tags.alias("tag_text"))


def prepared(texts: DataFrame, foreign: Sequence[str], home: Sequence[str], banned: Sequence[str]) -> DataFrame:
    """(cluster_id, text, vector, has_content, foreign, home, banned) of ``filter_text``'s rows with the last two before
    them: the tag text normalised, and whether the filter text, normalised, contains a marker of each list."""
    lists = {"foreign": T.prepared_markers(foreign), "home": T.prepared_markers(home), "banned": T.prepared_markers(banned)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tag = pa.array([P.normalize_filter_text(t) for t in batch.column("tag_text").to_pylist()], pa.string())
            low = [P.normalize_filter_text(t) for t in batch.column("filter_text").to_pylist()]
            hits = [pa.array([any(m in t for m in markers) for t in low], pa.bool_()) for markers in lists.values()]
            yield pa.RecordBatch.from_arrays([batch.column("cluster_id"), tag, batch.column("vector"), batch.column("has_content"), *hits], names=["cluster_id", "text", "vector", "has_content", *lists])

    kind = texts.select("cluster_id").schema["cluster_id"].dataType.simpleString()
    schema = f"cluster_id {kind}, text string, vector array<double>, has_content boolean, foreign boolean, home boolean, banned boolean"
    return texts.select("cluster_id", "tag_text", "filter_text", "vector", "has_content").mapInArrow(run, schema)


def has_content(members: DataFrame, least: int = 200) -> DataFrame:
    ok = (F.coalesce("title", F.lit("")) != "") & (F.length(T.stripped(F.coalesce("text", F.lit("")))) > least)
    return members.groupBy("cluster_id").agg(F.max(ok).alias("has_content"))


def decision(foreign: Column, home: Column, content: Column, banned: Column, tags: Column) -> Column:
    """ready or not_for_publication: foreign news without a tie to home, thin or banned ones and
    those without a tag are not published."""
    no = (foreign & ~home) | ~F.coalesce(content, F.lit(False)) | banned | tags.isNull()
    return F.when(no, "not_for_publication").otherwise("ready")
