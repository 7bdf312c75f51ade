"""The registered queries over the fixtures, with DuckDB SQL where SQL can express them.

The fixtures hold no Russian, so needles and tags are words of the fixtures; the Russian lists are
covered by the tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.functions import vectors as V
from quern.operators import articles as A
from quern.operators import clusters as C
from quern.operators import lifecycle as L
from quern.operators import summaries as S
from quern.operators import tags as G
from quern.plans import periodic
from quern.plans.shared import new_path
from quern.plans.views import CLUSTERS_SQL, EPOCH, NEWS_SQL, clusters, news, table
from quern.sources import html as H
from quern.sources import tables

TITLES, URLS, CONTENT = ["anesle", "der "], ["/es/"], ["token =", "worthless"]


def valid() -> Column:
    return A.is_valid(TITLES, URLS, CONTENT)


def _contains(col: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains(replace(lower({col}), 'ё', 'е'), '{n}')" for n in needles) + ")"


VALID_SQL = f"(title <> '' AND url <> '' AND length(text) >= 250 AND NOT ({_contains('title', TITLES)} OR {_contains('url', URLS)} OR {_contains('text', CONTENT)}))"
KEY_SQL = "trim(regexp_replace(lower(text), '[^а-яёa-z0-9]+', ' ', 'g'))"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"WITH {NEWS_SQL} SELECT id, source FROM news WHERE {VALID_SQL}")
def news_filter_valid(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).where(valid()).select("id", "source")


@query(f"WITH {NEWS_SQL} SELECT source, count(*) AS collected, count(*) FILTER ({VALID_SQL}) AS kept, count(*) FILTER (NOT {VALID_SQL}) AS removed FROM news GROUP BY source")
def news_filter_report(spark: SparkSession, d: str) -> DataFrame:
    return A.filter_report(news(spark, d), valid())


@query(f"WITH {NEWS_SQL} SELECT id, source, title FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY collected_at, id) AS rn FROM news) WHERE rn = 1")
def title_key_dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return A.first_wins(news(spark, d), T.key_of(F.col("text")), [F.col("collected_at"), F.col("id")]).select("id", "source", "title")


@query(f"""WITH {NEWS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY collected_at, id) AS rn FROM news WHERE {VALID_SQL})
SELECT source, count(*) AS articles, min(id) AS first_id, max(length(text)) AS longest FROM f WHERE rn = 1 GROUP BY source""")
def news_ingest_report(spark: SparkSession, d: str) -> DataFrame:
    kept = A.first_wins(news(spark, d).where(valid()), T.key_of(F.col("text")), [F.col("collected_at"), F.col("id")])
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("articles"), F.min("id").alias("first_id"), F.max(F.length("text")).alias("longest"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def url_anti_join_known(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    return A.unknown(pages, pages.where("page_id % 2 = 0")).select("page_id", "url")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select(F.col("source").alias("name")).distinct()
    return names.select(F.crc32(F.col("name").cast("binary")).alias("id"), "name", F.concat(F.lit("https://"), "name").alias("url"), F.endswith("name", F.lit("1")).alias("is_active"))


@query("SELECT source, count(*) AS n FROM documents WHERE source LIKE '%1' GROUP BY source")
def source_inner_join(spark: SparkSession, d: str) -> DataFrame:
    active = _sources(spark, d).where("is_active").select(F.col("name").alias("source"))
    return table(spark, d, "documents").select("source").join(active, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT name, CASE WHEN name LIKE '%2' OR name = 'extra' THEN 'https://new.' || name ELSE 'https://' || name END AS url, name LIKE '%1' OR name LIKE '%2' OR name = 'extra' AS is_active
FROM (SELECT DISTINCT source AS name FROM documents UNION ALL SELECT 'extra')""")
def source_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = _sources(spark, d)
    names = old.where(F.endswith("name", F.lit("2"))).select("name").unionByName(spark.createDataFrame([("extra",)], "name string"))
    new = names.select("name", F.concat(F.lit("https://new."), "name").alias("url"), F.lit(True).alias("is_active"))
    return A.upserted(old, new).select("name", "url", "is_active")


@query(f"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM s), k AS (SELECT *, {KEY_SQL.replace('text', 's')} AS k FROM t WHERE length(s) >= 20),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM k)
SELECT doc_id, md5(string_agg(s, ' ' ORDER BY i)) AS text_md5, length(string_agg(s, ' ' ORDER BY i)) AS n_chars FROM f WHERE rn = 1 GROUP BY doc_id""")
def sentence_split_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "documents").select("doc_id", T.remove_duplicate_sentences(F.col("text")).alias("t")).where("t <> ''")
    return out.select("doc_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


CUTS = ["worthless", "von der", "pour le"]
_POS = ", ".join(f"nullif(strpos(lower(text), '{c}'), 0)" for c in CUTS)


@query(f"SELECT doc_id, md5({SQUEEZE.format(f'CASE WHEN least({_POS}) IS NULL THEN text ELSE substr(text, 1, least({_POS}) - 1) END')}) AS text_md5 FROM documents")
def boilerplate_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.remove_boilerplate(F.col("text"), CUTS).cast("binary")).alias("text_md5"))


_CONTACT_TEXT = "regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E\\t\\r\\n]', '~', 'g')"


@query(f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_CONTACT_TEXT}, '\\+?[0-9][0-9\\s().-]{{7,}}[0-9]', ' ', 'g'),
'[\\w.-]+@[\\w.-]+\\.\\w+', ' ', 'g'), '\\bwww\\.[^\\s]+', ' ', 'g'), '\\bhttps?://[^\\s]+', ' ', 'g'), 'zzz', ' ', 'g'), 'zzz', ' ', 'g'), '(?i)\\be-mail:?', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM documents""")
def contacts_removed(spark: SparkSession, d: str) -> DataFrame:
    """Over texts whose characters beyond ASCII are masked: RE2's word classes are ASCII where the rule's are
    Unicode, so only then do both mean the same."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E\t\r\n]", "~")
    return table(spark, d, "documents").select("doc_id", F.md5(T.remove_contacts(plain).cast("binary")).alias("text_md5"))


_HIGH = [i for i in range(0x80, 0x100) if i != 0x98]
_WRONG, _RIGHT = "".join(map(chr, _HIGH)), bytes(_HIGH).decode("cp1251")


@query(f"SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[ÌÎÁÂÃÄÅÆÇÈÉ]') AND NOT regexp_matches(text, '[^\\x{{00}}-\\x{{FF}}]') THEN translate(text, '{_WRONG}', '{_RIGHT}') ELSE text END) AS text_md5 FROM documents")
def encoding_repair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.fix_encoding(F.col("text")).cast("binary")).alias("text_md5"))


_REPAIRED = "CASE WHEN regexp_matches({0}, '[ÌÎÁÂÃÄÅÆÇÈÉ]') AND NOT regexp_matches({0}, '[^\\x{{00}}-\\x{{FF}}]') THEN translate({0}, '" + _WRONG + "', '" + _RIGHT + "') ELSE {0} END"


@query(f"""WITH {NEWS_SQL}, a AS (SELECT id, title, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({_REPAIRED.format('title')}, chr(160), ' '), chr(8203), ''), chr(65279), ''), '…', '...'), '« ', '«'), ' »', '»'), '\\s+', ' ', 'g'), ' +([,.!?;:])', '\\1', 'g')) AS t FROM news),
b AS (SELECT id, title, trim(regexp_replace(t, '^[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}\\s*[-–—]\\s*', ''), ' -' || chr(8212)) AS t FROM a),
c AS (SELECT id, title, CASE WHEN length(t) > 180 THEN trim(regexp_extract(t, '^(.*?[.!?])(\\s|$)', 1)) ELSE t END AS cut, t FROM b),
e AS (SELECT id, title, CASE WHEN length(t) > 180 AND cut = '' THEN t ELSE cut END AS t FROM c)
SELECT id, CASE WHEN length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) > 0.8 * length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) THEN upper(substr(t, 1, 1)) || lower(substr(t, 2)) ELSE t END AS title,
  round(length(regexp_replace(title, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(title, '[^\\p{{L}}]', '', 'g')), 0)::DOUBLE, 6) AS upper_ratio FROM e""")
def title_normalize(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).select("id", T.normalize_title(F.col("title"), F.col("source")).alias("title"), F.round(T.upper_ratio(F.col("title")), 6).alias("upper_ratio"))


@query("""SELECT page_id, replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'www.', '') AS domain, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path,
contains(lower(url), '.html') AND NOT contains(url, '#') AS article FROM pages""")
def url_domain_path(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", U.domain(url).alias("domain"), U.path(url).alias("path"), U.is_probably_article(url, parts=[".html"], bad=["#"]).alias("article"))


@query()
def html_articles(spark: SparkSession, d: str) -> DataFrame:
    return H.articles(table(spark, d, "pages")).select("page_id", "title", "text_source", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site, regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<!--.*?-->|<style.*?</style>', '', 'g'), '(?s)<a [^>]*href="[^"]+"[^>]*>.*?</a>') AS found FROM pages),
b AS (SELECT page_id, site, unnest(found) AS x, generate_subscripts(found, 1) AS pos FROM a),
c AS (SELECT page_id, site, pos, regexp_extract(x, 'href="([^"]+)"', 1) AS href, trim(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' +([,.!?;:])', '\\1', 'g'), ' -' || chr(8212)) AS title FROM b),
d AS (SELECT page_id, pos, site, title, split_part(CASE WHEN href LIKE '/%' THEN site || href ELSE href END, '#', 1) AS url FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS again FROM d WHERE regexp_extract(url, '^[a-z]+://[^/?#]*') = site AND length(title) >= 2)
SELECT page_id, n, url, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM e WHERE again = 1) WHERE n <= 5""")
def html_links_topk_per_page(spark: SparkSession, d: str) -> DataFrame:
    return H.previews(H.links(table(spark, d, "pages")), limit=5, least_title=2)


ORDER_SQL = "is_primary DESC NULLS FIRST, published_at NULLS LAST, collected_at, id"


@query(f"WITH {NEWS_SQL} SELECT cluster_id, id, rn FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {ORDER_SQL}) AS rn FROM news) WHERE rn <= 3")
def members_ranked(spark: SparkSession, d: str) -> DataFrame:
    return C.ranked_members(news(spark, d), most=3).select("cluster_id", "id", "rn")


@query(f"WITH {NEWS_SQL} SELECT cluster_id, first(id ORDER BY published_at IS NULL, coalesce(published_at, collected_at), id) AS id FROM news GROUP BY cluster_id")
def representative_per_group(spark: SparkSession, d: str) -> DataFrame:
    return C.representatives(news(spark, d))


@query(f"WITH {NEWS_SQL} SELECT cluster_id, first(title ORDER BY NOT is_primary, published_at NULLS LAST, collected_at, id) FILTER (title <> '') AS title FROM news GROUP BY cluster_id")
def cluster_titles(spark: SparkSession, d: str) -> DataFrame:
    return C.titles(news(spark, d))


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'purchase' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def recent_window_unclustered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    as_of = e.agg(F.max("ts")).first()[0]
    return C.recent(e.where("event_type <> 'purchase'"), as_of, 48, "ts").select("event_id", "user_id")


_MEANS = """m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)"""


@query(f"WITH {_MEANS} SELECT label, (i - 1)::INTEGER AS i, round(m / n, 6) AS x FROM m JOIN n USING (label)")
def centroid_per_label(spark: SparkSession, d: str) -> DataFrame:
    return C.centroids(table(spark, d, "embeddings"), "label").select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query(f"""WITH {_MEANS}, c AS (SELECT label AS center, list(m / n ORDER BY i) AS c FROM m JOIN n USING (label) GROUP BY label),
s AS (SELECT vec_id, center, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS score FROM embeddings, c)
SELECT vec_id, CASE WHEN score >= 0.3 THEN center END AS center, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, center) AS rn FROM s) WHERE rn = 1""")
def nearest_centroid_assign(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    centers = C.centroids(e, "label").select(F.col("label").alias("ord"), F.col("label").alias("center"), "centroid")
    return C.nearest(e, centers, 0.3, "vec_id").select("vec_id", "center", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(e.v, q.v), 9) AS score FROM e JOIN e q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query, id, rn, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM s) WHERE rn <= 5""")
def pairwise_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of all vectors for each stated query: every vector whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    return C.most_similar(e, e.where("vec_id % 100 = 0"), 5, "vec_id").select("query", "id", "rn", F.round("score", 6).alias("score"))


def _leaders(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumns({"at": F.col("vec_id"), "every": F.lit("all")})
    return C.leader_clusters(rows, threshold, "at", "vec_id", "every").select("vec_id", "leader", F.round("score", 6).alias("score"))


def _leaders_sql(threshold: float) -> str:
    """One vector after the other: the state is a list of clusters with the sum of their vectors."""
    return f"""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS vec_id, NULL::BIGINT AS leader, 0.0::DOUBLE AS score, []::STRUCT(id BIGINT, s DOUBLE[])[] AS state
UNION ALL SELECT i, vec_id, CASE WHEN hit THEN state[best].id ELSE vec_id END, greatest(top, 0.0),
  CASE WHEN hit THEN list_transform(state, lambda c, k: CASE WHEN k = best THEN struct_pack(id := c.id, s := list_transform(list_zip(c.s, v), lambda p: p[1] + p[2])) ELSE c END) ELSE list_append(state, struct_pack(id := vec_id, s := v)) END
FROM (SELECT *, coalesce(best > 0 AND top > 0 AND top >= {threshold}, false) AS hit FROM (SELECT e.i, e.vec_id, v, state, coalesce(list_max(scores), 0.0) AS top, coalesce(list_position(scores, list_max(scores)), 0) AS best
  FROM (SELECT e.*, w.state, list_transform(w.state, lambda c: list_cosine_similarity(c.s, e.v)) AS scores FROM walk w JOIN e ON e.i = w.i + 1) e)))
SELECT vec_id, leader, round(score, 6) AS score FROM walk WHERE i > 0"""


@query(_leaders_sql(0.3))
def leader_clustering_t03(spark: SparkSession, d: str) -> DataFrame:
    return _leaders(spark, d, 0.3)


@query(_leaders_sql(0.7))
def leader_clustering_t07(spark: SparkSession, d: str) -> DataFrame:
    return _leaders(spark, d, 0.7)


_TFIDF = """t AS (SELECT lang, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}') AS w FROM documents),
x AS (SELECT lang, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
tf AS (SELECT lang, doc_id, term, count(*) AS tf FROM x GROUP BY ALL), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
df AS (SELECT lang, term, count(*) AS df, any_value(n) AS n FROM tf JOIN n USING (lang) GROUP BY lang, term HAVING count(*) <= any_value(n) * 0.95),
w AS (SELECT lang, doc_id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (lang, term)),
z AS (SELECT *, round(w / sqrt(sum(w * w) OVER (PARTITION BY lang, doc_id)), 9) AS weight FROM w)"""


@query(f"WITH {_TFIDF} SELECT lang, doc_id, term, rn, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang, doc_id ORDER BY weight DESC, term) AS rn FROM z) WHERE rn <= 3")
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    top = S.top_tfidf(table(spark, d, "documents"), "lang", "doc_id", 3)
    return top.select("lang", "doc_id", "term", "rn", F.round("weight", 6).alias("weight"))


@query(f"""WITH {NEWS_SQL}, c AS (SELECT cluster_id AS lang, id AS doc_id, text FROM news), {_TFIDF.replace('FROM documents', 'FROM c')},
u AS (SELECT lang, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY lang, doc_id)) AS weight FROM w)
SELECT a.lang AS cluster_id, a.doc_id AS a, b.doc_id AS b, round(sum(a.weight * b.weight), 6) AS cosine FROM u a JOIN u b ON a.lang = b.lang AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING sum(a.weight * b.weight) > 0""")
def member_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike the (five) members of each cluster are, by TF-IDF within the cluster."""
    return S.similar_texts(news(spark, d), "cluster_id", "id").where("cosine > 0").select("cluster_id", "a", "b", F.round("cosine", 6).alias("cosine"))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return S.text_summaries(news(spark, d), "id")


@query()
def textrank_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summaries(spark, d)


TAGS = [("trade", [1.0, 0.0], ["tion", "ment", "tion"], ["der"]), ("power", [0.6, 0.8], ["heit", "keit", "th"], ["que"]), ("metal", [0.0, 1.0], ["que", "eau", "los", "de"], ["the "])]
#: A vector of each text's own, that any SQL engine can make.
_VECTOR = ("cast(id % 7 + 1 AS double)", "cast(length(text) % 5 + 0.5 AS double)")
_VECTOR_SQL = "[(id % 7 + 1)::DOUBLE, length(text) % 5 + 0.5::DOUBLE]"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    rows = news(spark, d).select("id", T.lemmatized(F.col("text")).alias("text"), F.array(*map(F.expr, _VECTOR)).alias("vector"))
    return G.scored(rows, [dict(tag=t, vector=v, positive=p, negative=n) for t, v, p, n in TAGS], "id")


_N = "trim(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), '[^а-яa-z0-9\\-. ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_COUNT = lambda ks: " + ".join(f"contains(t, '{k}')::INTEGER" for k in ks)
_SCORES = f"{NEWS_SQL}, t AS (SELECT id, {_VECTOR_SQL} AS v, {_N} AS t FROM news), s AS (" + " UNION ALL ".join(
    f"SELECT id, '{t}' AS tag, {i} AS ord, list_cosine_similarity(v, {v}::DOUBLE[]) AS embedding_score, least(0.03 * ({_COUNT(p)}), 0.09)::DOUBLE AS keyword_boost, least(0.05 * ({_COUNT(n)}), 0.15)::DOUBLE AS keyword_penalty FROM t"
    for i, (t, v, p, n) in enumerate(TAGS)
) + "), z AS (SELECT *, round(embedding_score + keyword_boost - keyword_penalty, 6) AS final_score FROM s)"


@query(f"WITH {_SCORES} SELECT id, tag, round(embedding_score, 6)::DOUBLE AS embedding_score, round(keyword_boost, 6) AS keyword_boost, round(keyword_penalty, 6) AS keyword_penalty, final_score::DOUBLE AS final_score FROM z")
def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("id", "tag", *(F.round(c, 6).alias(c) for c in ("embedding_score", "keyword_boost", "keyword_penalty", "final_score")))


@query(f"""WITH {_SCORES}, b AS (SELECT *, max(final_score) OVER (PARTITION BY id) AS best FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY final_score DESC, ord) AS rn FROM b WHERE final_score >= 0.35 AND round(best - final_score, 6) <= 0.05)
SELECT id, string_agg(tag, ', ' ORDER BY rn) AS tags FROM r WHERE rn <= 2 GROUP BY id""")
def tag_select_gap(spark: SparkSession, d: str) -> DataFrame:
    scores = _scores(spark, d).withColumn("final_score", F.round("final_score", 6).cast("decimal(10,6)"))
    return G.selected(scores, "id").select("id", F.array_join("tags", ", ").alias("tags"))


FOREIGN, HOME, BANNED = ["worthless", "idiot"], ["the", "und"], ["token"]


@query(f"""WITH {NEWS_SQL}, {CLUSTERS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {ORDER_SQL}) AS rn FROM news),
p AS (SELECT cluster_id, string_agg(concat_ws(' ', nullif(title, ''), nullif(trim(substr({SQUEEZE.format('text')}, 1, 4000)), ''), url), ' ' ORDER BY rn) AS f, bool_or(title <> '' AND length(trim(text, {BLANKS})) > 200) AS has_content FROM m GROUP BY cluster_id),
x AS (SELECT c.cluster_id, has_content, tags, {_N.replace('text', "concat_ws(' ', nullif(c.title, ''), nullif(summary_text, ''), f)")} AS t FROM clusters c LEFT JOIN p USING (cluster_id))
SELECT cluster_id, CASE WHEN ({' OR '.join(f"contains(t, '{k}')" for k in FOREIGN)}) AND NOT ({' OR '.join(f"contains(t, '{k}')" for k in HOME)}) OR NOT coalesce(has_content, false) OR contains(t, 'token') OR tags IS NULL THEN 'not_for_publication' ELSE 'ready' END AS decision FROM x""")
def publish_decision(spark: SparkSession, d: str) -> DataFrame:
    n, c = C.ranked_members(news(spark, d), most=None), clusters(spark, d)
    texts = G.filter_text(n, c).join(G.has_content(n), "cluster_id", "left").join(c.select("cluster_id", "tags"), "cluster_id")
    hit = lambda words: F.size(T.marker_matches(F.col("t"), words)) > 0
    texts = texts.withColumn("t", T.lemmatized(F.col("filter_text")))
    return texts.select("cluster_id", G.decision(hit(FOREIGN), hit(HOME), F.col("has_content"), hit(BANNED), F.col("tags")).alias("decision"))


@query(f"""WITH {NEWS_SQL}, {CLUSTERS_SQL}, m AS (SELECT cluster_id, first(url ORDER BY {ORDER_SQL}) AS url FROM news GROUP BY cluster_id)
SELECT cluster_id, CASE WHEN title <> '' THEN title ELSE 'Новость промышленности' END AS post_title,
trim(coalesce(summary_text, '') || chr(10) || chr(10) || 'Источник: ' || url || CASE WHEN tags IS NULL THEN '' ELSE chr(10) || chr(10) || '#heavy_industry #up_stream' END, chr(10) || chr(9) || chr(13) || ' ') AS body FROM clusters JOIN m USING (cluster_id)""")
def post_render(spark: SparkSession, d: str) -> DataFrame:
    return L.posts(clusters(spark, d), news(spark, d))


@query(f"WITH {NEWS_SQL} SELECT id, CASE WHEN source LIKE '%1' THEN source ELSE 'unknown' END AS source_name FROM news")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    """Articles with the names of active sources, the others with a default."""
    active = tables.active(_sources(spark, d))
    return C.with_source(news(spark, d).withColumn("source_id", F.crc32(F.col("source").cast("binary"))), active, "unknown").select("id", "source_name")


@query(f"""WITH {NEWS_SQL}, m AS (SELECT id, list_filter(['worthless', 'the token', 'und', 'the ', 'idiot'], lambda k: contains({_N}, trim(k))) AS hits FROM news)
SELECT id, array_to_string(list_sort(hits), '|') AS markers FROM (SELECT id, list_transform(hits, lambda k: trim(k)) AS hits FROM m) WHERE len(hits) > 0""")
def marker_matches(spark: SparkSession, d: str) -> DataFrame:
    hits = T.marker_matches(T.lemmatized(F.col("text")), ["worthless", "the token", "und", "the ", "idiot"])
    found = F.explode(F.filter(F.array(hits), lambda h: F.size(h) > 0))  # a filter on a column would work the hits out twice
    return news(spark, d).select("id", found.alias("hits")).select("id", F.array_join(F.array_sort("hits"), "|").alias("markers"))


@query(f"""WITH {NEWS_SQL}, t AS (SELECT id, {_N.replace('text', 'title')} AS t FROM news)
SELECT id FROM t WHERE ({' OR '.join(f"contains(t, '{k}')" for k in FOREIGN)}) AND NOT ({' OR '.join(f"contains(t, '{k}')" for k in HOME)})""")
def foreign_titles(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).where(T.is_foreign_title(F.col("title"), FOREIGN, HOME)).select("id")


@query(f"WITH {NEWS_SQL}, {CLUSTERS_SQL} SELECT cluster_id, status FROM clusters ORDER BY created_at DESC, cluster_id DESC LIMIT 20")
def newest_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.newest(clusters(spark, d)).select("cluster_id", "status")


@query(f"WITH {NEWS_SQL}, {CLUSTERS_SQL} SELECT cluster_id, created_at FROM clusters WHERE status = 'ready' AND summary_text IS NOT NULL ORDER BY created_at, cluster_id LIMIT 30")
def ready_topk(spark: SparkSession, d: str) -> DataFrame:
    return L.ready(clusters(spark, d)).select("cluster_id", "created_at")


@query(f"WITH {NEWS_SQL}, {CLUSTERS_SQL} SELECT cluster_id FROM clusters WHERE status = 'not_for_publication' AND updated_at < TIMESTAMP '{EPOCH}' + INTERVAL 10 HOUR - INTERVAL 2 HOUR")
def cleanup_victims(spark: SparkSession, d: str) -> DataFrame:
    as_of = spark.sql(f"SELECT TIMESTAMP '{EPOCH}' + INTERVAL 10 HOURS AS t").first()[0]
    return L.victims(clusters(spark, d), as_of, 2).select("cluster_id")


_VICTIMS_SQL = f"SELECT cluster_id FROM clusters WHERE status = 'not_for_publication' AND updated_at < TIMESTAMP '{EPOCH}' + INTERVAL 8 HOUR"


def _as_of(spark: SparkSession):
    return spark.sql(f"SELECT TIMESTAMP '{EPOCH}' + INTERVAL 10 HOURS AS t").first()[0]


@query(f"WITH {NEWS_SQL}, {CLUSTERS_SQL}, v AS ({_VICTIMS_SQL}) SELECT id, cluster_id FROM news WHERE cluster_id NOT IN (SELECT cluster_id FROM v)")
def news_after_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return L.cleaned(clusters(spark, d), news(spark, d), _as_of(spark), 2)[1].select("id", "cluster_id")


@query(f"WITH {NEWS_SQL}, {CLUSTERS_SQL}, v AS ({_VICTIMS_SQL}) SELECT (SELECT count(*) FROM v) AS clusters, (SELECT count(*) FROM news JOIN v USING (cluster_id)) AS news")
def cleanup_report(spark: SparkSession, d: str) -> DataFrame:
    return L.cleanup_report(clusters(spark, d), news(spark, d), _as_of(spark), 2)


@query(f"WITH {NEWS_SQL} SELECT id FROM news WHERE NOT coalesce({VALID_SQL}, false)")
def news_removed(spark: SparkSession, d: str) -> DataFrame:
    return A.removed(news(spark, d), valid()).select("id")


@query(f"WITH {NEWS_SQL}, {CLUSTERS_SQL} SELECT cluster_id FROM clusters WHERE summary_text IS NULL")
def due_for_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.to_summarize(clusters(spark, d)).select("cluster_id")


@query(f"WITH {NEWS_SQL}, {CLUSTERS_SQL} SELECT cluster_id FROM clusters WHERE summary_text IS NOT NULL")
def due_for_tags_again(spark: SparkSession, d: str) -> DataFrame:
    return L.to_tag(clusters(spark, d), again=True).select("cluster_id")


@query(f"""WITH {NEWS_SQL}, c AS (SELECT cluster_id, arg_min(title, id) AS title FROM news GROUP BY cluster_id)
SELECT cluster_id, title = '' AS untitled, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS escaped FROM c""")
def titles_escaped(spark: SparkSession, d: str) -> DataFrame:
    c = clusters(spark, d)
    return c.select("cluster_id", (F.col("title") == "").alias("untitled"), L.html_escaped(F.col("title")).alias("escaped"))


@query(f"""WITH {NEWS_SQL}, r AS (SELECT cluster_id, first(id ORDER BY published_at IS NULL, coalesce(published_at, collected_at), id) AS rep FROM news GROUP BY cluster_id)
SELECT id, coalesce(id = rep, false) AS is_primary FROM news LEFT JOIN r USING (cluster_id)""")
def members_primary(spark: SparkSession, d: str) -> DataFrame:
    return C.with_primary(news(spark, d).drop("is_primary")).select("id", "is_primary")


@query(f"""WITH {NEWS_SQL}, a AS (SELECT *, url || (id % 400) AS u FROM news), s AS (SELECT DISTINCT source FROM news WHERE source LIKE '%1'),
f AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY id) AS n FROM (SELECT id, source, 'https://e.com/' || (id % 400) AS u FROM news))
SELECT id, u AS url FROM f WHERE n = 1 AND id % 400 >= 100 AND source IN (SELECT source FROM s)""")
def news_to_store(spark: SparkSession, d: str) -> DataFrame:
    """The first article of each URL that isn't stored (the first hundred URLs are), of known sources."""
    n = news(spark, d).withColumns({"url": F.concat(F.lit("https://e.com/"), (F.col("id") % 400).cast("string")), "ord": F.col("id")})
    known = _sources(spark, d).where("name LIKE '%1'")
    stored = spark.range(100).select(F.concat(F.lit("https://e.com/"), F.col("id").cast("string")).alias("url"))
    return A.to_store(n, stored, known).select("id", "url")


@query(f"WITH {NEWS_SQL}, {CLUSTERS_SQL} SELECT status, count(*) AS n, sum(cluster_size)::BIGINT AS members FROM clusters GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("cluster_size").alias("members"))


@query(f"WITH {NEWS_SQL}, {CLUSTERS_SQL} SELECT cluster_id, cluster_size AS members FROM clusters ORDER BY cluster_id DESC LIMIT 20")
def latest_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(clusters(spark, d), news(spark, d)).select("cluster_id", "members")


@query(f"WITH {NEWS_SQL}, {CLUSTERS_SQL} SELECT cluster_id, status FROM clusters WHERE summary_text IS NOT NULL AND (tags IS NULL OR status = 'not_for_publication')")
def due_for_tags(spark: SparkSession, d: str) -> DataFrame:
    return L.to_tag(clusters(spark, d)).select("cluster_id", "status")


@query(f"""WITH {NEWS_SQL}, w AS (SELECT id, md5(unnest(regexp_extract_all(lower(concat_ws('. ', title, text)), '\\S+'))) AS h FROM news),
c AS (SELECT id, ('0x' || substr(h, 1, 7))::BIGINT % 32 AS i, sum(CASE WHEN substr(h, 8, 1) >= '8' THEN 1.0 ELSE -1.0 END) AS x FROM w GROUP BY ALL),
v AS (SELECT id, list_transform(range(32), lambda i: coalesce(list_extract(map_values(map_from_entries(list_filter(l, lambda e: e.k = i))), 1), 0.0)) AS v FROM (SELECT id, list(struct_pack(k := i, v := x)) AS l FROM c GROUP BY id))
SELECT id, len(v) AS dims, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[32] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM v WHERE list_sum(list_transform(v, lambda x: x * x)) > 0""")
def encoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles and texts as vectors of the default encoder: their first and last numbers."""
    encode = V.encoder(dims=32)
    n = news(spark, d).select("id", encode(F.concat_ws(". ", "title", "text")).alias("v")).where(V.norm(F.col("v")) > 0)
    return n.select("id", F.size("v").cast("long").alias("dims"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(31)), 6).alias("last"))


@query()
def periodic_run(spark: SparkSession, d: str) -> DataFrame:
    """The whole run over all documents as newly collected articles, clustered within their source."""
    n = news(spark, d).withColumns({"ord": F.col("id"), "source": F.coalesce("source", F.lit("?"))})
    sources = n.select(F.col("source").alias("name")).distinct().withColumn("id", F.crc32(F.col("name").cast("binary")))
    as_of = n.agg(F.max("collected_at")).first()[0]
    encode = V.encoder(dims=32)
    unit = [1.0] + [0.0] * 31
    rules = periodic.Rules(
        tags=[dict(tag=t, vector=unit, positive=p, negative=q) for t, _, p, q in TAGS], foreign=FOREIGN, home=HOME, banned=BANNED, threshold=0.6, least_score=0.05,
        valid=dict(titles=TITLES, urls=URLS, content=CONTENT), encode=encode,
    )
    none = [spark.createDataFrame([], s) for s in (periodic.NEWS, periodic.CLUSTERS)]
    _, found, _ = periodic.run(*none, n, sources, as_of, new_path(spark, "run"), rules, hours=24 * 365 * 100, block="source")
    return found.select("cluster_id", "status", "tags", "cluster_size")
