import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import articles as A
from quern.operators import clusters as C
from quern.operators import lifecycle as L
from quern.operators import tags as G
from quern.sources import feeds, html


def test_valid_articles(spark):
    good = "x" * 250
    rows = [("t", "u", good), ("t", "u", good[1:]), (None, "u", good), ("Анонс", "u", good), ("t", "/about", good), ("t", "u", good + " вакансии"), ("t", "", good)]
    df = spark.createDataFrame(rows, "title string, url string, text string")
    assert [r["v"] for r in df.select(A.is_valid().alias("v")).collect()] == [True] + [False] * 6


def test_store_takes_the_first_unknown_of_known_sources(spark):
    arts = spark.createDataFrame([("u1", "s", 2), ("u1", "s", 1), ("u2", "s", 3), ("u3", "?", 4)], "url string, source string, ord int")
    news, src = spark.createDataFrame([("u2",)], "url string"), spark.createDataFrame([(7, "s")], "id int, name string")
    assert [(r["url"], r["ord"], r["source_id"]) for r in A.to_store(arts, news, src).collect()] == [("u1", 1, 7)]


def test_upsert(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x int"), spark.createDataFrame([("b", 9), ("c", 3)], "name string, x int")
    assert sorted(map(tuple, A.upserted(old, new).collect())) == [("a", 1), ("b", 9), ("c", 3)]


def brute_leaders(vectors, threshold):
    members, out = [], []
    for i, v in enumerate(vectors):
        best, score = None, 0.0
        for k, m in enumerate(members):
            c = np.mean([vectors[j] for j in m], axis=0)
            s = float(v @ c / (np.linalg.norm(v) * np.linalg.norm(c)))
            if s > score:
                best, score = k, s
        if best is not None and score >= threshold:
            members[best].append(i)
        else:
            members.append([i])
            best = len(members) - 1
        out.append(members[best][0])
    return out


def test_leader_clusters_equal_the_plain_loop(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 6))
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "b int, id long, embedding array<double>").withColumn("at", F.col("id"))
    got = {r["id"]: r["leader"] for r in C.leader_clusters(df.repartition(7), 0.7, "at", "id", "b").collect()}
    assert [got[i] for i in range(200)] == brute_leaders(v, 0.7)


def test_cosine_of_nulls_and_zeros(spark):
    df = spark.createDataFrame([([1.0, 0.0], None), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r["c"], 4) for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 0.0, 0.7071]


def test_keyword_scores_and_gap(spark):
    df = spark.createDataFrame([(1, "a b c d e", [1.0, 0.0])], "id int, text string, vector array<double>")
    tags = [dict(tag="x", vector=[1.0, 0.0], positive=["a", "a", "b", "c"], negative=[]), dict(tag="y", vector=[1.0, 0.0], positive=["a"], negative=["e"] * 4), dict(tag="z", vector=[0.0, 1.0], positive=[], negative=[])]
    s = {r["tag"]: r for r in G.scored(df, tags, "id").collect()}
    assert (s["x"]["keyword_boost"], s["y"]["keyword_penalty"]) == (0.09, 0.15)
    assert G.selected(G.scored(df, tags, "id"), "id").first()["tags"] == ["x"]


def test_clean_up_is_strict(spark):
    at = dt.datetime(2024, 1, 3)
    rows = [(1, "not_for_publication", at - dt.timedelta(hours=48)), (2, "not_for_publication", at - dt.timedelta(hours=49)), (3, "ready", at - dt.timedelta(hours=99))]
    c = spark.createDataFrame(rows, "cluster_id int, status string, updated_at timestamp")
    assert [r["cluster_id"] for r in L.victims(c, at).collect()] == [2]


def test_selectors_and_broken_markup():
    root = html.parse("<article class='a b'><p>one<b>two<p>three</p></article><div class='my-text'><p>four</p><script>x</script></div>")
    assert [n.text() for n in html.select(root, ".b p")][-1] == "three"
    assert [n.text() for n in html.select(root, "div[class*='text'] p")] == ["four"]
    root.drop(["script"])
    assert "x" not in html.select(root, "div")[0].text()


def test_link_previews(spark):
    page = "<a href='/n/1'>short</a><a href='/n/1#x'>A title that is long enough</a><a href='https://other/n/2'>Another long enough title</a>"
    pages = spark.createDataFrame([(1, "https://e.com/", page)], "page_id long, url string, html string")
    assert [r["url"] for r in html.previews(html.links(pages), prefix="/n").collect()] == ["https://e.com/n/1"]


def test_rss(spark):
    item = "<item><title>Новый цех открыт</title><link>https://e.com/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>Текст новости о новом цехе завода.</description></item>"
    df = spark.createDataFrame([("s", f"<rss><channel>{item}<item><title/></item>{item}</channel></rss>")], "source string, xml string")
    rows = feeds.rss_previews(df, limit=2).collect()
    assert [(r["title"], r["url"], r["text"]) for r in rows] == [("Новый цех открыт", "https://e.com/1", "Текст новости о новом цехе завода.")]


def test_stream_stores_each_url_once(spark, tmp_path):
    from quern.streaming.ingest import ingest

    schema = "title string, url string, text string, ord int"
    src, table = str(tmp_path / "in"), str(tmp_path / "news")
    for k in range(2):
        spark.createDataFrame([("t", "u1", "x" * 300, 1), ("t", f"v{k}", "x" * 300, 2), ("t", "w", "short", 3)], schema).write.mode("append").parquet(src)
        ingest(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "c"), every=None).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(table).collect()) == ["u1", "v0", "v1"]


def test_a_stream_without_repeats_in_its_window(spark, tmp_path):
    from quern.streaming.ingest import unique_recent

    src, at = str(tmp_path / "in"), dt.datetime(2024, 1, 1, 12)
    for k in range(3):
        spark.createDataFrame([("u1", at + dt.timedelta(minutes=k)), (f"v{k}", at + dt.timedelta(minutes=k))], "url string, collected_at timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("url string, collected_at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    unique_recent(stream).writeStream.format("memory").queryName("recent").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["url"] for r in spark.table("recent").collect()) == ["u1", "v0", "v1", "v2"]


def test_own_tables(spark, tmp_path):
    from quern.sources import tables

    tables.create(spark, "own_tables_test")
    try:
        assert {t.name for t in spark.catalog.listTables("own_tables_test")} == set(tables.SCHEMAS)
        assert tables.scan(spark, "own_tables_test.news").count() == 0
    finally:
        spark.sql("DROP DATABASE own_tables_test CASCADE")


def test_nearest_is_the_same_in_blocks(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 5)))] + [(60, None), (61, [0.0] * 5)], "id long, embedding array<double>")
    centers = spark.createDataFrame([(k, f"c{k}", x.tolist()) for k, x in enumerate(rng.normal(size=(23, 5)))], "ord int, center string, centroid array<double>")
    one, many = (sorted(map(tuple, C.nearest(rows, centers, 0.5, "id", **how).collect())) for how in ({}, {"most_bytes": 0, "block": 4}))
    assert one == many and len(one) == 62 and one[60][1] is None


def test_leader_clusters_go_on_from_earlier_ones(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(160, 6))
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "b int, id long, embedding array<double>").withColumn("at", F.col("id"))
    first = C.leader_clusters(df.where("id < 100"), 0.7, "at", "id", "b")
    known = C.totals(df.join(first.select("id", "leader"), "id"), "leader").withColumn("b", F.lit(0))
    second = C.leader_clusters(df.where("id >= 100"), 0.7, "at", "id", "b", existing=known)
    got = {r["id"]: r["leader"] for r in first.union(second).collect()}
    assert [got[i] for i in range(160)] == brute_leaders(v, 0.7)


def test_periodic_run(spark, tmp_path):
    from quern.functions.vectors import encoder
    from quern.plans import periodic as P

    at = dt.datetime(2024, 1, 3)
    body = "The new plant number {0} makes steel tubes for the northern pipeline since {0} days now. Its second line will open in the year {0} after long repairs of the main hall. " * 2 + "Engineers of plant {0} said that tests of all machines went on for several weeks without a fault."
    rows = [(i, "s", f"Plant {i // 2} opens", f"u{i}", body.format(1000 + i // 2) + (" again" if i % 2 else ""), None, at - dt.timedelta(hours=1, minutes=-i), i) for i in range(6)]
    rows += [(6, "?", "Plant", "u6", body.format(9), None, at, 6), (7, "s", "Thin", "u7", "short", None, at, 7), (8, "s", "Again", "u0", body.format(8), None, at, 8)]
    articles = spark.createDataFrame(rows, "id long, source string, title string, url string, text string, published_at timestamp, collected_at timestamp, ord int")
    sources = spark.createDataFrame([(1, "s")], "id int, name string")
    vector = spark.createDataFrame([("steel tubes plant pipeline",)], "t string").select(encoder()(F.col("t")).alias("v")).first()["v"]
    rules = P.Rules(tags=[dict(tag="steel", vector=vector, positive=["steel", "tubes"], negative=[]), dict(tag="art", vector=[0.0] * 256, positive=["opera"], negative=[])], threshold=0.97, least_score=0.05, valid=dict(titles=[], urls=[], content=[]))
    none = [spark.createDataFrame([], s) for s in (P.NEWS, P.CLUSTERS)]
    news, clusters, posts = P.run(*none, articles, sources, at, str(tmp_path / "a"), rules)
    assert sorted((r["id"], r["cluster_id"], r["is_primary"]) for r in news.collect()) == [(i, i - i % 2, i % 2 == 0) for i in range(6)]
    assert sorted((r["cluster_id"], r["status"], r["tags"], r["cluster_size"]) for r in clusters.collect()) == [(i, "ready", "steel", 2) for i in (0, 2, 4)]
    assert all(len(r["summary_text"]) > 45 for r in clusters.collect()) and posts.count() == 3
    sent = L.published(clusters, posts)
    more = articles.where("id = 5").withColumns({"id": F.lit(9).cast("long"), "url": F.lit("u9")}).union(articles.where("id = 0"))
    news, clusters, posts = P.run(news, sent, more, sources, at, str(tmp_path / "b"), rules)
    assert news.count() == 7 and news.where("cluster_id = 4").count() == 3 and posts.count() == 0
    assert {r["cluster_id"]: (r["cluster_size"], r["status"]) for r in clusters.collect()} == {0: (2, "published"), 2: (2, "published"), 4: (3, "published")}


def test_most_similar_is_the_same_in_blocks(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(40, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(40, None), (41, [0.0] * 4)], "id long, embedding array<double>")
    got = {b: sorted(map(tuple, C.most_similar(rows, rows.where("id % 4 = 0"), 3, "id", block=b).select("query", "rn", "id").collect())) for b in (3, 1024)}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.zeros((42, 42))
    cos[:40, :40] = u @ u.T
    want = sorted((q, n + 1, i) for q in range(0, 42, 4) for n, i in enumerate(sorted((i for i in range(42) if i != q), key=lambda i: (-round(cos[q, i], 9), i))[:3]))
    assert got[3] == got[1024] == want


def test_posts_that_fail_stay_ready(spark, tmp_path):
    due = spark.createDataFrame([(1, "a", "x"), (2, "bad", "y")], "cluster_id long, post_title string, body string")

    def send(title, body):
        if title == "bad":
            raise OSError("no route")

    sent = L.delivered(due, send)
    sent.write.parquet(str(tmp_path / "sent"))
    sent = spark.read.parquet(str(tmp_path / "sent"))
    assert {r["cluster_id"]: r["error"] for r in sent.collect()} == {1: None, 2: "OSError: no route"}
    clusters = spark.createDataFrame([(1, "ready"), (2, "ready")], "cluster_id long, status string")
    assert {r["cluster_id"]: r["status"] for r in L.published(clusters, sent.where("error is null")).collect()} == {1: "published", 2: "ready"}


def test_classifier(spark, tmp_path):
    from quern.functions.vectors import encoder
    from quern.operators import classify

    rows = spark.createDataFrame([(f"steel tubes {i}", "metal") for i in range(8)] + [(f"opera song {i}", "art") for i in range(8)] + [("x", None)], "text string, label string")
    encode = encoder(dims=64)
    classify.save(classify.train(rows, encode), str(tmp_path / "c"))
    c = classify.load(str(tmp_path / "c"), encode)
    asked = spark.createDataFrame([(1, "new steel tubes"), (2, "an opera"), (3, " "), (4, None)], "id long, text string")
    got = {r["id"]: r for r in c.scored(asked).select("id", "scores", classify.best(F.col("scores")).alias("b")).collect()}
    assert got[1]["b"]["label"] == "metal" and got[2]["b"]["label"] == "art" and abs(sum(got[1]["scores"].values()) - 1) < 1e-9
    assert got[3]["scores"] == got[4]["scores"] == {} and got[3]["b"]["label"] is None


def test_rules_of_single_sites(spark):
    long = "A paragraph that is surely longer than forty characters, number {}."
    body = f"<h1>Head line</h1><div class='gallery'><p>{long.format(0)}</p></div><main><p>{long.format(1)}</p><p>{long.format(1)}</p><p>Short.</p><p>{long.format(2)} Share it</p></main><p>{long.format(3)}</p>"
    pages = spark.createDataFrame([(1, "https://a.com/1", body), (2, "https://b.com/2", body)], "page_id long, url string, html string")
    common = dict(selectors=("p",), least=10, least_block=40, unwanted=("share",))
    rules = (html.Rule("a.com", mode="plain", **common), html.Rule("b.com", mode="joined", drop=(".gallery",), container=("main",), without_title=True, **common))
    got = {r["page_id"]: r["text"] for r in html.articles(pages, rules).collect()}
    assert got[1] == " ".join(["Head line", *(long.format(i) for i in (0, 1, 3))])
    assert got[2] == long.format(1)


def test_links_below_a_heading(spark):
    dated = "".join(f"<a href='/2024/01/0{i}/slug'>A title that is long enough {i}</a>" for i in (1, 2))
    page = f"<div><a href='/2024/01/09/x'>Another title that is long enough</a><section><div><h2>Fresh news</h2></div>{dated}<a href='/about'>A page about all of this</a></section></div>"
    pages = spark.createDataFrame([(1, "https://e.com/", page), (2, "https://e.com/", "<p>none</p>")], "page_id long, url string, html string")
    assert sorted(r["url"] for r in html.previews(html.links(pages, html.Section("Fresh news"))).collect()) == [f"https://e.com/2024/01/0{i}/slug" for i in (1, 2)]
    assert html.previews(html.links(pages), all_parts=["/2024/", "/09/"]).count() == 1


def test_fetch_gives_nothing_for_what_cannot_be_had(spark):
    from quern.sources import fetch

    urls = spark.createDataFrame([(1, "http://127.0.0.1:9/"), (2, None), (3, "no url")], "page_id long, url string")
    assert [r["html"] for r in fetch.pages(urls, timeout=2).collect()] == ["", "", ""]
    assert fetch.decoded("Завод".encode("cp1251"), "ISO-8859-1") == "Завод" and fetch.decoded("Завод".encode(), None) == "Завод"


def test_own_tables(spark, tmp_path):
    from quern.sources import tables

    for name, schema in tables.SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert tables.scan(spark, "news", str(tmp_path)).columns[0] == "id"
    news = spark.createDataFrame([("u",), (None,)], "url string")
    assert tables.with_url(news, "u").count() == 1 and tables.with_url(news, "").count() == 0


def test_fetch_from_a_server(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from quern.sources import fetch

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/a" else 403)
            self.send_header("Content-Type", "text/html; charset=ISO-8859-1")
            self.end_headers()
            self.wfile.write("<p>Завод</p>".encode("cp1251"))

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(1, f"{at}/a"), (2, f"{at}/b")], "page_id long, url string")
        assert [r["html"] for r in fetch.pages(urls, timeout=5).orderBy("page_id").collect()] == ["<p>Завод</p>", ""]
    finally:
        server.shutdown()
