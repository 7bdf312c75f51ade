"""Rules, listings and seeds of single sites, on small pages."""

import datetime as dt

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.functions import vectors as V
from quern.operators import clusters as C
from quern.operators import tags as G
from quern.sources import feeds, html, sites
from quern.streaming import ingest

LONG = "На заводе в Перми {} запустили новую линию по выпуску стальных труб большого диаметра для нефтяников."
OTHER = "Мощность второй очереди составит {} тысяч тонн продукции в год, сообщили на предприятии сегодня утром."


def page(body, title="Завод запустил новую линию"):
    return f"<html><head><meta property='og:title' content='Другой заголовок'></head><body><h1>{title}</h1>{body}</body></html>"


def texts(spark, pages, rules=sites.RULES):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r for r in html.articles(df, rules).collect()}


def test_rules_of_sites(spark):
    paras = "".join(f"<p>{LONG.format(i)}</p><p>{OTHER.format(i)}</p>" for i in range(2))
    whole = " ".join(t for i in range(2) for t in (LONG.format(i), OTHER.format(i)))
    place = "<p>Казань, 14 мая 2026 г.</p>"
    got = texts(spark, [
        ("https://xn--80az8a.xn--p1ai/1", page(f"<article>{paras}</article>")),
        ("https://www.rosatom.ru/1", page(f"<div class='content'>{whole}</div>")),
        ("https://www.rosatom.ru/2", page(f"<div class='content'>мусор {paras}</div>")),
        ("https://nedradv.ru/1", page(f"<blockquote>{LONG.format(1)}</blockquote><p>Коротко.</p>{paras}<p>Поделиться этой новостью с вашими друзьями и близкими</p>")),
        ("https://news.tpprf.ru/1", page(f"<main><div class='gallery'><p>{LONG.format(7)}</p></div>{place}{paras}</main><p>{LONG.format(9)}</p>")),
        ("https://news.tpprf.ru/2", page("<main><p>нет</p></main>" + f"<div class='content'>{paras}{paras}</div>")),
        ("https://dprom.online/1", page(f"<article><p>Завод запустил новую линию. {LONG.format(1)}</p><p>Реклама на сайте: пишите нам по этому адресу всегда</p><p>{OTHER.format(1)}</p></article>")),
        ("https://lukoil.ru/1", page(f"<main>{paras}</main>", "Пресс-релиз")),
        ("https://flot.com/1", page("<p>пусто</p>")),
        ("https://example.org/1", page(f"<article><p>Завод запустил новую линию {LONG.format(3)}</p>{paras}</article>")),
    ])
    assert got[0]["text"] == got[1]["text"] == got[2]["text"] == got[4]["text"] == got[7]["text"] == whole
    assert got[3]["text"] == " ".join(["Завод запустил новую линию", LONG.format(1), LONG.format(0), OTHER.format(0), OTHER.format(1)])
    assert got[5]["text"] == whole  # nothing in the site's own block: the generic selectors
    assert got[6]["text"] == OTHER.format(1)  # a paragraph that holds the title is a fragment of it
    assert got[7]["title"] == "Другой заголовок" and got[0]["title"] == "Завод запустил новую линию"
    assert (got[8]["text"], got[8]["text_source"]) == ("", "none")
    assert got[9]["text"] == f"{LONG.format(3)} {whole}"  # the title in front of a paragraph goes


def test_paragraphs_lose_the_title_and_what_a_text_loses(spark):
    df = spark.createDataFrame([([f"Новый цех {LONG.format(1)}", f"{OTHER.format(2)} Читайте также: всё", "Коротко"], "Новый цех")], "p array<string>, t string")
    got = df.select(T.filter_paragraphs(F.col("p"), F.col("t")).alias("p")).first()["p"]
    assert got == [LONG.format(1), OTHER.format(2)]


def anchors(*pairs):
    return "".join(f"<a href='{u}'>{t}</a>" for u, t in pairs)


def test_collected_by_source(spark):
    title = "Предприятие открыло новый цех номер {}"
    sources = [("Росатом", "html"), ("Коммерсантъ — Промышленность", "html"), ("НедраДВ", "html"), ("Добывающая промышленность", "html"), ("Вестник промышленности", "html"), ("Прочие", "html"), ("Лента", "rss"), ("Чужие", "api")]
    listings = [
        (1, "Росатом", "https://rosatom.ru/journalist/news/", anchors(("/journalist/news", title.format(0)), ("/journalist/news/a", title.format(1)), ("/about/b", title.format(2)), ("/journalist/news/a#x", title.format(3)))),
        (2, "Коммерсантъ — Промышленность", "https://www.kommersant.ru/theme/3631", anchors(("/doc/1", "Десять букв"), ("/doc/2", "мало"), ("/news/3", title.format(1)))),
        (3, "НедраДВ", "https://nedradv.ru/nedradv/ru/news", anchors(("/nedradv/ru/page_news?obj=1", title.format(1)), ("/nedradv/ru/page_news", title.format(2)))),
        (4, "Добывающая промышленность", "https://dprom.online/mainthemes/news/", "<a href='/mining/1'><h3>Открыто новое месторождение меди</h3>лишнее</a>" + anchors(("/events/2", "Добыча"), ("/other/3", title.format(1)))),
        (5, "Вестник промышленности", "https://vestnikprom.ru", "<div><h2>Промышленные новости</h2>" + anchors(("/2026/01/02/a", title.format(1)), ("/2026/01/03/b", title.format(2))) + "</div>"),
        (6, "Прочие", "https://promvest.info/ru/novosti-promyishlennosti/", anchors(("/ru/novosti-promyishlennosti/", title.format(0)), ("/post/1", title.format(1)), ("/post/1#c", title.format(2)), ("/x/2", title.format(3)))),
        (7, "Чужие", "https://e.com", anchors(("/post/1", title.format(1)))),
    ]
    item = "<item><title>Новый цех открыт сегодня</title><link>https://e.com/1</link><description>&lt;p&gt;Тел. +7 900 123-45-67. Завод в Перми открыл новый цех.&lt;/p&gt; Читайте также: всё</description></item>"
    got = sites.collected(
        spark.createDataFrame(sources, "name string, source_type string"), spark.createDataFrame(listings, "page_id long, source string, url string, html string"),
        spark.createDataFrame([("Лента", f"<rss><channel>{item}</channel></rss>"), ("Росатом", f"<rss><channel>{item}</channel></rss>")], "source string, xml string"),
    ).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["source"], r["n"])):
        by.setdefault(r["source"], []).append(r["url"].split("//")[1].split("/", 1)[1])
    assert by == {
        "Росатом": ["journalist/news/a"], "Коммерсантъ — Промышленность": ["doc/1"], "НедраДВ": ["nedradv/ru/page_news?obj=1"], "Добывающая промышленность": ["mining/1"],
        "Вестник промышленности": ["2026/01/02/a", "2026/01/03/b"], "Прочие": ["post/1"], "Лента": ["1"],
    }
    assert next(r["title"] for r in got if r["source"] == "Добывающая промышленность") == "Открыто новое месторождение меди"
    assert next(r["text"] for r in got if r["source"] == "Лента") == "Завод в Перми открыл новый цех."


def test_link_titles():
    one = lambda h: html.link_title(html.select(html.parse(h), "a")[0])
    assert one("<a href='x'><h3>Коротко</h3><span class='entry-title'>Достаточно длинный</span></a>") == "Достаточно длинный"
    assert one("<a href='x'>Подробнее — Завод открыт Новости</a>") == "Завод открыт" and one("<a href='x' title='Из атрибута'>текст</a>") == "Из атрибута"
    assert one(f"<a href='x'>{'Первое ' * 20}. {'Второе ' * 20}</a>") == ("Первое " * 20).strip() + "."


def test_listing_pages_are_no_articles(spark):
    rows = [("https://promvest.info/ru/novosti-kompaniy/",), ("https://www.nornickel.ru/news-and-media/press-releases-and-news/",), ("https://www.nornickel.ru/news-and-media/press-releases-and-news/a",)]
    got = [r["a"] for r in spark.createDataFrame(rows, "u string").select(U.is_probably_article(F.col("u")).alias("a")).collect()]
    assert got == [False, False, True]


def test_seeds(spark):
    s = sites.seeds(spark)
    assert s.count() == s.select("name").distinct().count() == 25 and s.where("is_active").count() == 20


def test_content_is_measured_without_outer_blanks_only(spark):
    rows = [(1, "t", "  " + "a" * 100 + "  " + "b" * 99 + "\n"), (2, "t", "a" * 200), (3, "t", "a" * 100 + " " * 10 + "b" * 91), (4, "", "a" * 300)]
    got = {r["cluster_id"]: r["has_content"] for r in G.has_content(spark.createDataFrame(rows, "cluster_id int, title string, text string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_reports_and_late_rows(spark):
    at = dt.datetime(2024, 1, 3)
    rows = [(1, 7, None, "a", at), (2, 7, at, "a", at - dt.timedelta(hours=9)), (3, 8, at, "b", at)]
    n = spark.createDataFrame(rows, "id int, cluster_id int, published_at timestamp, source string, collected_at timestamp")
    assert [r["id"] for r in C.members_of(n, 7).collect()] == [2, 1] and [r["id"] for r in C.members_of(n, 7, nulls_first=True).collect()] == [1, 2]
    assert C.by_id(n, 8).count() == 1
    assert {r["source"]: r["skipped_late"] for r in ingest.late(n, at).collect()} == {"a": 1, "b": 0}


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label,more\n"two\nlines",metal,1\n,art,2\nnone,,3\n')
    assert [tuple(r) for r in feeds.training_rows(spark, str(tmp_path / "a.csv")).collect()] == [("two\nlines", "metal")]


def test_browser_pages_tag_vectors_and_foreign_sources(spark):
    plain = spark.createDataFrame([(1, "https://www.nornickel.ru/a", "plain"), (2, "https://e.com/a", ""), (3, "https://e.com/b", "plain")], "page_id long, url string, html string")
    seen = spark.createDataFrame([(1, "seen"), (2, "seen"), (3, "seen")], "page_id long, html string")
    assert {r["page_id"]: r["html"] for r in html.pages_of(plain, seen, sites.BROWSER).collect()} == {1: "seen", 2: "seen", 3: "plain"}
    encode = V.encoder(dims=8)
    tags = G.embedded(spark.createDataFrame([(2, "b", "two words", None, ["x"]), (1, "a", "one", ["y"], [])], "ord int, tag string, description string, positive array<string>, negative array<string>"), encode)
    assert [t["tag"] for t in tags] == ["a", "b"] and abs(sum(x * x for x in tags[1]["vector"]) - 1) < 1e-9 and tags[1]["positive"] == []
    members = spark.createDataFrame([(1, "ФлотКом", "t", "Флот Франции вышел"), (2, "ФлотКом", "t", "Флот вышел"), (3, "ТАСС", "t", "Флот Франции")], "cluster_id int, source string, title string, text string")
    c = spark.createDataFrame([(1, "", None), (2, "Франция", None), (3, "", ""), (4, "Франция", "")], "cluster_id int, title string, summary_text string")
    got = {r["cluster_id"]: r["hit"] for r in G.foreign_of_sources(members, c, sites.MILITARY_SOURCES, ["Франц"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    shown = sites.shown(spark.createDataFrame([("t", "s", "u", None, "html", "abc")], "title string, source string, url string, published_at timestamp, text_source string, text string"), 2).first()
    assert (shown["n_chars"], shown["beginning"]) == (3, "ab")
