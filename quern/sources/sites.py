"""Single sites as data: how to take the text of their pages, their listing pages, and the sources
that a new installation starts with; and the collection of previews by source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import feeds, html
from quern.sources.html import Rule

# --- fixed values -----------------------------------------------------------------------------
MAKERS = ("article p", ".post p", ".post-content p", ".entry-content p", ".wp-block-post-content p", ".single-post p", ".article p", ".article-content p", "main p", "div[class*='post'] p", "div[class*='article'] p", "div[class*='content'] p", "div[class*='text'] p")
PLANTS = ("article p", ".publication p", ".publication-content p", ".article-content p", ".post-content p", ".entry-content p", "main p", "div[class*='publication'] p", "div[class*='article'] p", "div[class*='content'] p", "div[class*='text'] p")
ATOM = (".news-detail", ".detail_text", ".detail-text", ".news-detail__text", ".content", ".page-content", ".main-content", "main", "article")
MILITARY = ("article p", "main p", ".article p", ".article_text p", ".article-text p", ".news_text p", ".news-text p", ".material p", ".material-text p", ".content p", ".text p", "div[itemprop='articleBody'] p", "div[class*='article'] p", "div[class*='material'] p", "div[class*='content'] p", "div[class*='text'] p")
FAR_EAST_UNWANTED = ("поделиться", "читайте также", "последние публикации", "последние аукционы", "наши контакты", "все права защищены", "при полном или частичном использовании", "настоящий ресурс содержит", "подписаться", "комментарии для сайта")
CHAMBER_DROP = (".gallery", ".photo-gallery", ".photogallery", ".news-gallery", ".slider", ".slick-slider", ".breadcrumbs", ".breadcrumb", ".share", ".social", ".print", ".subscribe", ".tags")
CHAMBER_CONTAINER = ("article", ".news-detail", ".news-detail__text", ".news-detail-text", ".article__text", ".article-text", ".main-content", "main")
CHAMBER_UNWANTED = ("поделиться", "версия для печати", "читайте также", "торгово-промышленная палата российской федерации", "все права защищены", "контактная информация", "подписаться", "фотогалерея", "назад к списку")
CHAMBER_PLACE = r"^[А-ЯЁA-Z][а-яёa-zA-Z\- ]+,\s*\d{1,2}\s+[а-яё]+\s+\d{4}\s*г\.?$"
CHAMBER_INNER_PLACE = r"\b[А-ЯЁ][а-яё\- ]+,\s*\d{1,2}\s+[а-яё]+\s+\d{4}\s*г\."
OIL_TITLES = ("h1", ".press-release__title", ".pressrelease-title", ".news-detail__title", ".article__title", ".detail-title", ".page-title", "meta[property='og:title']")
OIL_SKIP = ("пресс-релиз", "пресс-релизы", "новости", "новость")
OIL = ("article p", ".press-release p", ".pressrelease p", ".press-release__text p", ".news-detail p", ".news-detail__text p", ".article p", ".article__text p", ".content p", ".main-content p", "main p", "div[class*='press'] p", "div[class*='article'] p", "div[class*='content'] p", "div[class*='text'] p")
MINING = ("article p", ".entry-content p", ".post-content p", ".article-content p", ".content p", "main p", "div[class*='content'] p", "div[class*='article'] p", "div[class*='text'] p")
MINING_UNWANTED = ("читайте также", "поделиться", "фотогалерея", "реклама", "подписывайтесь", "другие материалы", "материалы по теме", "источник:", "главное")
TITLES = ("h1", "meta[property='og:title']")

RULES = (
    Rule(("производства.рф", "xn--80adahnf5bdekrm.xn--p1ai"), MAKERS, least=150, any_paragraph=120, title=TITLES),
    Rule(("заводы.рф", "xn--80az8a.xn--p1ai"), PLANTS, least=150, any_paragraph=120, title=TITLES),
    Rule("rosatom.ru", ATOM, least=250, title=TITLES, mode="block"),
    Rule(("военное.рф", "xn--b1aga5aadd.xn--p1ai", "flotprom.ru", "отраслевое.рф", "xn--80aegqufhcjg6b.xn--p1ai", "flot.com"), MILITARY, least=120, any_paragraph=120, title=TITLES),
    Rule("nedradv.ru", ("p, blockquote",), least=1, title=TITLES, mode="plain", least_block=40, unwanted=FAR_EAST_UNWANTED),
    Rule("tpprf.ru", ("p",), least=1, title=TITLES, mode="joined", drop=CHAMBER_DROP, container=CHAMBER_CONTAINER, least_block=40, unwanted=CHAMBER_UNWANTED, unwanted_pattern=CHAMBER_PLACE, without_title=True, cut_behind=r"(?i)\bФотогалерея\b", without=CHAMBER_INNER_PLACE, then_generic=True),
    Rule("lukoil.ru", OIL, least=120, any_paragraph=120, title=OIL_TITLES, skip_titles=OIL_SKIP),
    Rule("dprom.online", MINING, least=1, title=TITLES, mode="trimmed", least_block=40, unwanted=MINING_UNWANTED),
)

LISTINGS = {
    "Росатом": dict(prefix="/journalist/news/", exclude="/journalist/news"),
    "MASHNEWS": dict(prefix="/"),
    "Коммерсантъ — Промышленность": dict(all_parts=["/doc/"], least_title=10, stop=[], whole=True),
    "DixiNews — Промышленность": dict(prefix="/news/promyshlennost/", exclude="/news/promyshlennost"),
    "НедраДВ": dict(all_parts=["/nedradv/ru/page_news", "obj="], least_title=20, stop=[], whole=True),
    "ТПП РФ": dict(prefix="/ru/news/", exclude="/ru/news"),
    "Добывающая промышленность": dict(any_part=["/mining/", "/geology/", "/metallurgy/", "/oilgas/", "/technologies/", "/events/"], stop=["читать далее", "подробнее", "добыча"]),
}
SECTIONS = {"Вестник промышленности": (html.Section("Промышленные новости"), dict(stop=["читать далее", "подробнее", "новости", "проновости"]))}
#: Any other site: links that look like articles, by their whole text.
GENERIC = dict(articles_only=True, stop=[], whole=True)

#: Hosts whose pages only a browser can read.
BROWSER = ["nornickel.ru", "заводы.рф", "xn--80az8a.xn--p1ai", "производства.рф", "xn--80adahnf5bdekrm.xn--p1ai", "tpprf.ru", "news.tpprf.ru"]
#: Sources that write about the armed forces.
MILITARY_SOURCES = ["Военное.рф", "ФлотПром", "ФлотКом"]
#: name, url, rss_url, source_type, is_active
SOURCES = [
    ("ИАПН", "https://iapn.ru", "https://iapn.ru/feed/", "html", True),
    ("Промышленный вестник / ПВ.РФ", "https://promvest.info/ru/novosti-promyishlennosti/", None, "html", True),
    ("Производства.рф", "https://производства.рф/", None, "html", True),
    ("Ростех", "https://rostec.ru/media/news/", None, "html", True),
    ("ОСК", "https://www.aoosk.ru/press-center/news/", None, "html", True),
    ("Роснефть", "https://www.rosneft.ru/press/news/", None, "html", True),
    ("Заводы.рф", "https://заводы.рф/publications", None, "html", True),
    ("Газпром", "https://www.gazprom.ru/press/news/", None, "html", False),
    ("ЛУКОЙЛ", "https://lukoil.ru/PressCenter/Pressreleases", None, "html", True),
    ("Норильский никель", "https://www.nornickel.ru/news-and-media/press-releases-and-news/", None, "html", True),
    ("Военное.рф", "https://военное.рф/2026/", None, "html", False),
    ("ФлотПром", "https://flotprom.ru/2026/", None, "html", True),
    ("Отраслевое.рф", "https://отраслевое.рф", None, "html", True),
    ("ФлотКом", "https://flot.com", None, "html", True),
    ("Энергетика и промышленность России", "https://www.eprussia.ru", None, "html", True),
    ("Вестник промышленности", "https://vestnikprom.ru", None, "html", True),
    ("РИА Новости", "https://ria.ru", "https://ria.ru/export/rss2/index.xml", "rss", False),
    ("ТАСС", "https://tass.ru", "https://tass.ru/rss/v2.xml", "rss", False),
    ("Интерфакс", "https://www.interfax.ru", "https://www.interfax.ru/rss.asp", "rss", False),
    ("MASHNEWS", "https://mashnews.ru/", None, "html", True),
    ("Коммерсантъ — Промышленность", "https://www.kommersant.ru/theme/3631", None, "html", True),
    ("DixiNews — Промышленность", "https://dixinews.ru/news/promyshlennost/", None, "html", True),
    ("НедраДВ", "https://nedradv.ru/nedradv/ru/news", None, "html", True),
    ("ТПП РФ", "https://news.tpprf.ru/ru/main/", None, "html", True),
    ("Добывающая промышленность", "https://dprom.online/mainthemes/news/", None, "html", True),
]
# ----------------------------------------------------------------------------------------------


def seeds(spark: SparkSession) -> DataFrame:
    """The sources to start with, for ``operators.articles.upserted``."""
    return spark.createDataFrame(SOURCES, "name string, url string, rss_url string, source_type string, is_active boolean")


def shown(articles: DataFrame, length: int = 1200) -> DataFrame:
    """Articles as one looks at them after a collection: with the length and the beginning of their texts."""
    return articles.select("title", "source", "url", "published_at", "text_source", F.length("text").alias("n_chars"), F.substring("text", 1, length).alias("beginning"))


def collected(sources: DataFrame, listings: DataFrame, feeds_read: DataFrame, limit: int = 10) -> DataFrame:
    """Previews (source, n, title, url, published_at, text) of all sources.

    ``listings``: rows (page_id, source, url, html) of listing pages; ``feeds_read``: rows (source, xml).
    A source of type ``rss`` is read from its feed; one of type ``html`` by the listing of its name,
    or the generic one; other types are left out."""
    kinds = sources.select(F.col("name").alias("source"), "source_type")
    rss = feeds.rss_previews(feeds_read.join(kinds.where("source_type = 'rss'").select("source"), "source"), limit)
    out = [rss.select("source", F.col("pos").alias("n"), "title", "url", "published_at", "text")]
    pages = listings.join(kinds.where("source_type = 'html'").select("source"), "source")
    named = [*LISTINGS, *SECTIONS]
    jobs = [(pages.where(~F.col("source").isin(named)), None, GENERIC)]
    jobs += [(pages.where(F.col("source") == name), None, how) for name, how in LISTINGS.items()]
    jobs += [(pages.where(F.col("source") == name), section, how) for name, (section, how) in SECTIONS.items()]
    for some, section, how in jobs:
        found = html.previews(html.links(some, section), limit, **how).join(some.select("page_id", "source"), "page_id")
        out.append(found.select("source", F.col("n").cast("int").alias("n"), html.preview_title(F.col("title"), F.col("source")).alias("title"), "url", F.lit(None).cast("timestamp").alias("published_at"), F.lit("").alias("text")))
    return reduce(DataFrame.unionByName, out)
